"""Cleaning that flags cadences and never drops them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ephemeris import Ephemeris, finite, in_window, phase
from ..sources.shared import written
from .series import alike

MODES = ("none", "positive_only", "symmetric", "transit_protected_symmetric")
ROUNDS = 5


def clip(cadences: DataFrame, mode: str, sigma: float, e: Ephemeris | None = None, scale: float = 1.25) -> DataFrame:
    """cadences with is_finite, is_clipped and is_retained.

    Per target, up to ROUNDS rounds: what lies more than sigma population deviations from the median of what is still
    kept goes. Rounds work on how often each flux of a target is there and end with a row of bounds a target, which
    cadences are joined to, so no task buffers a target's cadences. In the protected mode cadences in the window of the
    known dip are neither used nor clipped.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    if mode == "transit_protected_symmetric" and e is None:
        raise ValueError("transit_protected_symmetric needs an ephemeris")
    df = cadences.withColumn("is_finite", finite("time", "flux"))
    usable = F.col("is_finite") & ~in_window(F.col("time"), e, scale) if mode == MODES[3] else F.col("is_finite")
    df = df.withColumn("_in", F.coalesce(usable, F.lit(False)))
    clipped = F.lit(False)
    if mode != "none":
        df, clipped = alike(df, _bounds(df.where("_in"), mode, sigma), ["target_id"], "left"), F.col("_in") & _beyond(mode)
    flagged = df.withColumn("is_clipped", clipped).withColumn("is_retained", F.col("is_finite") & ~F.col("is_clipped"))
    return flagged.drop("_in", "_low", "_high")


def _beyond(mode: str) -> Column:
    above, below = F.col("flux") > F.col("_high"), F.col("flux") < F.col("_low")
    return F.coalesce(above if mode == "positive_only" else above | below, F.lit(False))


def _bounds(used: DataFrame, mode: str, sigma: float) -> DataFrame:
    """(target_id, _low, _high): the narrowest bounds of all rounds, for a flux beyond those of any round is gone."""
    key = ["target_id"]
    counts = written(used.groupBy(*key, "flux").agg(F.count("*").alias("n")))
    bounds, kept = None, counts
    for _ in range(ROUNDS):
        middle = kept.groupBy(*key).agg(F.percentile("flux", 0.5, F.col("n")).alias("_m"), (F.sum(F.col("n") * F.col("flux")) / F.sum("n")).alias("_mean"), (F.min("flux") == F.max("flux")).alias("_one"))
        off = F.sqrt(F.sum(F.col("n") * (F.col("flux") - F.col("_mean")) ** 2) / F.sum("n"))
        spread = alike(kept, middle, key).groupBy(*key).agg(F.max("_m").alias("_m"), F.when(F.max("_one"), 0.0).otherwise(off).alias("_s"))
        new = spread.select(*key, (F.col("_m") - sigma * F.col("_s")).alias("_low"), (F.col("_m") + sigma * F.col("_s")).alias("_high"))
        if bounds is not None:
            new = alike(bounds, new.withColumnsRenamed({"_low": "_l", "_high": "_h"}), key, "left").select(*key, F.greatest("_low", "_l").alias("_low"), F.least("_high", "_h").alias("_high"))
        bounds = written(new)
        kept = alike(counts, bounds, key).where(~_beyond(mode)).select(*key, "flux", "n")
    return bounds


def normalize(cadences: DataFrame, *by: str) -> DataFrame:
    """cadences with flux_median over the columns `by` and flux_norm, flux over it; a median of zero leaves null."""
    own = W.partitionBy(*by)
    df = cadences.withColumn("flux_median", F.median("flux").over(own))
    return df.withColumn("flux_norm", F.try_divide(F.col("flux"), F.col("flux_median")))


def preprocess(cadences: DataFrame, mode: str, sigma: float = 5.0, e: Ephemeris | None = None, scale: float = 1.25) -> DataFrame:
    """Finite check, clipping, then normalisation by the median of what is retained."""
    df = clip(cadences, mode, sigma, e, scale)
    counts = df.where("is_retained").groupBy("target_id", "flux").agg(F.count("*").alias("_n"))
    df = alike(df, counts.groupBy("target_id").agg(F.percentile("flux", 0.5, F.col("_n")).alias("flux_median")), ["target_id"], "left")
    return df.withColumn("flux_norm", F.when(F.col("is_retained"), F.try_divide(F.col("flux"), F.col("flux_median"))))


def removal_counts(flagged: DataFrame, e: Ephemeris, scale: float = 1.25) -> DataFrame:
    """Per target, how many cadences were kept or removed inside and outside the window of the known dip."""
    inside = F.coalesce(in_window(F.col("time"), e, scale), F.lit(False))
    gone = {"retained": F.col("is_retained"), "nonfinite": ~F.col("is_finite"), "clipped": F.col("is_clipped"), "removed": ~F.col("is_retained")}
    counts = [F.count_if(c & (inside if where == "inside" else ~inside)).alias(f"{name}_{where}") for name, c in gone.items() for where in ("inside", "outside")]
    return flagged.groupBy("target_id").agg(*counts)


def removal_by_phase(flagged: DataFrame, e: Ephemeris, bins: int = 20) -> DataFrame:
    """Per target and phase bin, empty bins included: cadences, and what was removed. The last bin is closed."""
    fraction = phase(F.col("time"), e) / e.period + 0.5
    counts = flagged.where(finite("time")).groupBy("target_id", F.least(F.floor(fraction * bins), F.lit(bins - 1)).cast("int").alias("phase_bin")).agg(
        F.count("*").alias("cadences"), F.count_if(~F.col("is_finite")).alias("nonfinite"), F.count_if("is_clipped").alias("clipped")
    )
    all_bins = flagged.select("target_id").distinct().select("target_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("phase_bin"))
    df = all_bins.join(counts, ["target_id", "phase_bin"], "left").na.fill(0)
    removed = F.col("nonfinite") + F.col("clipped")
    return df.select("target_id", "phase_bin", "cadences", "nonfinite", "clipped", removed.alias("removed"), F.when(F.col("cadences") > 0, removed / F.col("cadences")).otherwise(0.0).alias("removed_fraction"))


def chronological_split(cadences: DataFrame, fraction: float) -> DataFrame:
    """cadences with is_training: those up to a share of the time span of their target, whatever their number."""
    own = W.partitionBy("target_id")
    low, high = F.min("time").over(own), F.max("time").over(own)
    df = cadences.withColumn("split_time", low + fraction * (high - low))
    return df.withColumn("is_training", F.col("time") <= F.col("split_time"))


def split_summary(split: DataFrame) -> DataFrame:
    train: Column = F.col("is_training")
    before, after = F.max(F.when(train, F.col("time"))), F.min(F.when(~train, F.col("time")))
    return split.groupBy("target_id").agg(
        F.first("split_time").alias("split_time"), F.min(F.when(train, F.col("time"))).alias("training_min"), before.alias("training_max"),
        after.alias("holdout_min"), F.max(F.when(~train, F.col("time"))).alias("holdout_max"),
        F.count_if(train).alias("training_count"), F.count_if(~train).alias("holdout_count"), (after - before).alias("gap_across_split"),
    )


def repaired_errors(cadences: DataFrame, *by: str) -> DataFrame:
    """cadences whose flux_err is that of the median of usable ones over the columns `by` where it is null, not finite
    or not positive; 1 where none is usable."""
    good = finite("flux_err") & (F.col("flux_err") > 0)
    fill = F.median(F.when(good, F.col("flux_err"))).over(W.partitionBy(*by))
    return cadences.withColumn("flux_err", F.when(good, F.col("flux_err")).otherwise(F.coalesce(fill, F.lit(1.0))))


def scaled(cadences: DataFrame, *by: str) -> DataFrame:
    """cadences with flux over its median over the columns `by`, and flux_err over the size of that; a median that is
    null or zero leaves both as they are."""
    median = F.median("flux").over(W.partitionBy(*by))
    scale = F.when(finite("_scale") & (F.col("_scale") != 0), F.col("_scale")).otherwise(1.0)
    df = cadences.withColumn("_scale", median)
    return df.withColumns({"flux": F.col("flux") / scale, "flux_err": F.col("flux_err") / F.abs(scale)}).drop("_scale")


def observations(cadences: DataFrame) -> DataFrame:
    """Observations of each target from its products: finite cadences, errors repaired and flux normalised by product,
    then scaled to the median of the target."""
    df = scaled(repaired_errors(cadences, "target_id", "product_id").where(finite("time", "flux")), "target_id", "product_id")
    return scaled(df, "target_id")
