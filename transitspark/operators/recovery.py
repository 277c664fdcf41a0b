"""Does a known periodic dip show up? Summaries, folded and windowed recovery, binned curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ephemeris import Ephemeris, in_window, near_events, phase, predicted_events


def summarize(cadences: DataFrame, *by: str) -> DataFrame:
    return cadences.groupBy(*by).agg(
        F.count("*").alias("n_cadences"), F.min("time").alias("time_min"), F.max("time").alias("time_max"), F.median("flux").alias("flux_median"), F.stddev_pop("flux").alias("flux_std")
    )


def snr(depth: Column, scatter: Column, n_in: Column, n_out: Column) -> Column:
    """Depth over its uncertainty; without scatter null, but zero where there is no depth. A depth without scatter has no
    bound, which the column snr_unbounded of results says."""
    error = scatter * F.sqrt(1 / n_in + 1 / n_out)
    return F.when(error > 0, F.try_divide(depth, error)).when(depth <= 0, F.lit(0.0))


def _depths(df: DataFrame, value: str, inside: Column, outside: Column, *by: str) -> DataFrame:
    stats = df.groupBy(*by).agg(
        F.count_if(inside).alias("n_in"), F.count_if(outside).alias("n_out"), F.median(F.when(inside, F.col(value))).alias("flux_in"),
        F.median(F.when(outside, F.col(value))).alias("flux_out"), F.stddev_pop(F.when(outside, F.col(value))).alias("scatter_out"),
    ).where("n_in > 0 and n_out > 1")
    stats = stats.withColumn("depth", F.col("flux_out") - F.col("flux_in"))
    stats = stats.withColumn("snr", snr(F.col("depth"), F.col("scatter_out"), F.col("n_in"), F.col("n_out")))
    return stats.withColumn("snr_unbounded", F.coalesce((F.col("scatter_out") == 0) & (F.col("depth") > 0), F.lit(False)))


def unique_or_null(column: str) -> Column:
    """The value of a group that has just one, else null; nulls don't count."""
    return F.when(F.count_distinct(column) == 1, F.max(column))


def known_signal(cadences: DataFrame, e: Ephemeris, scale: float = 1.0) -> DataFrame:
    """Per target, the dip at a known period: medians inside and outside its window. Targets without both are left out."""
    inside = in_window(F.col("time"), e, scale)
    return _depths(cadences, "flux", inside, ~inside, "target_id")


def windowed_signal(cadences: DataFrame, e: Ephemeris, half_width: float, scale: float = 1.25, baseline_scale: float = 2.0) -> DataFrame:
    """Per target, the dip stacked from windows around its events, each divided by the median of its own wings.

    A window counts with 10 cadences, one inside and four in the wings. Cadences meet events by arithmetic on the
    cycle; the wings' median is a window over the key that they were joined by.
    """
    near = near_events(cadences, e, half_width).join(predicted_events(cadences, e).select("target_id", "cycle"), ["target_id", "cycle"])
    inside, wing = F.abs("offset") <= scale * e.duration / 2, F.abs("offset") > baseline_scale * e.duration / 2
    own = W.partitionBy("target_id", "cycle")
    near = near.withColumns({
        "n": F.count("*").over(own), "n_inside": F.count_if(inside).over(own), "n_wing": F.count_if(wing).over(own), "wing": F.median(F.when(wing, F.col("flux"))).over(own),
    })
    used = near.where("n >= 10 and n_inside >= 1 and n_wing >= 4 and wing <> 0").withColumn("relative", F.col("flux") / F.col("wing"))
    count = used.groupBy("target_id").agg(F.count_distinct("cycle").alias("n_windows"))
    return _depths(used, "relative", inside, wing, "target_id").join(count, "target_id")


def binned_curve(cadences: DataFrame, e: Ephemeris, bins: int) -> DataFrame:
    """Per target, mean phase and flux in equal bins from the least to the largest phase; the largest is in no bin."""
    own = W.partitionBy("target_id")
    df = cadences.withColumn("phase", phase(F.col("time"), e))
    df = df.withColumns({"low": F.min("phase").over(own), "high": F.max("phase").over(own)})
    df = df.withColumn("bin", F.floor((F.col("phase") - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int")) if bins else df
    return df.where(f"high > low and bin < {bins}").groupBy("target_id", "bin").agg(F.avg("phase").alias("phase_mean"), F.avg("flux").alias("flux_mean"), F.count("*").alias("n"))
