"""Per-event diagnostics of a candidate: local depths, odd against even events, chronological holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ephemeris import Ephemeris, windows
from .recovery import snr

#: Smallest numbers of cadences inside and in the baseline of a usable event; the baseline's edges in durations.
MIN_IN, MIN_BASE, INNER, OUTER = 1, 2, 1.0, 3.0
RATIO, MIN_SCATTER, SIGMA = 2.0, 1.0, 3.0


def _sides(e: Ephemeris):
    distance = F.abs("offset")
    return F.coalesce(distance <= e.duration / 2, F.lit(False)), F.coalesce((distance > INNER * e.duration) & (distance <= OUTER * e.duration), F.lit(False))


def largest_gap(df: DataFrame, condition, *by: str) -> DataFrame:
    """(by, gap): the largest step between neighbouring times among rows that meet a condition."""
    own = W.partitionBy(*by).orderBy("time", "cadence_id")
    steps = df.where(condition).withColumn("step", F.col("time") - F.lag("time").over(own))
    return steps.groupBy(*by).agg(F.max("step").alias("gap"))


def event_diagnostics(cadences: DataFrame, e: Ephemeris) -> DataFrame:
    """One row per predicted event, those without cadences included; depth is null where coverage is too thin.

    The step to the cadence before is taken in a window over the key of the aggregate, so both share one shuffle.
    """
    df = windows(cadences, e, OUTER * e.duration)
    inside, base = _sides(e)
    by = ["target_id", "cycle", "event_number", "center"]
    df = df.withColumn("step", F.col("time") - F.lag("time").over(W.partitionBy(*by).orderBy("time", "cadence_id")))
    out = df.groupBy(*by).agg(
        F.count_if(inside).alias("n_in"), F.count_if(base).alias("n_base"), F.median(F.when(inside, F.col("flux"))).alias("flux_in"),
        F.median(F.when(base, F.col("flux"))).alias("flux_base"), F.max("step").alias("nearby_gap"),
    )
    out = out.withColumn("usable", (F.col("n_in") >= MIN_IN) & (F.col("n_base") >= MIN_BASE))
    return out.withColumn("depth", F.when(F.col("usable"), F.col("flux_base") - F.col("flux_in"))).withColumn("parity", F.when(F.col("event_number") % 2 == 1, "odd").otherwise("even"))


def candidate_events(cadences: DataFrame, candidates: DataFrame, *by: str) -> DataFrame:
    """event_diagnostics of candidates(target_id, by, period, duration, transit_time), each with an ephemeris of its own;
    the columns `by` tell those of one target apart. Events without cadences near them have no row.

    Cadences meet the candidates of their target, and their events by arithmetic on the cycle.
    """
    span = cadences.groupBy("target_id").agg(F.min("time").alias("_t_min"), F.max("time").alias("_t_max"))
    p, t0, d = F.col("period"), F.col("transit_time"), F.col("duration")
    first, last = F.ceil((F.col("_t_min") - t0) / p), F.floor((F.col("_t_max") - t0) / p)
    named = candidates.where("period > 0").select("target_id", *by, "period", "duration", "transit_time").join(span, "target_id").withColumns({"_first": first, "_last": last})
    df = cadences.select("target_id", "time", "flux").join(named, "target_id")
    low, high = F.greatest(F.ceil((F.col("time") - OUTER * d - t0) / p), F.col("_first")), F.least(F.floor((F.col("time") + OUTER * d - t0) / p), F.col("_last"))
    df = df.withColumn("cycle", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    distance = F.abs(F.col("time") - (t0 + F.col("cycle") * p))
    inside, base = distance <= d / 2, (distance > INNER * d) & (distance <= OUTER * d)
    out = df.groupBy("target_id", *by, "cycle", (F.col("cycle") - F.col("_first")).alias("event_number")).agg(
        F.count_if(inside).alias("n_in"), F.count_if(base).alias("n_base"), F.median(F.when(inside, F.col("flux"))).alias("flux_in"), F.median(F.when(base, F.col("flux"))).alias("flux_base")
    )
    out = out.withColumn("usable", (F.col("n_in") >= MIN_IN) & (F.col("n_base") >= MIN_BASE))
    return out.withColumn("depth", F.when(F.col("usable"), F.col("flux_base") - F.col("flux_in"))).withColumn("parity", F.when(F.col("event_number") % 2 == 1, "odd").otherwise("even"))


def odd_even(events: DataFrame, *by: str) -> DataFrame:
    """Per target and the columns `by`, the depths of odd and even events and whether they differ more than chance allows."""
    usable, odd = F.col("usable"), F.col("parity") == "odd"
    df = events.groupBy("target_id", *by).agg(
        F.count("*").alias("n_events"), F.count_if(usable & odd).alias("n_odd"), F.count_if(usable & ~odd).alias("n_even"),
        F.median(F.when(odd, F.col("depth"))).alias("odd_depth"), F.median(F.when(~odd, F.col("depth"))).alias("even_depth"),
        F.when(F.count("depth") > 1, F.stddev_pop("depth")).alias("scatter"),
    )
    difference = F.abs(F.col("odd_depth") - F.col("even_depth"))
    least, most = F.least(F.abs("odd_depth"), F.abs("even_depth")), F.greatest(F.abs("odd_depth"), F.abs("even_depth"))
    floor = F.greatest(F.lit(1e-12), 1e-3 * F.abs(F.coalesce("scatter", F.lit(0.0))))
    df = df.withColumn("difference", F.when(F.col("odd_depth").isNotNull() & F.col("even_depth").isNotNull(), difference))
    df = df.withColumn("ratio", F.when(F.col("difference").isNotNull() & (least > floor), most / least))
    by_ratio = (F.col("ratio") >= RATIO) & (F.col("difference") >= MIN_SCATTER * F.col("scatter"))
    trigger = F.when(F.col("scatter") > 0, F.when(by_ratio, "ratio_and_absolute_difference").when(F.col("difference") >= SIGMA * F.col("scatter"), "absolute_difference_only"))
    return df.withColumn("trigger", F.coalesce(trigger, F.lit("none")))


def holdout(cadences: DataFrame, e: Ephemeris, step: float = 0.0) -> DataFrame:
    """Per target, the dip in cadences that were kept back, pooled over usable events; cadences of two events count twice.

    step: how far the period may be off; drift is what that adds up to over the time kept back.
    """
    df = windows(cadences, e, OUTER * e.duration)
    inside, base = _sides(e)
    own = W.partitionBy("target_id", "cycle")
    df = df.withColumns({"is_in": inside, "is_base": base})
    df = df.withColumn("usable", (F.count_if("is_in").over(own) >= MIN_IN) & (F.count_if("is_base").over(own) >= MIN_BASE))
    i, b = F.when(F.col("usable") & F.col("is_in"), F.col("flux")), F.when(F.col("usable") & F.col("is_base"), F.col("flux"))
    out = df.groupBy("target_id").agg(
        F.count_distinct("cycle").alias("n_events"), F.count_distinct(F.when(F.col("usable"), F.col("cycle"))).alias("n_usable"), F.median(i).alias("flux_in"), F.median(b).alias("flux_base"),
        F.stddev_pop(b).alias("scatter"), F.count(i).alias("n_in"), F.count(b).alias("n_base"),
    )
    out = out.withColumn("depth", F.col("flux_base") - F.col("flux_in"))
    span = cadences.groupBy("target_id").agg((F.max("time") - F.min("time")).alias("_span"))
    out = out.join(span, "target_id", "left").withColumn("drift", F.abs(F.lit(step)) * F.col("_span") / e.period).drop("_span")
    out = out.withColumn("drift_of_duration", F.col("drift") / e.duration)
    return out.withColumn("snr", F.when(F.col("n_usable") > 0, snr(F.col("depth"), F.col("scatter"), F.nullif(F.col("n_in"), F.lit(0)), F.nullif(F.col("n_base"), F.lit(0)))))
