"""Selecting event windows by coverage alone, with an audit of every predicted event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ephemeris import Ephemeris, windows

HALF_WIDTH, PERIOD_CAP, INNER = 3.0, 0.49, 0.75
MIN_IN, MIN_SIDE, MIN_PRE, MIN_POST = 3, 1, 8, 8
#: Names of the reasons for which an event is left out; fixed values.
REASONS = (
    "too_few_expected_in_transit_points", "missing_pre_midpoint_in_transit_point", "missing_post_midpoint_in_transit_point",
    "too_few_pre_transit_baseline_points", "too_few_post_transit_baseline_points", "gap_through_expected_transit",
)


def half_width(e: Ephemeris) -> float:
    return min(HALF_WIDTH * e.duration, PERIOD_CAP * e.period)


def window_audit(cadences: DataFrame, e: Ephemeris) -> DataFrame:
    """One row per predicted event: counts by part of the window, gaps, source products by falling frequency, and why
    the event is left out, if it is. Ties of products go by their first time, then by name."""
    h = half_width(e)
    by = ["target_id", "cycle", "event_number", "center"]
    near = windows(cadences, e, h)
    o = F.col("offset")
    no = lambda c: F.coalesce(c, F.lit(False))
    inside, pre, post = no(F.abs(o) <= e.duration / 2), no(o <= -INNER * e.duration), no(o >= INNER * e.duration)
    times = W.partitionBy(*by).orderBy("time", "cadence_id")
    near = near.withColumn("is_in", inside)
    near = near.withColumn("step", F.col("time") - F.lag("time").over(times))
    near = near.withColumn("in_step", F.when(F.col("is_in"), F.col("time") - F.max(F.when(F.col("is_in"), F.col("time"))).over(times.rowsBetween(W.unboundedPreceding, -1))))
    per_product = near.groupBy(*by, "product_id").agg(
        F.count("time").alias("n"), F.count_if("is_in").alias("n_in"), F.count_if(F.col("is_in") & (o < 0)).alias("n_left"), F.count_if(F.col("is_in") & (o >= 0)).alias("n_right"),
        F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post"), F.max("step").alias("gap"), F.max("in_step").alias("in_gap"), F.min("time").alias("seen"),
    )
    named = F.when(F.col("product_id").isNotNull(), F.struct((-F.col("n")).alias("n"), "seen", F.col("product_id").alias("p")))
    audit = per_product.groupBy(*by).agg(
        *(F.sum(c).alias(c) for c in ("n", "n_in", "n_left", "n_right", "n_pre", "n_post")), F.max("gap").alias("largest_gap"), F.max("in_gap").alias("in_transit_gap"),
        F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: x["p"]), ";").alias("source_products"),
    )
    failed = [F.col("n_in") < MIN_IN, F.col("n_left") < MIN_SIDE, F.col("n_right") < MIN_SIDE, F.col("n_pre") < MIN_PRE, F.col("n_post") < MIN_POST, no(F.col("in_transit_gap") > e.duration / 2)]
    reasons = F.array_join(F.array(*(F.when(c, F.lit(r)) for c, r in zip(failed, REASONS))), ";")
    return audit.withColumn("exclusion_reasons", reasons).withColumn("included", F.col("exclusion_reasons") == "")


def exclusion_counts(audit: DataFrame) -> DataFrame:
    return audit.where("not included").select(F.explode(F.split("exclusion_reasons", ";")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def accepted_cadences(cadences: DataFrame, e: Ephemeris, audit: DataFrame | None = None) -> DataFrame:
    """Cadences of included events with event_number, center and offset."""
    audit = window_audit(cadences, e) if audit is None else audit
    near = windows(cadences, e, half_width(e)).where("cadence_id is not null")
    return near.join(audit.where("included").select("target_id", "cycle"), ["target_id", "cycle"], "left_semi")
