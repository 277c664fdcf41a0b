"""Checks of a frozen snapshot of accepted cadences before sampling: violations are counted, one aggregate a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ephemeris import Ephemeris, center, finite


def violations(accepted: DataFrame) -> DataFrame:
    """Per target, rows that break a rule of accepted(target_id, time, flux, flux_err, event_number, center, product_id)."""
    return accepted.groupBy("target_id").agg(
        F.count("*").alias("n"), F.count_if(~finite("time", "flux", "flux_err", "center")).alias("not_finite"), F.count_if(F.coalesce(F.col("flux_err") <= 0, F.lit(True))).alias("not_positive"),
        F.count_if(F.trim(F.coalesce("product_id", F.lit(""))) == "").alias("blank_product"), F.count_if(F.col("event_number") < 0).alias("negative_event"),
    )


def duplicate_keys(accepted: DataFrame) -> DataFrame:
    return accepted.groupBy("target_id", "event_number", "product_id", "time").agg(F.count("*").alias("n")).where("n > 1")


def center_checks(accepted: DataFrame, events: DataFrame, e: Ephemeris) -> DataFrame:
    """Per accepted event, whether its center is one value, that of the predicted event, and that of the ephemeris."""
    own = accepted.groupBy("target_id", "event_number").agg(F.min("center").alias("low"), F.max("center").alias("high"))
    both = own.join(events.select("target_id", "event_number", "cycle", F.col("center").alias("predicted")), ["target_id", "event_number"], "left")
    return both.select(
        "target_id", "event_number", (F.col("high") - F.col("low") <= 1e-9).alias("constant"), F.coalesce(F.abs(F.col("low") - F.col("predicted")) <= 1e-9, F.lit(False)).alias("predicted"),
        F.coalesce(F.abs(F.col("low") - center(F.col("cycle"), e)) <= 1e-8, F.lit(False)).alias("ephemeris"),
    )


def product_checks(accepted: DataFrame, products: DataFrame) -> DataFrame:
    """Per product, accepted cadences against products(product_id, n_input): null where a side knows nothing of it."""
    used = accepted.groupBy("product_id").agg(F.count("*").alias("n_accepted"))
    return used.join(products, "product_id", "full").withColumn("consistent", F.coalesce(F.col("n_accepted"), F.lit(0)) <= F.coalesce(F.col("n_input"), F.lit(-1)))


def timing_corners(accepted: DataFrame, e: Ephemeris, half_period: float, half_epoch: float) -> DataFrame:
    """Per target and corner of the timing prior, how far its events move from their frozen centers, at most.

    Four corners: a fixed, tiny table that is broadcast to the events.
    """
    spark = accepted.sparkSession
    corners = spark.createDataFrame([(a, b) for a in (-1, 1) for b in (-1, 1)], "period_side int, epoch_side int")
    events = accepted.groupBy("target_id", "event_number", "center").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    df = events.crossJoin(F.broadcast(corners))
    cycle = F.rint((F.col("center") - e.epoch) / e.period)
    moved = F.col("epoch_side") * half_epoch + cycle * F.col("period_side") * half_period
    df = df.withColumn("moved", moved).withColumn("supported", (F.col("center") + F.col("moved") >= F.col("first")) & (F.col("center") + F.col("moved") <= F.col("last")))
    return df.groupBy("target_id", "period_side", "epoch_side").agg(F.count("*").alias("n_events"), F.max(F.abs("moved")).alias("largest_move"), F.count_if("supported").alias("n_supported"))


def upsert(index: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """index with rows put in by key: a row replaces the one of its key. Keys are taken to be unique on either side."""
    kept = index.join(rows.select(*key).distinct(), list(key), "left_anti").select(index.columns)
    return kept.unionByName(rows.select(index.columns))


def compared(found: DataFrame, reference: DataFrame, *columns: str) -> DataFrame:
    """By target_id, each column of found beside that of a reference, its difference, and that as a share of the latter."""
    df = found.select("target_id", *columns).join(reference.select("target_id", *(F.col(c).alias(f"{c}_reference") for c in columns)), "target_id")
    gap = lambda c: F.col(c) - F.col(f"{c}_reference")
    return df.select("*", *(gap(c).alias(f"{c}_difference") for c in columns), *(F.try_divide(gap(c), F.abs(f"{c}_reference")).alias(f"{c}_share") for c in columns))


#: Share of the period by which it may be off at most, and of the largest offset that keeps events in their windows.
PERIOD_SHARE, GUARD = 0.02, 0.95


def timing_support(accepted: DataFrame, e: Ephemeris, epoch_scale: float = 0.5) -> DataFrame:
    """Per target of accepted(target_id, cycle, center, time): (mid_cycle, mid_epoch, epoch_half_width, period_half_width,
    n_events, n_beyond, supported).

    The epoch is that of the event nearest to the median time, and may move by epoch_scale durations. The period may move
    by so much that no event leaves the edge of its window nearest to it, less GUARD, and by a share of itself or a
    duration at most. n_beyond counts events whose window the epoch alone leaves; with any, or with no other event than
    the middle one, nothing is supported and the period's half-width is null.
    """
    middle = accepted.groupBy("target_id").agg(F.rint((F.percentile("time", F.lit(0.5)) - e.epoch) / e.period).cast("long").alias("mid_cycle"))
    events = accepted.groupBy("target_id", "cycle").agg(F.percentile("center", F.lit(0.5)).alias("center"), F.min("time").alias("first"), F.max("time").alias("last"))
    room = F.least(F.col("center") - F.col("first"), F.col("last") - F.col("center")) - epoch_scale * e.duration
    away = F.abs(F.col("cycle") - F.col("mid_cycle"))
    df = events.join(middle, "target_id").withColumn("room", room).groupBy("target_id", "mid_cycle").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("room") <= 0).alias("n_beyond"), F.min(F.when(away > 0, F.col("room") / away)).alias("least")
    )
    ok = (F.col("n_beyond") == 0) & F.col("least").isNotNull()
    return df.select(
        "target_id", "mid_cycle", center(F.col("mid_cycle"), e).alias("mid_epoch"), F.lit(epoch_scale * e.duration).alias("epoch_half_width"),
        F.when(ok, F.least(F.lit(max(PERIOD_SHARE * e.period, e.duration)), GUARD * F.col("least"))).alias("period_half_width"), "n_events", "n_beyond", ok.alias("supported"),
    )
