"""Phases, windows and predicted events of a periodic dip, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ephemeris:
    """Days: period, time of a dip, and its length."""

    period: float
    epoch: float
    duration: float


def phase(time: Column, e: Ephemeris) -> Column:
    """Days from the nearest predicted dip, in [-period / 2, period / 2)."""
    return F.pmod(time - F.lit(e.epoch) + F.lit(e.period / 2), F.lit(e.period)) - F.lit(e.period / 2)


def in_window(time: Column, e: Ephemeris, scale: float = 1.0) -> Column:
    return F.abs(phase(time, e)) <= scale * e.duration / 2


def center(cycle: Column, e: Ephemeris) -> Column:
    return F.lit(e.epoch) + cycle * F.lit(e.period)


def finite(*columns: str) -> Column:
    ok = F.lit(True)
    for c in columns:
        x = F.col(c)
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def predicted_events(cadences: DataFrame, e: Ephemeris) -> DataFrame:
    """(target_id, cycle, event_number, center): every predicted dip within the times that a target was observed."""
    span = cadences.groupBy("target_id").agg(F.min("time").alias("t_min"), F.max("time").alias("t_max"))
    first, last = F.ceil((F.col("t_min") - e.epoch) / e.period), F.floor((F.col("t_max") - e.epoch) / e.period)
    cycles = span.select("target_id", first.alias("first"), last.alias("last")).where("last >= first")  # a sequence would run backwards
    return cycles.select("target_id", "first", F.explode(F.sequence("first", "last")).alias("cycle")).select(
        "target_id", "cycle", (F.col("cycle") - F.col("first")).alias("event_number"), center(F.col("cycle"), e).alias("center")
    )


def near_events(cadences: DataFrame, e: Ephemeris, half_width: float) -> DataFrame:
    """cadences with the cycle of every predicted dip within half_width of them (several if windows overlap), by
    arithmetic: a range join would compare each cadence with each event."""
    low, high = F.ceil((F.col("time") - half_width - e.epoch) / e.period), F.floor((F.col("time") + half_width - e.epoch) / e.period)
    near = cadences.withColumn("cycle", F.explode(F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    near = near.withColumn("offset", F.col("time") - center(F.col("cycle"), e))
    return near.where(F.abs("offset") <= half_width)


def windows(cadences: DataFrame, e: Ephemeris, half_width: float) -> DataFrame:
    """Predicted events with the cadences around them; an event without any keeps one row of nulls."""
    return predicted_events(cadences, e).join(near_events(cadences, e, half_width), ["target_id", "cycle"], "left")
