"""Places and quantiles of rows in keys of any size: no task holds a key, so a chain may be as long as the table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written

#: Distinct values of a key that one aggregate may hold to find its quantiles.
FEW_VALUES = 100_000
#: Draws that one row of arrays holds.
SEGMENT = 16_384
#: Draws in arrays that a task has begun.
HELD = 64 * SEGMENT


def alike(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys in which null is equal to null."""
    right = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    return left.join(right, reduce(and_, (F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys), F.lit(True)), how).drop(*(f"_right_{k}" for k in keys))


def numbered(rows: DataFrame, chain: list[str], *order: str) -> DataFrame:
    """rows with _place, from 0 in their chain by the columns `order`, and _n, the rows of the chain.

    Rows are dealt by ranges of chain and order and numbered within a range, on top of what the ranges before hold of
    the chain: one row for each range and chain.
    """
    dealt = written(rows.repartitionByRange(*chain, *order).sortWithinPartitions(*chain, *order).withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_range", F.shiftright("_id", 33))
    spans = dealt.groupBy(*chain, "_range").agg(F.min("_id").alias("_first"), F.count("*").alias("_here"))
    own = W.partitionBy(*chain)
    before = F.coalesce(F.sum("_here").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = written(spans.select(*chain, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_here").over(own).alias("_n")))
    return alike(dealt, spans, [*chain, "_range"]).withColumn("_place", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_shift")


def _runs(batch: pa.RecordBatch, chain: list[str]) -> np.ndarray:
    """Where runs of rows of one chain begin in a batch, and where the last one ends."""
    new = np.arange(batch.num_rows) == 0
    for c in chain:
        a, b = batch.column(c)[1:], batch.column(c)[:-1]
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), batch.num_rows)


def pieces(rows: DataFrame, chain: list[str], order: list[str], value: str, most: int = SEGMENT) -> DataFrame:
    """(chain, _range, _piece, n, values): the values of each chain in order, in arrays of up to `most` that follow each
    other by (_range, _piece); written once.

    Rows are dealt by ranges of a hash of the chain and of order, and sorted by order alone, which is seldom equal; a task
    tells chains apart as it reads, and holds open arrays of HELD values, never a chain. What works on arrays afterwards
    moves eight bytes a row.
    """
    kinds = dict(rows.dtypes)
    dealt = rows.select(*dict.fromkeys([*chain, *order, value]), F.xxhash64(*chain).alias("_hash"))
    dealt = dealt.repartitionByRange("_hash", *order).sortWithinPartitions(*order, "_hash")
    dealt = dealt.select(*chain, F.spark_partition_id().alias("_range"), F.col(value).cast("double").alias("values"), "_hash")
    names = [*chain, "_range", "_piece", "n", "values"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, piece = {}, 0, 0

        def table(done: list[tuple]) -> pa.RecordBatch:
            sizes = [len(x) for _, x in done]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.concat_arrays([x for _, x in done]))
            keys = [pa.concat_arrays([k[i] for k, _ in done]) for i in range(len(chain) + 1)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(range(piece, piece + len(done)), pa.int64()), pa.array(sizes, pa.int64()), lists], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column("_hash").to_numpy(), kind="stable")))
            ends, done = _runs(batch, chain), []
            for begin, end in zip(ends[:-1], ends[1:]):
                own = [batch.column(c)[begin : begin + 1] for c in [*chain, "_range"]]
                key = tuple(x[0].as_py() for x in own)
                parts = held.setdefault(key, (own, []))[1]
                parts.append(batch.column("values")[begin:end])
                total += end - begin
                if sum(map(len, parts)) >= most:
                    x = pa.concat_arrays(parts)
                    full = len(x) // most * most
                    done += [(own, x[i : i + most]) for i in range(0, full, most)]
                    parts[:] = [x[full:]] if full < len(x) else []
                    total -= full
            if total > HELD:
                done += [(own, pa.concat_arrays(parts)) for own, parts in held.values() if parts]
                held, total = {}, 0
            if done:
                yield table(done)
                piece += len(done)
        done = [(own, pa.concat_arrays(parts)) for own, parts in held.values() if parts]
        if done:
            yield table(done)

    return written(dealt.mapInArrow(cut, ", ".join(f"`{c}` {kinds[c]}" for c in chain) + ", _range int, _piece long, n long, values array<double>"))


def placed(cut: DataFrame, chain: list[str]) -> DataFrame:
    """pieces with _start, the place of their first value in the chain, and _n, the values of the chain. Starts are made
    of the pieces' sizes alone."""
    own = W.partitionBy(*chain)
    before = F.coalesce(F.sum("n").over(own.orderBy("_range", "_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cut.select(*chain, "_range", "_piece", "n").select("_range", "_piece", before.alias("_start"), F.sum("n").over(own).alias("_n"))
    return cut.join(written(starts), ["_range", "_piece"])


def running(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counts(keys, value, n) with up_to, the rows of the key up to the value, and total, all of its rows.

    Values are dealt by ranges of key and value; a range's rows count on from those of the ranges before it.
    """
    dealt = written(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    own = W.partitionBy(*keys)
    sizes = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("_here"))
    before = written(sizes.select(*keys, "_range", F.coalesce(F.sum("_here").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_here").over(own).alias("total")))
    up_to = F.sum("n").over(W.partitionBy(*keys, "_range").orderBy(value))
    return alike(dealt.withColumn("_up_to", up_to), before, [*keys, "_range"]).withColumn("up_to", F.col("_before") + F.col("_up_to")).drop("_range", "_before", "_up_to")


def quantiles(counts: DataFrame, keys: list[str], value: str, shares: list[float], few: int = FEW_VALUES) -> DataFrame:
    """(keys, q): quantiles of counts(keys, value, n), interpolated between neighbours as `percentile` does; null values
    don't count, and a key of nothing else is left out.

    Keys of up to `few` distinct values go through `percentile`. Of others no task holds the values: each quantile lies
    between two places, which are looked up in running counts. counts is read several times, so it should be written.
    """
    known = counts.where(F.col(value).isNotNull())
    big = known.groupBy(*keys).agg(F.count("*").alias("_distinct")).where(F.col("_distinct") > few).select(*keys)
    big = F.broadcast(written(big))  # a row for each `few` rows at most
    small = alike(known, big, keys, "left_anti").groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares)), F.col("n")).alias("q"))
    ranked = running(alike(known, big, keys, "left_semi"), keys, value)
    at: list[Column] = [F.lit(p) * (F.col("total") - 1) for p in shares]
    holds = lambda i: (F.col("up_to") - F.col("n") <= i) & (i < F.col("up_to"))
    found = ranked.groupBy(*keys).agg(
        F.max("total").alias("total"), *(F.max(F.when(holds(F.floor(x)), F.col(value))).alias(f"_low{k}") for k, x in enumerate(at)), *(F.max(F.when(holds(F.ceil(x)), F.col(value))).alias(f"_high{k}") for k, x in enumerate(at))
    )
    low, high = (lambda k: F.col(f"_low{k}")), (lambda k: F.col(f"_high{k}"))
    between = [F.when(low(k) == high(k), low(k)).otherwise((F.ceil(x) - x) * low(k) + (x - F.floor(x)) * high(k)) for k, x in enumerate(at)]
    return small.unionByName(found.select(*keys, F.array(*between).alias("q")))
