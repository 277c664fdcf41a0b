"""Packing documents into training sequences by hierarchical best-fit.

Each partition packs its own pieces by best-fit in descending length. Sequences that are nearly full are done; the
others become items of the next round, on an eighth of the partitions, where best-fit puts them together, or takes
them apart if their pieces then need fewer sequences, and so on up the tree. A sequence travels as one row that holds its members, so no round joins anything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, staged, table
from .token_files import tokenizer_path
from .tokens import tokenizer

LENGTH, END_ID = 1024, 2
#: A sequence with at most so many free places is done.
SLACK = 4
#: Pieces, and sequences, that one task packs together at most, and how many partitions meet in one of the next round.
BLOCK, MERGED, FAN_IN = 200_000, 20_000, 8

PIECE = [pa.field("doc_id", pa.int64()), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
SCHEMA = "sequence_id long, fill int, members array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long{}>>"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: best-fit in descending size, ties by position. A bit set knows which free sizes exist."""
    bins = np.empty(len(sizes), "int64")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, n = 0, 0
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        if fits := there >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                there &= ~(1 << left)
            left -= size
        else:
            b, n, left = n, n + 1, capacity - size
        bins[i] = b
        free[left].append(b)
        there |= 1 << left
    return bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are full."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def _joined(sizes: np.ndarray, lists: pa.ListArray, capacity: int, first_id: int) -> pa.RecordBatch:
    """Packs rows, each a list of members of a total size, into rows of the same form."""
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    counts = np.bincount(bins, weights=np.diff(lists.offsets.to_numpy())).astype("int64") if len(bins) else np.empty(0, "int64")
    fill = np.bincount(bins, weights=sizes).astype("int32") if len(bins) else np.empty(0, "int32")
    members = lists.take(pa.array(order)).flatten()
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype("int32"))
    return pa.RecordBatch.from_arrays([pa.array(first_id + np.arange(len(fill))), pa.array(fill), pa.ListArray.from_arrays(offsets, members)], ["sequence_id", "fill", "members"])


def _first_id(round_: int) -> int:
    return (round_ << 56) | (TaskContext.get().partitionId() << 32)


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = LENGTH, end_id: int = END_ID, slack: int = SLACK, with_ids: bool = False) -> DataFrame:
    """(sequence_id, fill, members) of docs(doc_id, text): members in order, each (doc_id, piece, start, length, ids_crc32[, ids]).

    A document is its ids and the end id. One longer than the capacity is cut into full pieces, of which only the
    first may be shorter; others stay whole. Null texts are empty (the end id alone), null doc_ids and repeated rows
    are packed like any other. No documents: no sequences. The number of sequences depends on the partitions a
    little, what is packed never does.
    """
    fields = [*PIECE, *([pa.field("ids", pa.list_(pa.int32()))] if with_ids else [])]
    schema = SCHEMA.format(", ids: array<int>" if with_ids else "")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, at = tokenizer(tokenizer_file), np.array([end_id], "<u4").tobytes(), _first_id(0)
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal at, held
            columns = list(zip(*held)) or [[]] * len(fields)
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
            sizes = flat.field("length").to_numpy()
            out = _joined(sizes, pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype="int32")), flat), capacity, at)
            at, held = at + len(out), []
            return out

        for b in sliced(batches):
            keys = b.column("doc_id").to_pylist()
            for key, ids in zip(keys, own.encode([t or "" for t in b.column("text").to_pylist()])):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    held.append((key, k, start, length, zlib.crc32(part)) + ((np.frombuffer(part, "<i4"),) if with_ids else ()))
            if len(held) >= BLOCK:
                yield packed()
        yield packed()

    def again(round_: int):
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, n = _first_id(round_), [], 0

            def packed() -> pa.RecordBatch:
                nonlocal at, held, n
                t = pa.Table.from_batches(held).combine_chunks()
                lists = t.column("members").chunk(0) if len(t) else pa.array([], t.schema.field("members").type)
                sizes, flat = t.column("fill").to_numpy().astype("int64"), lists.flatten()
                alone = flat.field("length").to_numpy() if len(flat) else np.empty(0, "int64")
                if len(t) and best_fit(alone, capacity).max() < best_fit(sizes, capacity).max():  # sequences that fit better when taken apart
                    sizes, lists = alone, pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype="int32")), flat)
                out = _joined(sizes, lists, capacity, at)
                at, held, n = at + len(out), [], 0
                return out

            for b in batches:
                held.append(b)
                n += len(b)
                if n >= MERGED:
                    yield packed()
            if n:
                yield packed()

        return merged

    done = []
    rows = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tokenised, schema))
    parts, round_, before = rows.rdd.getNumPartitions(), 0, None
    while True:
        done.append(rows.where(F.col("fill") >= capacity - slack))
        open_ = rows.where(F.col("fill") < capacity - slack)
        count = open_.count()
        least = max(1, -(-count // MERGED))
        if count <= 1 or (before is not None and before <= least):  # one row, or the top of the tree was packed
            done.append(open_)
            break
        before, round_ = max(least, -(-parts // FAN_IN)), round_ + 1
        parts = before
        rows = staged(open_.repartition(parts).mapInArrow(again(round_), schema))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def placed(sequences: DataFrame) -> DataFrame:
    """One row per piece: its sequence and the place in it."""
    lengths = F.col("members.length")
    return sequences.select("sequence_id", F.posexplode("members").alias("at", "m"), lengths.alias("lengths")).select(
        "m.*", "sequence_id", F.aggregate(F.slice("lengths", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, x: a + x).alias("offset")
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece of a document: its sequence and the place in it. Null and empty texts are the end id alone."""
    return placed(pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
