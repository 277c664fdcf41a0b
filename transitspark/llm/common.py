"""Helpers that the training-data operators share: table paths, the shared folder, distributed connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, a local master gets a temporary folder (tests); a cluster gets an error,
    because no other folder is known to be shared.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="transitspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it again: cuts lineage, and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What this Python worker keeps from one task to the next, by name, and how it lets go of it.
_kept: dict[str, Callable[[], None]] = {}


def forget_others(name: str = "", forget: Callable[[], None] | None = None) -> None:
    """A worker serves one operator after the other; what it remembers for an earlier one goes, all but `name`."""
    gone = [k for k in _kept if k != name]
    for k in gone:
        _kept.pop(k)()
    if gone:
        give_back()
    if forget:
        _kept[name] = forget


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the C library can do that."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows each, so that a worker holds few texts as Python objects at a time."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text: the folds of the labelled rows are its remainders."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most `rows` labelled documents, the same ones on every run.

    Ids are chosen in the narrow label table by a hash, so what is broadcast to the documents holds `rows` ids at most.
    Several labels of one id: the largest counts; several texts: the least in order. Null ids, labels and texts are
    passed over.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & may_learn)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


#: A node that has more than this share of all links is dealt over several tasks.
HUB = 1 / 500


def with_least(rows: DataFrame, least: DataFrame, limit: int, *more: str) -> DataFrame:
    """rows(a, b, more) with m of least(a, m, n), n the number of rows of a; rows whose a is not there go.

    Rows of a node with more than `limit` of them are dealt by salts, so no task gets a hub whole. There are at most
    2 / HUB such nodes, whatever the size: that bounds what is broadcast.
    """
    hubs = F.broadcast(least.where(F.col("n") > limit).select(F.col("a").alias("hub"), F.floor(F.col("n") / limit + 1).alias("salts")))
    salted = rows.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "b", *more, F.coalesce(F.pmod(F.xxhash64("b"), "salts"), F.lit(0)).alias("salt"))
    dealt = least.join(hubs, F.col("a") == F.col("hub"), "left").select("a", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(dealt, ["a", "salt"]).select("a", "b", *more, "m")


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that links reach, for each node of edges(a, b: long); null ends are left out.

    Alternates two kinds of round until nothing changes: every node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows (the large-star and small-star operations of Kiveris et al., 2014). A round
    is two aggregates and two joins on the node, hubs salted. Rounds are written to the shared folder; only two sums
    per round reach the driver.
    """

    def directed(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def measure(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def large_star(e: DataFrame, limit: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        return directed(with_least(both.where("b > a"), least, limit).select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small_star(e: DataFrame, limit: int) -> DataFrame:
        least = e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hooked = with_least(e, least, limit).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return directed(hooked.unionByName(least.select("a", F.col("m").alias("b"))))

    edges = staged(directed(edges.select("a", "b")))
    before = measure(edges)
    for _ in range(max_rounds if before[0] else 0):
        limit = max(1, int(HUB * before[0]))
        edges = staged(small_star(large_star(edges, limit), limit))
        after = measure(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name like `name` that docs has no column of, whatever the case."""
    there = {c.lower() for c in docs.columns}
    while name.lower() in there:
        name += "_"
    return name
