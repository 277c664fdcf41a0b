"""Document fingerprints from closed syncmers, with DataFrame functions only.

Units are the lower-cased words of a text, or its characters where words are too few or too long to tell texts apart.
A run of K units is chosen when the smallest hash of the single units in it stands at one of its two ends. That
depends on the run alone, not on what surrounds it, so texts that share a passage choose the same runs in it. The
fingerprint is the sorted set of the SKETCH smallest hashes of chosen runs; two fingerprints are as alike as the share
of common hashes among the smallest of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import staged, table

#: Units of a run (a power of two), and hashes of a fingerprint.
K, SKETCH = 8, 64
#: Ids of a run of documents that one window holds.
RUN = 1024
#: Texts of fewer characters, or of more characters a word, are taken by characters.
SHORT, LONG_WORD = 400, 24
BLANK = r"[ \t\n\x0B\f\r]+"


def units(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), BLANK), lambda w: w != "")
    characters = F.split(F.lower(text), "")
    n = F.char_length(text)
    blanks = n - F.char_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))
    return F.when((n < SHORT) | (n > LONG_WORD * (blanks + 1)), characters).otherwise(words)


def _ahead(a: Column, by: int) -> Column:
    """The array from its element number `by` on."""
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def chosen(df: DataFrame, text: str, out: str) -> DataFrame:
    """df and an array column `out` of the hashes of chosen runs in order, repeats included.

    Fewer than K units: one run of them all; no units: none. Steps are columns of their own, so that each array is
    made once.
    """
    h, m = f"{out}_h", f"{out}_m"
    df = df.withColumn(h, F.transform(units(F.col(text)), lambda w: F.xxhash64(w)))
    span = 1
    step = df.withColumn(m, F.col(h))
    while span < K:  # the smallest of the next 2, 4, 8 units
        step = step.withColumn(m, F.zip_with(F.slice(m, F.lit(1), F.greatest(F.size(m) - span, F.lit(0))), _ahead(F.col(m), span), lambda a, b: F.least(a, b)))
        span *= 2
    at_edge = lambda least, i: (F.col(h)[i] == least) | (F.col(h)[i + (K - 1)] == least)
    runs = F.transform(m, lambda least, i: F.when(at_edge(least, i), F.xxhash64(F.slice(h, i + 1, K))))
    few = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    return step.withColumn(out, F.when(F.size(h) < K, few).otherwise(F.filter(runs, lambda r: r.isNotNull()))).drop(h, m)


def sketch(anchors: Column) -> Column:
    """The smallest distinct hashes, as unsigned 32-bit numbers in ascending order."""
    short = F.transform(anchors, lambda r: F.shiftrightunsigned(r, 32))
    return F.slice(F.array_sort(F.array_distinct(short)), 1, SKETCH)


def text_of(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of common hashes among the SKETCH smallest of both; of two empty fingerprints 1."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs and a column fingerprint (array<long>); a null text is empty and has an empty one."""
    df = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    return chosen(df, "_text", "_runs").withColumn("fingerprint", sketch(F.col("_runs"))).drop("_text", "_runs")


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, anchor, at): every chosen run and its number among the chosen ones, for matching passages by place."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return chosen(df, "_text", "_runs").select("doc_id", F.posexplode("_runs").alias("at", "anchor"))


def following(keys: DataFrame, name: str) -> DataFrame:
    """(name, next) of distinct, non-null keys in ascending order; after the last comes the first.

    Keys are dealt by ranges and numbered by range. A window within each range gives most successors; the last of a
    range gets the least key of the next one, from one row per range.
    """
    ranged = staged(keys.select(name).distinct().repartitionByRange(name).select(name, F.spark_partition_id().alias("part")))
    edges = ranged.groupBy("part").agg(F.min(name).alias("least"))  # a row a partition
    order = W.partitionBy(F.lit(1)).orderBy("part")
    edges = edges.select("part", F.coalesce(F.lead("least").over(order), F.first("least").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("across"))
    inside = ranged.withColumn("next", F.lead(name).over(W.partitionBy("part").orderBy(name)))
    return inside.join(F.broadcast(edges), "part").select(name, F.coalesce("next", "across").alias("next"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of their edited texts and of the next document's, and how alike they are.

    A text's last quarter of code points (rounded down) is replaced by the first as many of the next document by
    ascending doc_id; after the last comes the first. Null texts are empty. Null doc_ids have no place in the order and
    are left out; rows that share a doc_id follow each other by text.

    Texts are shuffled by runs of RUN ids, which hold RUN documents at most where ids are unique (rows that share an id
    share a run). A window over a run gives each document the next one; only the last of a run gets it from the first
    of the next run, by a join on the run. The firsts come from an aggregate, so all texts are shuffled and fingerprinted
    once.
    """
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("run", F.floor(F.col("doc_id") / RUN))
    marked = fingerprints(own.repartition("run"))
    order = W.partitionBy("run").orderBy("doc_id", "text")
    after = following(own, "run").withColumnsRenamed({"run": "before", "next": "run"})
    least = own.groupBy("run").agg(F.min(F.struct("doc_id", "text")).alias("x")).select("run", "x.text")  # a row for each run and task moves
    firsts = fingerprints(least).join(after, "run").select(F.col("before").alias("run"), F.col("text").alias("first_text"), F.col("fingerprint").alias("first_fingerprint"))
    both = marked.withColumns({"head": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)}).alias("a")
    both = both.join(firsts.alias("b"), (F.col("a.run") == F.col("b.run")) & F.col("a.head").isNull(), "left")
    both = both.select("a.doc_id", "a.text", "a.fingerprint", F.char_length("a.text").cast("long").alias("n_chars"), F.coalesce("head", "first_text").alias("head"), F.coalesce("next_fingerprint", "first_fingerprint").alias("next_fingerprint"))
    q = F.floor(F.col("n_chars") / 4).cast("int")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - q), F.substring("head", F.lit(1), q)))
    both = chosen(both, "edited", "_runs").withColumn("edited_fingerprint", sketch(F.col("_runs")))
    return both.select("doc_id", "n_chars", "text", "edited", "fingerprint", "edited_fingerprint", "next_fingerprint")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents with a doc_id: fingerprints of its text and of its edited text, and how alike the first is
    to the second and to that of the next document. Null texts are empty; two empty texts are wholly alike."""
    got = edited_fingerprints(table(spark, sf_dir, "documents"))
    return got.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), text_of(F.col("fingerprint")).alias("fingerprint"), text_of(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {"op6_document_fingerprints": op6_document_fingerprints}
ORACLES: dict[str, str] = {}
