"""Collocations: phrases whose words stand together more often than their parts' frequencies explain.

Texts are cut into pieces and words. Only the longest windows are counted: every word with the four after it in its
piece (lead columns, nulls past the end). A shorter phrase is the beginning of the windows that start with it, so a
ROLLUP over the window's words sums it from their counts; no n-grams of other orders are ever written out.

Three passes over the texts, each a task's own work on slices of them, pre-aggregated before any shuffle:

1. words: counts by language. Words travel as 64-bit hashes from there on; two words of a language with one hash are
   noticed, and another seed is taken.
2. pairs: counts of hashed neighbours, which are never below a pair's own count. A window ends before a pair whose count
   is below the threshold, for no candidate holds it. That leaves out no candidate at any size; as counters are 2^26 at
   most (a bitmap of 8 MB is all that is broadcast), larger corpora keep more windows.
3. windows of at least two words.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, staged, table

#: A candidate's least count, its most words, and how many a language reports.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that a task works on together.
TOGETHER = 4_000_000
#: Pair counters: one for so many words, in powers of two between these bounds; how many travel in one row.
WORDS_A_COUNTER, FEWEST_BITS, MOST_BITS, PAGE = 8, 16, 26, 1 << 14
#: Totals of so many languages are broadcast.
FEW = 10_000
#: Ends a piece; no byte of UTF-8.
END = b"\xff"
#: Lower case of A-Z; tab as space; what ends a piece.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + 10 * END)
#: Odd multipliers that mix hashes (fixed values).
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


class _Slice:
    """Words of a slice of one language's texts: `codes` number them by `distinct`; `ends` are places between pieces."""

    def __init__(self, lang: str, texts: list[str], seed: int):
        joined = "\n".join(texts).encode() + b"\n"
        found = pa.array(joined.translate(BYTES).replace(END, b" \xff ").split(), pa.large_binary()).dictionary_encode()
        self.lang, self.distinct = lang, found.dictionary.to_pylist()
        self.codes = found.indices.to_numpy()
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct), "u8", len(self.distinct))
        self.end = self.distinct.index(END)

    def pairs(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the word at each place, and the counter of it and the next (-1: a piece ends between)."""
        h = self.hashes[self.codes]
        with np.errstate(over="ignore"):
            mixed = h[:-1] * ODD[0] + (h[1:] ^ (h[1:] >> np.uint64(29))) * ODD[1] + np.uint64(xxhash.xxh64_intdigest(self.lang.encode()))
            mixed = (mixed ^ (mixed >> np.uint64(32))) * ODD[2] >> np.uint64(64 - bits)
        counter = mixed.astype("int64")
        ended = self.codes == self.end
        counter[ended[:-1] | ended[1:]] = -1
        return h, counter


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[_Slice]:
    held: dict[str, list[str]] = {}
    n = 0
    for b in sliced(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            held.setdefault(lang, []).append(text)
            n += len(text)
            if n >= TOGETHER:
                yield from (_Slice(k, t, seed) for k, t in held.items())
                held, n = {}, 0
    yield from (_Slice(k, t, seed) for k, t in held.items())


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """(lang, h, word, f) of texts(lang, text), f the word's occurrences in its language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches, seed):
            counts = np.bincount(s.codes, minlength=len(s.distinct))
            here = np.flatnonzero(np.arange(len(s.distinct)) != s.end)
            words = pa.array([s.distinct[i].decode() for i in here.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([s.lang] * len(here), pa.string()), pa.array(s.hashes[here].view("i8")), words, pa.array(counts[here])], ["lang", "h", "word", "f"])

    return texts.mapInArrow(run, "lang string, h long, word string, f long").groupBy("lang", "h", "word").agg(F.sum("f").alias("f"))


def common_pairs(texts: DataFrame, seed: int, bits: int, least: int) -> np.ndarray:
    """One bit for each of 2^bits counters: whether `least` pairs or more fall on it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, "u1")  # counts stop at `least`, which is all that is asked
        for s in _slices(batches, seed):
            counter, n = np.unique(s.pairs(bits)[1], return_counts=True)
            n = n[counter >= 0]
            counter = counter[counter >= 0]
            held[counter] = np.minimum(held[counter] + n, least)
        for some in itertools.batched(range(len(held) // PAGE), 200):
            there = {p: np.flatnonzero(held[p * PAGE : (p + 1) * PAGE]) for p in some}
            pages = [p for p in some if len(there[p])]
            places, counts = ([f(p).tobytes() for p in pages] for f in (lambda p: there[p].astype("<u2"), lambda p: held[p * PAGE + there[p]]))
            yield pa.RecordBatch.from_arrays([pa.array(pages, pa.int32()), pa.array(places, pa.binary()), pa.array(counts, pa.binary())], ["page", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = None, np.zeros(PAGE, "int64")

        def bits_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], ["page", "bits"])

        for b in batches:
            for p, places, counts in zip(*(b.column(c).to_pylist() for c in ("page", "places", "counts"))):
                if p != page:
                    if page is not None and (held >= least).any():
                        yield bits_of()
                    page, held = p, np.zeros(PAGE, "int64")
                held[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "u1")
        if page is not None and (held >= least).any():
            yield bits_of()

    pages = texts.mapInArrow(count, "page int, places binary, counts binary").repartition("page").sortWithinPartitions("page")
    out = np.zeros((max(1, (1 << bits) // PAGE), PAGE // 8), "u1")
    for r in pages.mapInArrow(add, "page int, bits binary").collect():  # 2^26 bits at most
        out[r["page"]] = np.frombuffer(r["bits"], "u1")
    return out.reshape(-1)


def windows(texts: DataFrame, seed: int, bits: int, common: np.ndarray, longest: int) -> DataFrame:
    """(lang, w1, w2, ..., n): windows of up to `longest` words and how often a slice has them; nulls past the end."""
    names = [f"w{k + 1}" for k in range(longest)]
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _slices(batches, seed):
            h, counter = s.pairs(bits)
            joined = np.zeros(len(h), bool)
            joined[:-1] = (counter >= 0) & (shared.value[counter >> 3] >> (counter & 7).astype("u1") & 1).astype(bool)
            at = np.flatnonzero(joined)
            there, columns = np.ones(len(at), bool), [h[at]]
            missing = [~there]
            for k in range(1, longest):  # the lead columns
                there = there & joined[np.minimum(at + k - 1, len(h) - 1)]
                columns.append(np.where(there, h[np.minimum(at + k, len(h) - 1)], np.uint64(0)))
                missing.append(~there)
            with np.errstate(over="ignore"):
                key = sum((c ^ (c >> np.uint64(31))) * m for c, m in zip(columns, itertools.cycle(ODD)))
            order = np.argsort(key)
            columns, missing = [c[order] for c in columns], [m[order] for m in missing]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([(c[1:] != c[:-1]) | (m[1:] != m[:-1]) for c, m in zip(columns, missing)])
            first = np.flatnonzero(new)
            if len(first):
                lang = pa.array([s.lang]).take(pa.array(np.zeros(len(first), "int64")))
                yield pa.RecordBatch.from_arrays([lang, *(pa.array(c[first].view("i8"), mask=m[first]) for c, m in zip(columns, missing)), pa.array(np.diff(first, append=len(order)))], ["lang", *names, "n"])

    return texts.mapInArrow(run, f"lang string, {', '.join(f'{c} long' for c in names)}, n long")


def counted_phrases(found: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, phrase, a) of the phrases of two words or more, arrays of hashes, that windows begin with `least` times."""
    names = [f"w{k + 1}" for k in range(longest)]
    rolled = f"ROLLUP((lang, w1, w2){''.join(f', {c}' for c in names[2:])})"
    sums = found.sparkSession.sql(f"SELECT lang, {', '.join(names)}, grouping_id() AS level, SUM(n) AS a FROM {{found}} GROUP BY {rolled} HAVING SUM(n) >= {least}", found=found)
    # at level 2^j - 1 the last j words are summed over; the last that is left must be one and not past the end
    last = F.element_at(F.array(*names), F.lit(longest) - F.length(F.regexp_replace(F.bin("level"), "0", "")).cast("int"))
    return sums.where(F.col("lang").isNotNull() & last.isNotNull()).select("lang", F.array_compact(F.array(*names)).alias("phrase"), "a")


def scored(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of candidates(lang, phrase, a) that no longer one holds as often."""
    k = F.size("phrase")
    longer = candidates.where(k > 2).select("lang", F.explode(F.array(F.slice("phrase", F.lit(1), k - 1), F.slice("phrase", F.lit(2), k - 1))).alias("phrase"), F.col("a").alias("held"))
    # a phrase within a longer one that is as frequent lies in one that has a word more and is as frequent, too
    kept = candidates.join(longer.groupBy("lang", "phrase").agg(F.max("held").alias("held")), ["lang", "phrase"], "left").where("held IS NULL OR 100 * held < 100 * a").drop("held")
    counts = candidates.unionByName(words.select("lang", F.array("h").alias("phrase"), F.col("f").alias("a")))
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")))
    totals = F.broadcast(totals) if totals.limit(FEW + 1).count() <= FEW else totals
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    halves = cut.select("*", F.slice("phrase", F.lit(1), F.col("cut")).alias("left"), F.expr("slice(phrase, cut + 1, size(phrase) - cut)").alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        halves = halves.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(count)), ["lang", side])
    parts = halves.join(totals, "lang").select("*", F.expr("CAST(1000 * CAST(a AS decimal(18,0)) * CAST(n AS decimal(16,0)) AS decimal(38,0)) div CAST(CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0)) AS decimal(38,0))").alias("score"))
    least = parts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("least"))
    return least.select("lang", "phrase", *(f"least.{c}" for c in ("a", "l", "r", "n", "score")))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to `longest` words among those that
    occur `least` times or more, by score, count and phrase.

    docs has text and lang; other columns are not looked at. Null texts are empty, a null lang is `und`. A row counts as
    often as it is there. Texts without words, or empty tables, give no rows.
    """
    if longest < 3 or not 0 < least < 128:
        raise ValueError("longest must be 3 or more, least from 1 to 127: a counter of pairs is a byte")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in itertools.count():
        words = staged(word_counts(texts, seed))
        if not words.groupBy("lang", "h").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
            break
    n = words.agg(F.sum("f")).first()[0] or 0
    bits = min(MOST_BITS, max(FEWEST_BITS, (n // WORDS_A_COUNTER).bit_length()))
    found = windows(texts, seed, bits, common_pairs(texts, seed, bits, least), longest)
    best = scored(staged(counted_phrases(found, least, longest)), words)
    # ties at the end of a language's list stay until their words are known
    near = staged(best.withColumn("place", F.expr("rank() OVER (PARTITION BY lang ORDER BY score DESC, a DESC)")).where(F.col("place") <= top).drop("place"))
    spelt = near.select("lang", "phrase", F.posexplode("phrase").alias("at", "h")).join(words.select("lang", "h", "word"), ["lang", "h"])
    texts_of = spelt.groupBy("lang", "phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    ranked = near.join(texts_of, ["lang", "phrase"]).withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, text)")).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of documents, of 2 to 5 words that occur 100 times or more."""
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrases": op13_phrases}
ORACLES = {
    "op13_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM starts)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f AS a FROM counts WHERE k >= 2),
inner_phrases AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS phrase, a FROM (
    SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
), kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inner_phrases i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)
), cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, t.n, cut, (1000::HUGEINT * c.a * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN totals t USING (lang)
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')
), least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM least_cut QUALIFY rank <= 2000"""
}
