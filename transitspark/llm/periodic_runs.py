"""Runs of words that repeat with a fixed period, found by seeds on diagonals that are extended both ways.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and a length of at least
max(6, 4 q) that no neighbouring word extends. Shifted by q it lies on itself for at least 3 q words (5 for q = 1).
Lags are taken in classes from 2^a to 2^(a+1) - 1; within a class every run holds a k-gram, k = 3 * 2^a (5 for lag 1), and
the same one q words later. No occurrence lies between the two: with one at distance d < q the stretch from the first to
the last would have the periods d and q and be d + q words long, so gcd(d, q) would be a period, and q not the smallest.
So seeds are neighbouring occurrences of a k-gram in one document whose lag is in the class, of which there are at
most as many as words, and never all pairs. For the same reason a lag that is found is a smallest period.

Ranks stand for k-grams, not hashes: those of length 2 k are pairs of ranks of length k, taken only where both halves
repeat in their document, so few places are left after two words. A seed is extended word by word to both
sides; a table of how far each lag has been followed skips the seeds that lie on a diagonal already followed. All
documents of a slice are worked on together, with a word of its own after each.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, table

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Words that are worked on together; a longer document is worked on alone.
TOGETHER = 200_000
RUNS = T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, cut at the space and U+0009 to U+000D alone; bytes are cut exactly there."""
    return (text or "").encode().split()


class _Grams:
    """Ranks of the k-grams that repeat within a document; -1 stands where another gram begins."""

    def __init__(self, key: np.ndarray, places: np.ndarray, document: np.ndarray):
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        meets = (key[1:] == key[:-1]) & (document[places[1:]] == document[places[:-1]])
        #: Neighbouring occurrences in one document.
        self.first, self.second = places[:-1][meets], places[1:][meets]
        kept = np.zeros(len(places), bool)
        kept[:-1] |= meets
        kept[1:] |= meets
        rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(key) else key
        self.rank = np.full(len(document), -1, "int64")
        self.rank[places[kept]] = rank[kept]
        self.size = int(rank[-1]) + 1 if len(key) else 1

    def then(self, other: np.ndarray, size: int, after: int, document: np.ndarray) -> _Grams:
        """This gram followed, `after` places on, by one of `size` other ranks."""
        places = np.flatnonzero(self.rank[: max(0, len(self.rank) - after)] >= 0)
        places = places[other[places + after] >= 0]
        return _Grams(self.rank[places] * size + other[places + after], places, document)

    def seeds(self, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(lag, place) of neighbouring occurrences, in this order; of places in a row on one diagonal, the first."""
        lag = self.second - self.first
        fits = (lag >= least) & (lag <= most)
        lag, place = lag[fits], self.first[fits]
        order = np.lexsort((place, lag))
        lag, place = lag[order], place[order]
        fresh = np.ones(len(lag), bool)
        fresh[1:] = (lag[1:] != lag[:-1]) | (place[1:] != place[:-1] + 1)
        return lag[fresh], place[fresh]


def _equal(w: np.ndarray, at: int, lag: int, step: int) -> int:
    """From `at` on (step 1) or before it (step -1): how many places in a row equal those a lag later. Looks at blocks
    that double in length, so the work is in proportion to what is found."""
    n, block, most = 0, 64, (len(w) - lag - at if step > 0 else at)
    while n < most:
        size = min(block, most - n)
        low = at + n if step > 0 else at - n - size
        differ = w[low : low + size] != w[low + lag : low + lag + size]
        if differ.any():
            return n + int(differ.argmax() if step > 0 else differ[::-1].argmax())
        n, block = n + size, min(2 * block, 1 << 20)
    return n


def find_runs(w: np.ndarray, document: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in w, by start, then period. w holds ids of words from 0 on; document rises
    from one to the next, and the last place of each holds an id that is nowhere else."""
    found: list[tuple[int, int, int]] = []
    followed: dict[int, int] = {}

    def extend(lags: np.ndarray, places: np.ndarray) -> None:
        for lag, place in zip(lags.tolist(), places.tolist()):
            if place < followed.get(lag, 0):
                continue
            start, end = place - _equal(w, place, lag, -1), place + _equal(w, place, lag, 1)
            followed[lag] = end
            if end - start + lag >= max(LEAST, PERIODS * lag):
                found.append((start, end - start + lag, lag))

    if len(w) > LEAST:
        size = int(w.max()) + 1
        two = _Grams(w[:-1] * size + w[1:], np.arange(len(w) - 1), document)
        three = two.then(w, size, 2, document)
        extend(*three.then(three.rank, three.size, 2, document).seeds(1, 1))  # five words
        grams, lag = three.then(three.rank, three.size, 3, document), 2
        while len(grams.first):
            extend(*grams.seeds(lag, 2 * lag - 1))
            grams, lag = grams.then(grams.rank, grams.size, 3 * lag, document), 2 * lag
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), "int64").reshape(-1, 3)


def runs_of(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each list of words: rows (start, length, period) by start, then period."""
    lengths = np.array([len(t) + 1 for t in texts], "int64")
    ends = np.cumsum(lengths)
    document = np.repeat(np.arange(len(texts)), lengths)
    w = np.empty(len(document), "int64")
    last = np.zeros(len(document), bool)
    last[ends - 1] = True
    coded = pa.array([x for t in texts for x in t], pa.large_binary()).dictionary_encode()
    w[~last] = coded.indices.to_numpy()
    w[last] = len(coded.dictionary) + np.arange(len(texts))
    found = find_runs(w, document)
    owner = document[found[:, 0]]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [found[a:b] - np.array([end - length, 0, 0]) for a, b, end, length in zip(cuts[:-1], cuts[1:], ends, lengths)]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words but for those that a run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, "int64")
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _together(texts: Iterator[list[bytes]]) -> Iterator[tuple[list[list[bytes]], list[np.ndarray]]]:
    """Lists of words and their runs, at most TOGETHER words at a time or one list."""
    held: list[list[bytes]] = []
    n = 0
    for words in texts:
        if held and n + len(words) > TOGETHER:
            yield held, runs_of(held)
            held, n = [], 0
        held.append(words)
        n += len(words)
    if held:
        yield held, runs_of(held)


def periodic_runs(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with runs, an array of (start, length, period) by start, then period (places are numbers of words from 0),
    and collapsed, the words joined by single spaces without those that a run repeats.

    Null and empty texts have no runs and collapse to an empty text. Rows and other columns stay; columns named runs or
    collapsed are replaced.
    """
    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            runs, collapsed = [], []
            for texts, found in _together(map(words_of, b.column(column).to_pylist())):
                runs += [[dict(zip(("start", "length", "period"), r)) for r in x.tolist()] for x in found]
                collapsed += [b" ".join(kept_words(t, x)).decode() for t, x in zip(texts, found)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(runs, kind), pa.array(collapsed, pa.string())], [*(f.name for f in kept), "runs", "collapsed"])

    return docs.mapInArrow(run, T.StructType([*kept]).add("runs", RUNS).add("collapsed", "string"))


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as the query takes them: in a tenth of the documents, told by a checksum of the id, all
    words from some place on are repetitions of the first few there. A null id: as they are."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: number of runs, the longest one (nulls if there is none), digests of all runs and of the
    words that stay. Null texts have no words."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids, rows = b.column("doc_id").to_pylist(), []
            for texts, found in _together(repeated_words(i, words_of(t)) for i, t in zip(ids, b.column("text").to_pylist())):
                for words, runs in zip(texts, found):
                    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                    kept = b" ".join(kept_words(words, runs))
                    rows.append((len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
            names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            columns = [pa.array([r[k] for r in rows], pa.string() if "sha" in n else pa.int64()) for k, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(digests, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES: dict[str, str] = {}
