"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are a list of common insults, patterns, and mined lists of words and word beginnings that labelled rows mark.
A mined list says toxic if a document holds more of its terms than chance puts into a text of that length, else clean; terms are dealt to
the lists in turn, so lists are alike and none restates another. Mined lists vote only on rows that they were not mined
from: rows are halved by a checksum of their id, each half has lists of its own, and votes on the other half. The label
model sees votes alone, of every row that may be learnt from, labelled or not: rows are counted by what the voters say of
them, and expectation maximisation over these counts estimates how often each voter says what about either kind of
document, and from what is left over which voters go together beyond what the others explain (partial correlations that
chance does not give), so that correlated ones count less. Labels only say which terms to list and how sure a posterior
is to be taken (`calibrated`). A logistic regression on hashed words and word beginnings, with weights drawn to zero, then
learns the posteriors of the labelled sample; it alone scores documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import crc_of_id, forget_others, give_back, labelled_sample, sliced, table

BUCKETS = 1 << 19
#: Labelled rows that lists are mined from and the classifier is fitted on, at most.
SAMPLE = 8_000
#: Lengths of the word beginnings that count as terms besides whole words.
BEGINNINGS = (4, 5, 6, 7)
LISTS, EPOCHS, RATE, SHRINK, SEED = 8, 20, 0.3, 2e-5, 11
REMEMBERED = 300_000
#: How strong a mined term must be: rows it marks times log odds; chance alone gives few above this.
STRENGTH = 16.0
#: A list says toxic from one term more than so many times what its rate gives a text of that length.
CHANCE = 2.0
#: Common English insults; fixed values.
INSULTS = "asshole bastard bitch clown coward creep crap cretin damn disgusting dumb fool freak fuck garbage hate idiot imbecile jerk kill liar loser moron pathetic pig scum shit sick slut stupid trash ugly vermin whore worthless".split()
WORD = re.compile(r"[^\W_]+")


def terms(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a lower-case word and of its beginnings."""
    b = word.encode("utf-8", "surrogatepass")
    return [crc32(b"=" + b) % buckets, *(crc32(b"^" + word[:n].encode("utf-8", "surrogatepass")) % buckets for n in BEGINNINGS if len(word) >= n)]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


_INSULTS = frozenset(INSULTS)


def patterns(text: str, words: set[str]) -> list[int]:
    """Votes of fixed voters: 1 toxic, -1 clean, 0 nothing."""
    return [
        1 if words & _INSULTS else -1,
        1 if re.search(r"\b(?:you|you're|your|u)\b.{0,20}\b(?:idiot|moron|loser|stupid|trash|scum|clown)\b", text, re.I) else 0,
        1 if "**" in text and re.search(r"[a-z]\*{2,}", text, re.I) else 0,
    ]


def _counts(bags: Iterable[np.ndarray], buckets: int = BUCKETS) -> np.ndarray:
    """How many bags hold each bucket."""
    counts = np.zeros(buckets, "i8")
    for b in bags:
        counts[b] += 1  # a bag holds a bucket once
    return counts


def mined(bags: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS) -> list[np.ndarray]:
    """Word lists: buckets far more frequent in toxic rows, strongest first, dealt in turn to LISTS lists."""
    n1, n0 = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    c1, c0 = (_counts((b for b, t in zip(bags, y) if t == k), buckets) for k in (1, 0))
    p1, p0 = c1 / n1, (c0 + 0.5) / n0
    strength = c1 * np.log(np.maximum(p1, 1e-9) / p0)
    strength = np.where((c1 >= 3) & (p1 > 4 * p0) & (strength > STRENGTH), strength, 0)
    best = np.argsort(-strength, kind="stable")
    best = best[strength[best] > 0]
    return [best[k::LISTS] for k in range(LISTS)]


class LabelModel:
    """P(vote | label) of each voter, and how much voters repeat each other, from votes without labels."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray | None = None, rounds: int = 25):
        """votes: rows x voters of -1, 0, 1; counts: how many documents have the votes of a row."""
        c = np.ones(len(votes)) if counts is None else counts.astype("f8")
        n, m = c.sum(), votes.shape[1]
        hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype("f8")
        q = 1 / (1 + np.exp(-votes.sum(axis=1).astype("f8")))  # the majority
        for _ in range(rounds):
            self.prior = float(np.clip((c * q).sum() / n, 1e-3, 1 - 1e-3))
            said = np.stack([np.einsum("n,nmv->mv", w, hot) + 0.5 for w in (c * (1 - q), c * q)])
            self.table = said / said.sum(axis=2, keepdims=True)  # [label, voter, vote]
            # what is left of the votes once the label is known: voters that still move together share their weight
            expected = np.einsum("nl,lm->nm", np.column_stack([1 - q, q]), self.table[:, :, 2] - self.table[:, :, 0])
            rest = votes - expected
            covariance = (rest * c[:, None]).T @ rest / n
            scale = np.sqrt(np.diag(covariance)) + 0.01  # voters that are hardly ever wrong are not held to be wrong together
            self.correlation = covariance / np.outer(scale, scale)
            precision = np.linalg.inv(self.correlation + 0.05 * np.eye(m))
            partial = np.abs(precision) / np.sqrt(np.outer(np.diag(precision), np.diag(precision)))
            linked = (partial > 3 / np.sqrt(n)) & ~np.eye(m, dtype=bool)  # three deviations of what chance gives
            self.weight = 1 / (1 + np.where(linked, np.abs(self.correlation), 0).sum(axis=1))
            q = self.posterior(votes)

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic."""
        logs = np.log(self.table)
        at = votes.astype("i8") + 1
        return np.log(self.prior / (1 - self.prior)) + sum(self.weight[j] * (logs[1, j, at[:, j]] - logs[0, j, at[:, j]]) for j in range(votes.shape[1]))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(votes), -30, 30)))


def calibrated(z: np.ndarray, known: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posteriors from log odds: a line through them, fitted to the labels of the known rows by Newton's method. A line
    that falls, or none, leaves them as they are."""
    x, t = np.clip(z[known], -30, 30), y.astype("f8")
    w = np.array([0.0, 1.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        a = np.column_stack([np.ones(len(x)), x])
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, a.T @ (p - t) + 1e-3 * (w - [0.0, 1.0]))
    if not np.isfinite(w).all() or w[1] <= 0:
        w = np.array([0.0, 1.0])
    return 1 / (1 + np.exp(-np.clip(w[0] + w[1] * np.clip(z, -30, 30), -30, 30)))


def logistic(bags: list[np.ndarray], q: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Weights and bias of P(toxic) from soft labels q: adaptive gradient descent, drawn to zero after each document."""
    rng = np.random.default_rng(SEED)
    w, g2, seen = np.zeros(buckets, "f8"), np.full(buckets, 1e-2), np.zeros(buckets, "i8")
    bias, gb, t = float(np.log((q.mean() + 1e-3) / (1 - q.mean() + 1e-3))), 1e-2, 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            t += 1
            ids = bags[k]
            rate = RATE / np.sqrt(g2[ids])
            v = w[ids]
            v = np.sign(v) * np.maximum(np.abs(v) - rate * SHRINK * (t - seen[ids]), 0)
            g = 1 / (1 + np.exp(-np.clip(bias + v.sum(), -30, 30))) - q[k]
            g2[ids] += g * g
            w[ids] = v - rate * g
            seen[ids] = t
            gb += g * g
            bias -= RATE / np.sqrt(gb) * g
    w = np.sign(w) * np.maximum(np.abs(w) - RATE / np.sqrt(g2) * SHRINK * (t - seen), 0)
    return w, float(bias)


def _terms(text: str) -> np.ndarray:
    return np.unique(np.array([f for w in words_of(text) for f in terms(w)], "i4"))


def half_of(doc_id: int) -> int:
    """Which half a row is in: the lists mined from the other half vote on it."""
    return crc32(b"half %d" % doc_id) % 2


class Voters:
    """All voters: the fixed ones and, for either half, the lists mined from the other one."""

    def __init__(self, halves: list[list[np.ndarray]], rates: np.ndarray):
        """halves: lists mined from each half; rates: of each half's lists, how often a word of any text hits them."""
        self.which = [{int(b): k for k, x in enumerate(lists) for b in x} for lists in halves]
        self.rates = rates
        self.listed = np.zeros(BUCKETS, bool)
        for w in self.which:
            self.listed[list(w)] = True
        self.known: dict[str, tuple[int, ...]] = {}

    def lists_say(self, buckets: Iterable[int], n_words: int, half: int) -> list[int]:
        hits, which = [0] * LISTS, self.which[1 - half]
        for b in buckets:
            if (k := which.get(b)) is not None:
                hits[k] += 1
        return [1 if h > np.floor(CHANCE * n_words * r) else -1 for h, r in zip(hits, self.rates[1 - half])]

    def vote(self, text: str, half: int) -> list[int]:
        """Votes on a whole text; only the listed buckets of a word are remembered."""
        words, known = words_of(text), self.known
        if len(known) + len(words) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = tuple(b for b in terms(w) if self.listed[b])
        buckets = set().union(*filter(None, map(known.__getitem__, words)))
        return patterns(text, words) + self.lists_say(buckets, len(words), half)


def voters_of(bags: list[np.ndarray], n_words: np.ndarray, half: np.ndarray, y: np.ndarray) -> Voters:
    """Voters with the lists that labelled rows of each half mark."""
    halves = [mined([b for b, x in zip(bags, half) if x == h], y[half == h]) for h in (0, 1)]
    total = max(1, int(n_words.sum()))
    seen = _counts(bags)
    return Voters(halves, np.array([[seen[x].sum() / total for x in lists] for lists in halves]))


def fit_sample(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, float]:
    """A model from texts, in memory; a label of -1 is none. A text's place is its id."""
    known = np.flatnonzero(y >= 0)
    bags, n_words = [_terms(texts[k]) for k in known], np.array([len(words_of(texts[k])) for k in known])
    half = np.array([half_of(k) for k in range(len(texts))])
    if len(np.unique(y[known])) < 2:
        return _share(y[known])
    voters = voters_of(bags, n_words, half[known], y[known])
    votes = np.array([voters.vote(t, h) for t, h in zip(texts, half)])
    return _learn(voters, LabelModel(votes), bags, votes[known], y[known])


def _share(y: np.ndarray) -> tuple[np.ndarray, float]:
    share = min(max(y.mean() if len(y) else 0.0, 0.01), 0.99)
    return np.zeros(BUCKETS), float(np.log(share / (1 - share)))


def _learn(voters: Voters, model: LabelModel, bags: list[np.ndarray], votes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """The classifier, from the posteriors of labelled rows."""
    q = calibrated(model.evidence(votes), np.ones(len(y), bool), y)
    return logistic([b[voters.listed[b]] for b in bags], q)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.buckets = weights, bias, len(weights)
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        """P(toxic) of a whole text; each bucket counts once, however often it occurs."""
        words, known = words_of(text), self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = words
        w = self.weights
        for x in new:
            known[x] = tuple(f for f in terms(x, self.buckets) if w[f])  # most words have none that counts
        ids = set().union(*filter(None, map(known.__getitem__, words)))
        z = self.bias + sum(w[i] for i in ids)
        return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", may_learn: Column | None = None, rows: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from at most `rows` labelled documents and the votes on all documents that may be learnt from; without
    labels of both kinds it says the share of toxic rows.

    Terms and votes are made in tasks. The driver gets the terms of so many rows at most, and one row for each
    combination of votes, of which there are at most 3 * 2 * 2 * 2^LISTS however many documents vote.
    """
    allowed = F.lit(True) if may_learn is None else may_learn

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [words_of(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "ids": [_terms(t).tobytes() for t in pdf["text"]], "n_words": [len(w) for w in words], "fixed": [patterns(t, w) for t, w in zip(pdf["text"], words)]})

    sample = labelled_sample(docs, labels, label, allowed, rows).select(F.col("doc_id").cast("long"), "text", "label")
    t = sample.mapInPandas(seen, "doc_id long, label int, ids binary, n_words long, fixed array<int>").toPandas().sort_values("doc_id")
    bags, y = [np.frombuffer(i, "i4") for i in t["ids"]], t["label"].clip(0, 1).to_numpy().astype("int64")
    if len(np.unique(y)) < 2:
        return _share(y)
    half = np.array([half_of(d) for d in t["doc_id"].tolist()])
    voters = voters_of(bags, t["n_words"].to_numpy(), half, y)
    shared = docs.sparkSession.sparkContext.broadcast((voters.which, voters.rates, np.flatnonzero(voters.listed)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        own, counts = Voters([], np.empty(0)), Counter()
        own.which, own.rates = shared.value[:2]
        own.listed[shared.value[2]] = True
        for b in sliced(batches):
            counts.update(bytes(v + 1 for v in own.vote(text, half_of(d))) for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["votes", "n"])

    voting = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & allowed).select(F.col("doc_id").cast("long"), "text")
    said = voting.mapInArrow(count, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n")).orderBy("votes").toPandas()
    model = LabelModel(np.array([list(v) for v in said["votes"]]) - 1, said["n"].to_numpy())
    votes = np.array([list(f) + voters.lists_say(b.tolist(), n, h) for f, b, n, h in zip(t["fixed"], bags, t["n_words"], half)])
    learnt = _learn(voters, model, bags, votes, y)
    del t, bags
    give_back()
    return learnt


def scored(docs: DataFrame, weights: np.ndarray, bias: float, column: str = "score") -> DataFrame:
    """docs and a column of scores; a null text scores as an empty one. A column of docs of that name is replaced."""
    used = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((used.astype("i4"), weights[used], len(weights), bias))
    docs = docs.drop(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        at, w, n, b0 = model.value
        full = np.zeros(n)
        full[at] = w
        own = Scorer(full, b0)
        for b in sliced(batches):
            yield b.append_column(column, pa.array([own.score(t or "") for t in b.column("text").to_pylist()], pa.float64()))

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: whether its labels are held out, its score, and whether that is 0.7 or more. A null text
    scores as an empty one."""
    docs, fold = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), crc_of_id("doc_id") % 3
    model = fit(docs, table(spark, sf_dir, "labels"), "toxic", fold != 1)
    return scored(docs, *model).select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
