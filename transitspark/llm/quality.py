"""Quality classifier: a supervised embedding of hashed words and character n-grams, averaged per document.

Learning runs in numpy on a bounded sample of labelled rows: each document is the mean of the vectors of its words,
their character n-grams and a mark for each word that repeats the one before it; a softmax over that mean is trained
by stochastic gradient descent. Because the output is linear in the mean, a trained model needs one number per hash
bucket, so scoring sums one remembered number per word over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, forget_others, give_back, labelled_sample, sliced, table

BUCKETS, WIDTH, EPOCHS, RATE, SEED = 1 << 16, 12, 10, 0.5, 7
#: Labelled rows that a model is fitted on, at most.
SAMPLE = 4_000
NGRAMS = (2, 3, 4)
#: Words that a worker remembers at most.
REMEMBERED = 300_000


def features(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of a word and of its n-grams with the marks < and > around it; very long words give their edges and every step of them."""
    w = b"<" + word + b">"
    return [crc32(w) % buckets, *(crc32(w[i : i + n]) % buckets for n in NGRAMS if len(w) > n for i in range(len(w) - n + 1))]


REPEAT = b"\x00repeat"  # stands for a word that repeats the one before it; no text splits into it


def bag(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if again := sum(map(eq, words, words[1:])):
        counts[REPEAT] = again
    each = [(features(w, buckets), n) for w, n in counts.items()]
    if not each:
        return np.empty(0, "i4"), np.empty(0, "f4")
    ids = np.concatenate([np.array(f, "i4") for f, _ in each])
    n = np.repeat(np.array([n for _, n in each], "f4"), [len(f) for f, _ in each])
    u, inv = np.unique(ids, return_inverse=True)
    return u, np.bincount(inv, weights=n).astype("f4")


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias) of the log odds of label 1, from a two-class softmax over averaged vectors."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype("f4")
    out, bias = np.zeros((width, 2), "f4"), np.zeros(2, "f4")
    totals = [n.sum() for _, n in bags]
    step, total = 0, max(1, epochs * len(bags))
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            lr = rate * (1 - step / total)
            step += 1
            ids, share = bags[k][0], bags[k][1] / totals[k] if len(bags[k][0]) else bags[k][1]
            mean = share @ vectors[ids] if len(ids) else np.zeros(width, "f4")
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out @ p
            out -= lr * np.outer(mean, p)
            bias -= lr * p
            if len(ids):
                vectors[ids] -= lr * share[:, None] * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype("f8"), float(bias[1] - bias[0])


class Scorer:
    """The probability of label 1 of whole texts."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.buckets = weights, bias, len(weights)
        self.known: dict[bytes, complex] = {}

    def _learn(self, word: bytes) -> complex:
        f = features(word, self.buckets)
        return complex(self.weights[f].sum(), len(f))

    def score(self, text: str) -> float:
        words = text.encode("utf-8", "surrogatepass").split()
        known = self.known
        new = {w for w in words if w not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self._learn(w)
        total = sum(map(known.__getitem__, words))  # real: weights, imaginary: how many
        if again := sum(map(eq, words, words[1:])):
            total += again * self._learn(REPEAT)
        z = self.bias + (total.real / total.imag if words else 0.0)
        return float(1 / (1 + np.exp(-z)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", may_learn: Column | None = None, rows: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from at most `rows` labelled documents of those that may be learnt from.

    Bags are made in tasks; the driver gets `rows` bags at most. Without labels of both kinds the model says the share
    of label 1, or a half without any.
    """
    sample = labelled_sample(docs, labels, label, F.lit(True) if may_learn is None else may_learn, rows)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = [bag(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "ids": [i.tobytes() for i, _ in each], "n": [n.tobytes() for _, n in each]})

    t = sample.mapInPandas(bags, "doc_id long, label int, ids binary, n binary").toPandas().sort_values("doc_id")
    y = t["label"].clip(0, 1).to_numpy().astype("int64")
    if len(np.unique(y)) < 2:
        share = min(max(y.mean() if len(y) else 0.5, 0.01), 0.99)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    learnt = train([(np.frombuffer(i, "i4"), np.frombuffer(n, "f4")) for i, n in zip(t["ids"], t["n"])], y)
    del t
    give_back()
    return learnt


def scored(docs: DataFrame, weights: np.ndarray, bias: float, column: str = "score") -> DataFrame:
    """docs and a column of scores; a null text scores as an empty one. A column of docs of that name is replaced."""
    model = docs.sparkSession.sparkContext.broadcast((weights.astype("f4"), bias))
    docs = docs.drop(column)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        w, b0 = model.value
        own = Scorer(w.astype("f8"), b0)
        for b in sliced(batches):
            yield b.append_column(column, pa.array([own.score(t or "") for t in b.column("text").to_pylist()], pa.float64()))

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(each, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: whether its labels are held out, its score, and whether that is 0.3 or more. A null text
    scores as an empty one."""
    docs, fold = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), crc_of_id("doc_id") % 5
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", fold != 0)
    return scored(docs, *model).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLES: dict[str, str] = {}
