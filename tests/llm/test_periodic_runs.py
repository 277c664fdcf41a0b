"""Periodic runs held against a search of every lag."""

import hashlib
import random
import re
import time
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from transitspark.llm import periodic_runs
from transitspark.llm.periodic_runs import kept_words, runs_of


def every_lag(words):
    """All (start, length, period) by comparing words at each lag; smallest periods come first, so multiples are known."""
    found = set()
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(a == i and m == length for a, m, p in found):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_few_words(texts):
    texts = [[b"%d" % x for x in t] for t in texts]
    assert [list(map(tuple, r.tolist())) for r in runs_of(texts)] == [every_lag(t) for t in texts]


def test_planted_periods_of_every_size():
    rng = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(5):
            words = []
            for _ in range(rng.randrange(5)):
                words += [b"w%d" % rng.randrange(rng.choice([2, 5, 900])) for _ in range(rng.randrange(40))]
                unit = [b"u%d" % rng.randrange(rng.choice([1, 2, 3, 900])) for _ in range(rng.randrange(1, 30))]
                words += unit * rng.randrange(6) + unit[: rng.randrange(len(unit))]
            texts.append(words)
        assert [list(map(tuple, r.tolist())) for r in runs_of(texts)] == [every_lag(t) for t in texts]


def test_fibonacci_words_and_long_texts_take_linear_time():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 300:
        a, b = b, b + a
    assert list(map(tuple, runs_of([b])[0].tolist())) == every_lag(b)
    began = time.time()
    n = 300_000
    assert runs_of([[b"x"] * n])[0].tolist() == [[0, n, 1]]
    assert runs_of([[b"a", b"b", b"c"] * n])[0].tolist() == [[0, 3 * n, 3]]
    unit = [b"%d" % i for i in range(50_000)]
    assert runs_of([unit * 5 + [b"z"]])[0].tolist() == [[0, 250_000, 50_000]]
    assert time.time() - began < 30


def test_words_kept():
    words = b"x a b a b a b a b y z z z z z z".split()
    runs = runs_of([words])[0]
    assert runs.tolist() == [[1, 8, 2], [10, 6, 1]] and b" ".join(kept_words(words, runs)) == b"x a b y z"


TEXTS = [
    None, "", " \t\n", "one", "a a a a a a", "A a A a A a A a", "no\x1cbreak\x85here\xa0 " * 8, "x\x0by\x0cz\r" * 5, "very very very very very good", "Wörter 日本 " * 40, "la " * 20_000, " ".join(f"w{i % 700}" for i in range(9_000)), "tail 1 2 3 1 2 3 1 2 3 1 2 3",
]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_lag(words) if n < 3_000 else [tuple(r) for r in runs_of([[w.encode() for w in words]])[0].tolist()]
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else [None] * 4), hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(4, "a a a a a a"), (4, "a a a a a a"), (None, "b b b b b b b")]
    rows += [(1000 + i, " ".join(f"w{(i * k) % 90}" for k in range(60))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(*r)) for r in rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic_runs.op11_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_query_on_given_documents(spark, sf_dir):
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 1_500]
    got = {r["doc_id"]: tuple(r) for r in periodic_runs.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(got) >= len(rows) and any(t[1] for t in got.values())
    for r in rows:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_operator_keeps_rows_and_replaces_columns(spark):
    docs = spark.createDataFrame([(i, t, 7, "own") for i, t in enumerate(TEXTS)], "id long, text string, runs int, other string")
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(TEXTS) and {r["other"] for r in rows} == {"own"}
    for r in rows:
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")]
        runs = runs_of([words])[0]
        assert [tuple(x) for x in r["runs"]] == list(map(tuple, runs.tolist())) and r["collapsed"] == b" ".join(kept_words(words, runs)).decode()
