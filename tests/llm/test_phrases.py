"""Phrase mining held against plain counting of all n-grams, and against the SQL of its query."""

import random
import re
import string
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import assert_same

from transitspark.llm import phrases

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def counted(rows, least, longest, top):
    """The rows of collocations() from (lang, text) by counting every n-gram."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        frequent = [p for p, a in c.items() if a >= least and len(p) > 1]
        covered = {(p[i : i + m], c[p]) for p in frequent for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        found = []
        for p in frequent:
            if (p, c[p]) not in covered:
                score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((lang, " ".join(p), c[p], c[p[:k]], c[p[k:]], n[lang], score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(found[:top])]
    return sorted(out)


def of(spark, rows, **settings):
    frame = spark.createDataFrame([(t, g, "x", i % 3) for i, (g, t) in enumerate(rows)], "text string, lang string, phrase string, n int").repartition(3)
    return sorted(map(tuple, phrases.collocations(frame, **settings).collect()))


ODD = [(None, None), ("en", ""), ("en", " \t.,;\n"), (None, "a a a a a a a a a"), ("de", "Grün GRÜN grün. ÄÖ äö"), ("en", "x" * 5_000 + " y"), ("en", "A B\tC a b c, a B c; a b! c"), ("", "a b a b a b"), ("en", "q\x00 \x1cw\x85 q\x00 \x1cw\x85 q\x00 \x1cw\x85")]


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_counting(spark, seed):
    rng = random.Random(seed)
    rows = [*ODD, *ODD]
    for _ in range(60):
        vocabulary = rng.choice([["a", "b"], ["a", "b", "c", "The", "é", "日本"], [f"w{i}" for i in range(400)]])
        rows.append((rng.choice(["en", "de", None, ""]), "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "\r\n"]) for _ in range(rng.randrange(200)))))
    settings = rng.choice([{"least": 3, "longest": 5, "top": 50}, {"least": 2, "longest": 4, "top": 2000}, {"least": 10, "longest": 5, "top": 7}, {"least": 1, "longest": 3, "top": 30}])
    got = of(spark, rows, **settings)
    assert got and got == counted(rows, **settings)


def test_ties_are_cut_by_phrase(spark):
    rows = [("en", f"p{i} q{i}. " * 3) for i in range(40)]
    assert [r[2] for r in of(spark, rows, least=3, top=10)] == sorted(f"p{i} q{i}" for i in range(40))[:10] and of(spark, rows, least=3, top=10) == counted(rows, 3, 5, 10)


def test_few_counters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 14)
    monkeypatch.setattr(phrases, "WORDS_A_COUNTER", 1)
    rng = random.Random(9)
    rows = [("en", " ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(9_000))) for _ in range(5)]
    assert of(spark, rows, least=4) == counted(rows, 4, 5, 2000)


def test_large_numbers_are_exact(spark):
    big = 3_000_000_019
    words = spark.createDataFrame([("en", 1, "a", big), ("en", 2, "b", big + 7), ("en", 3, "c", 2**52)], "lang string, h long, word string, f long")
    row = phrases.scored(spark.createDataFrame([("en", [1, 2], big - 11)], "lang string, phrase array<long>, a long"), words).first()
    n = 2 * big + 7 + 2**52
    assert (row["n"], row["score"]) == (n, 1000 * (big - 11) * n // (big * (big + 7)))


def test_query_and_empty_table(spark, sf_dir, tmp_path):
    assert_same(phrases.op13_phrases(spark, sf_dir), sf_dir, phrases.ORACLES["op13_phrases"])
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = phrases.op13_phrases(spark, str(tmp_path))
    assert got.count() == 0 and got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
