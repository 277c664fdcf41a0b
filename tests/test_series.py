"""Places, quantiles and lagged products of keys that no task holds as a whole."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from transitspark.operators import posterior, sampling, series


def test_places_go_on_from_range_to_range(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"chain": rng.choice(["a", "b", None], 3000, p=[0.9, 0.09, 0.01]), "step": rng.integers(0, 900, 3000), "value": rng.integers(0, 3, 3000)})
    got = series.numbered(spark.createDataFrame(pdf).repartition(7), ["chain"], "step", "value").toPandas()
    assert len(got) == 3000
    for c, own in got.groupby("chain", dropna=False):
        own = own.sort_values("_place")
        assert own["_place"].tolist() == list(range(len(own))) and (own["_n"] == len(own)).all()
        assert own[["step", "value"]].apply(tuple, axis=1).is_monotonic_increasing


def test_quantiles_of_running_counts_are_those_of_percentile(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"parameter": rng.choice(["p", "q"], 5000, p=[0.99, 0.01]), "value": np.round(rng.normal(0, 1, 5000), 2)})
    pdf.loc[:20, "value"] = None
    counts = posterior.counted(spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value"))))
    shares = [0.0, 0.025, 0.05, 0.5, 0.84, 1.0]
    whole, dealt = (dict(series.quantiles(counts, ["parameter"], "value", shares, few).collect()) for few in (10_000, 0))
    for p, own in pdf.dropna().groupby("parameter"):
        assert np.allclose(whole[p], np.quantile(own["value"], shares)) and np.allclose(dealt[p], whole[p])


def test_summaries_hold_no_group_of_values_in_one_aggregate(spark, monkeypatch):
    pdf = pd.DataFrame({"parameter": "p", "value": np.random.default_rng(3).normal(5, 2, 4000)})
    df = spark.createDataFrame(pdf)
    whole = posterior.summary(df).first()
    monkeypatch.setattr(series.quantiles, "__defaults__", (10,))
    dealt = posterior.summary(df).first()
    assert np.allclose(whole[1:], dealt[1:]) and np.isclose(whole["mean"], pdf["value"].mean()) and np.isclose(whole["sd"], pdf["value"].std()) and whole["n"] == 4000


def test_sizes_do_not_depend_on_segments(spark):
    rng = np.random.default_rng(4)
    rows = []
    for w, n in enumerate((2, 57, 1000, 1503)):
        x = np.convolve(rng.normal(0, 1, n + 9), np.ones(10), "valid")
        rows += [(0, w, k, "p", float(v)) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ensemble int, walker int, step int, parameter string, value double")
    short, long = (sampling.effective_sizes(df, segment=s).first() for s in (100, 10_000))
    assert np.allclose(short[1:], long[1:]) and 4 < long["tau"] < 20


def test_pieces_follow_each_other_and_pass_draws_on_once(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"chain": rng.choice(["a", "b", None], 3000, p=[0.9, 0.09, 0.01]), "walker": rng.integers(0, 3, 3000), "step": rng.integers(0, 900, 3000), "value": rng.integers(0, 5, 3000) / 4})
    pdf.loc[::50, "value"] = None
    asked = spark.sparkContext.accumulator(0)

    def count(batches):
        for x in batches:
            asked.add(x.num_rows)
            yield x

    df = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value"))).repartition(5)
    cut = series.pieces(df.mapInArrow(count, df.schema), ["chain", "walker"], ["step", "value"], "value", 64)
    got = series.placed(cut, ["chain", "walker"]).toPandas()
    assert got["n"].max() == 64 and asked.value <= 2 * len(pdf)  # once for the bounds of ranges, once to be dealt
    for key, own in pdf.groupby(["chain", "walker"], dropna=False):
        here = got[(got["chain"].isna() if pd.isna(key[0]) else got["chain"] == key[0]) & (got["walker"] == key[1])].sort_values(["_range", "_piece"])
        assert here["_start"].tolist() == [0, *here["n"].cumsum()[:-1]] and (here["_n"] == len(own)).all()
        want = own.sort_values(["step", "value"], na_position="first")["value"]
        assert np.array_equal(np.concatenate(here["values"].to_list()).astype(float), want, equal_nan=True)


def test_halves_and_sizes_of_one_set_of_pieces(spark):
    """What the criteria of convergence take: counts and pieces are made once for all of them."""
    rng = np.random.default_rng(9)
    x = np.cumsum(rng.normal(size=(2, 3, 501)), axis=2) * 0.1 + rng.normal(size=(2, 3, 501))
    rows = [("p", e, w, i, float(x[e, w, i])) for e in range(2) for w in range(3) for i in range(501)]
    df = spark.createDataFrame(rows + [("p", 0, 0, 900 + i, None) for i in range(4)] + [("still", e, 0, i, 0.1) for e in range(2) for i in range(40)], "parameter string, ensemble int, walker int, step long, value double")
    cut = series.pieces(df, list(posterior.CHAIN), ["step", "value"], "value", 37)
    rhat = {r["parameter"]: r for r in posterior.rhat_of(cut).collect()}
    walkers = [np.concatenate([x[e, w], [np.nan] * 4 * (e == w == 0)]) for e in range(2) for w in range(3)]
    halves = [v[k * (len(v) // 2) : (k + 1) * (len(v) // 2)] for v in walkers for k in (0, 1)]
    within, spread, n = np.mean([np.nanvar(h, ddof=1) for h in halves]), np.var([np.nanmean(h) for h in halves], ddof=1), min(map(len, halves))
    assert np.isclose(rhat["p"]["rhat"], np.sqrt(((n - 1) / n * within + spread) / within)) and rhat["p"]["n_halves"] == 12 and rhat["still"]["rhat"] == 1.0
    sizes = {r["parameter"]: r for r in sampling.sizes_of(cut, posterior.counted(df)).collect()}
    c = x - x.mean(axis=2, keepdims=True)
    rho = [(c[..., k:] * c[..., : 501 - k]).sum() / (501 - k) / ((c * c).sum() / 501) for k in range(1, sampling.LAGS + 1)]
    stop = next((k for k, r in enumerate(rho) if r <= 0), len(rho))
    assert np.isclose(sizes["p"]["tau"], 1 + 2 * sum(rho[:stop])) and sizes["still"]["tau"] == 1.0
