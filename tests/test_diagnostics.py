"""Diagnostics of chains on known chains, against plain numpy."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from transitspark.operators import diagnostics as d

SCHEMA = "parameter string, ensemble int, walker int, step long, value double"


def frame(spark, chains):
    """chains: {(parameter, ensemble): array (walkers, steps)}"""
    rows = [pd.DataFrame({"parameter": p, "ensemble": e, "walker": w, "step": np.arange(len(x)), "value": x}) for (p, e), walkers in chains.items() for w, x in enumerate(walkers)]
    return spark.createDataFrame(pd.concat(rows), SCHEMA).repartition(5)


def ar1(rng, walkers, steps, phi):
    x = rng.normal(size=(walkers, steps)) * np.sqrt(1 - phi**2)
    x[:, 0] = rng.normal(size=walkers)
    for i in range(1, steps):
        x[:, i] += phi * x[:, i - 1]
    return x


def ranks(x):
    order = np.sort(x.ravel())
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def split(x):
    n = x.shape[1] // 2
    return np.concatenate([x[:, :n], x[:, n : 2 * n]])


def scores(x):
    return np.vectorize(NormalDist().inv_cdf)((ranks(x) - 0.375) / (x.size + 0.25))


def rhat(z):
    n = z.shape[1]
    w, b = z.var(axis=1, ddof=1).mean(), z.mean(axis=1).var(ddof=1)
    return np.sqrt(((n - 1) / n * w + b) / w)


def size(z):
    """Effective size by sums over all lags, written as loops."""
    m, n = z.shape
    c = z - z.mean(axis=1, keepdims=True)
    acov = [np.mean([(x[: n - t] * x[t:]).sum() / n for x in c]) for t in range(n)]
    w = acov[0] * n / (n - 1)
    pooled = w * (n - 1) / n + z.mean(axis=1).var(ddof=1)
    if pooled == 0:
        return float(z.size)
    rho = [1.0] + [1 - (w - a * n / (n - 1)) / pooled for a in acov[1:]]
    total, before, t = 0.0, np.inf, 0
    while t + 1 < n and rho[t] + rho[t + 1] >= 0:
        before = min(before, rho[t] + rho[t + 1])
        total += before
        t += 2
    tau = -1 + 2 * total + (max(rho[t], 0) if t + 1 < n else 0)
    return min(m * n / max(tau, 1 / np.log10(m * n)), m * n * np.log10(m * n))


@pytest.fixture(scope="module")
def chains():
    rng = np.random.default_rng(2)
    return {("fine", 0): rng.normal(size=(4, 301)), ("slow", 0): ar1(rng, 4, 400, 0.9), ("apart", 0): rng.normal(size=(4, 200)) + np.arange(4)[:, None], ("tied", 0): rng.integers(0, 4, (4, 200)).astype(float), ("wide", 0): rng.normal(size=(4, 200)) * (1 + 3 * np.arange(4)[:, None])}


def test_normal_quantile(spark):
    p = np.concatenate([np.linspace(1e-6, 1 - 1e-6, 999), [1e-300, 1e-20, 1e-12, 0.075, 0.925, 0.5]])
    got = spark.createDataFrame(pd.DataFrame({"p": p})).select("p", d.normal_quantile("p").alias("z")).toPandas()
    assert np.allclose(got["z"], [NormalDist().inv_cdf(x) for x in got["p"]], rtol=1e-13, atol=1e-14)


def test_ranks_with_ties_over_many_ranges(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"parameter": rng.choice(["a", "b", "c"], 4000, p=[0.9, 0.09, 0.01]), "value": rng.integers(-300, 300, 4000) / 4})
    got = d.mean_ranks(spark.createDataFrame(pdf), ["parameter"], "value").toPandas().set_index(["parameter", "value"]).sort_index()
    want = pdf.assign(rank=pdf.groupby("parameter")["value"].rank()).groupby(["parameter", "value"])["rank"].first()
    assert (got["rank"] == want).all() and len(got) == len(want) and got.groupby("parameter")["total"].first().to_dict() == pdf["parameter"].value_counts().to_dict()


def test_rank_rhat_and_sizes(spark, chains):
    df = frame(spark, chains).unionByName(spark.createDataFrame([("short", 0, 0, i, float(i)) for i in range(3)] + [("fine", 0, 0, 10_000, None), ("fine", 0, 0, 10_001, float("nan")), ("fine", 0, 0, 10_002, float("inf"))], SCHEMA))
    r = {x["parameter"]: x for x in d.rank_rhat(df).collect()}
    s = {x["parameter"]: x for x in d.rank_sizes(df).collect()}
    assert set(r) == set(s) == {p for p, _ in chains}
    for (p, _), x in chains.items():
        y = split(x)
        assert np.isclose(r[p]["rhat_bulk"], rhat(scores(y))) and np.isclose(r[p]["rhat_tail"], rhat(scores(np.abs(y - np.median(y)))))
        assert np.isclose(s[p]["ess"], size(scores(y)))
        assert np.isclose(s[p]["tail_ess"], min(size((y <= np.quantile(y, q)).astype(float)) for q in (0.05, 0.95)))
    assert r["apart"]["rhat"] > 1.2 and r["wide"]["rhat_tail"] > 1.1 > r["wide"]["rhat_bulk"] and r["fine"]["rhat"] < 1.02 and s["slow"]["ess"] < 300 < s["fine"]["ess"]
    assert d.rank_rhat(df.limit(0)).count() == 0 == d.rank_sizes(df.limit(0)).count()


def test_chains_that_stand_still(spark):
    still = frame(spark, {("same", 0): np.ones((3, 10)), ("each", 0): np.repeat([[1.0], [2.0]], 10, axis=1), ("alone", 0): np.arange(8.0).reshape(1, 8)})
    r = {x["parameter"]: x["rhat"] for x in d.rank_rhat(still).collect()}
    assert r["same"] == 1.0 and r["each"] == float("inf") and r["alone"] > 1
    assert {x["parameter"]: x["ess"] for x in d.rank_sizes(still).collect()}["same"] == 60.0 / 2


def test_times_of_known_chains(spark):
    rng = np.random.default_rng(4)
    df = frame(spark, {("x", 0): ar1(rng, 8, 20_000, 0.8), ("x", 1): ar1(rng, 8, 20_000, 0.0), ("y", 0): np.ones((2, 50)), ("y", 1): ar1(rng, 2, 40, 0.5)})
    got = {(r["ensemble"], r["parameter"]): r for r in d.autocorrelation_times(df, ["x", "y", "z"]).collect()}
    assert len(got) == 6 and abs(got[0, "x"]["tau"] - 9) < 0.7 and abs(got[1, "x"]["tau"] - 1) < 0.1  # (1 + phi) / (1 - phi)
    assert (got[0, "y"]["available"], got[0, "y"]["error"], got[0, "y"]["tau"]) == (False, "nonfinite_autocorrelation_time", None)
    assert got[1, "z"]["error"] == "no_finite_draws" and got[1, "z"]["retained_steps"] == 0 and got[1, "y"]["available"] and got[0, "x"]["retained_steps"] == 20_000
    worst = d.worst_time(d.autocorrelation_times(df, ["x", "y"])).first()
    assert worst["unavailable_count"] == 1 and not worst["all_available"] and not worst["long_enough"]
    good = d.worst_time(d.autocorrelation_times(df.where("parameter = 'x'"), ["x"])).first()
    assert good["all_available"] and good["long_enough"] and abs(good["worst_tau"] - 9) < 0.7


def test_times_of_walkers_in_segments(spark):
    """Windows within the first segment, over several rounds of lags, and at no lag at all; walkers of several lengths."""
    rng = np.random.default_rng(6)
    cases = {("fast", 0): ar1(rng, 3, 300, 0.3), ("slow", 0): ar1(rng, 3, 900, 0.93), ("trend", 0): np.linspace(0, 1, 500) ** 2 + rng.normal(size=(2, 500)) * 0.01, ("short", 0): ar1(rng, 2, 5, 0.0)}
    df = frame(spark, cases).where("NOT (parameter = 'slow' AND walker = 0 AND step >= 610)").unionByName(frame(spark, {("still", 0): np.full((2, 30), 0.1)}))
    got = {r["parameter"]: r for r in d.autocorrelation_times(df, [*(p for p, _ in cases), "still"], segment=16).collect()}
    for (p, _), x in cases.items():
        mean = np.zeros(x.shape[1])
        for w, own in enumerate(x):
            own = own[:610] if (p, w) == ("slow", 0) else own
            c = own - own.mean()
            mean[: len(own)] += np.array([c[k:] @ c[: len(c) - k] for k in range(len(c))]) / (c @ c) / len(x)
        taus = 2 * np.cumsum(mean) - 1
        enough = np.flatnonzero(np.arange(len(mean)) >= 5 * taus)
        assert np.isclose(got[p]["tau"], taus[enough[0] if len(enough) else -1]) and got[p]["retained_steps"] == x.shape[1]
    assert got["still"]["error"] == "nonfinite_autocorrelation_time" and got["still"]["retained_steps"] == 30
