"""Sizes of ranks from ordered arrays of scores: chains that hang together for long, scores that are not broadcast, odd chains."""

import numpy as np
import pytest
from test_diagnostics import SCHEMA, ar1, frame, scores, size, split

from transitspark.operators import diagnostics as d


@pytest.fixture(scope="module")
def long_chains():
    rng = np.random.default_rng(11)
    return {("slow", 0): ar1(rng, 3, 1501, 0.995), ("trend", 0): np.linspace(0, 1, 900) ** 2 + rng.normal(size=(2, 900)) * 0.01, ("tied", 0): np.sign(ar1(rng, 2, 1200, 0.99)), ("fine", 0): rng.normal(size=(4, 700)), ("short", 0): ar1(rng, 2, 9, 0.0)}


@pytest.mark.parametrize(("segment", "most"), [(64, 10**6), (16_384, 10**6), (256, 0)])
def test_sizes_of_chains_that_hang_together_over_many_segments(spark, long_chains, segment, most):
    got = {r["parameter"]: r for r in d.rank_sizes(frame(spark, long_chains), segment=segment, most=most).collect()}
    assert set(got) == {p for p, _ in long_chains}
    for (p, _), x in long_chains.items():
        y = split(x)
        assert np.isclose(got[p]["ess"], size(scores(y)))
        assert np.isclose(got[p]["tail_ess"], min(size((y <= np.quantile(y, q)).astype(float)) for q in (0.05, 0.95)))


def test_draws_left_out_of_halves_have_no_rank(spark):
    """The last of an odd chain, one of two equal ones, and chains of three draws don't count among the ranked values."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2, 21))
    x[0, -1] = x[1, 5]
    rows = [("p", 0, w, i, float(v)) for w in (0, 1) for i, v in enumerate(x[w])] + [("p", 0, 1, 20, float(x[1, -1]))] * 2 + [("p", 1, 0, i, 9.0 - i) for i in range(3)]
    got = d.rank_sizes(spark.createDataFrame(rows, SCHEMA)).first()
    chains = [x[0, :10], x[0, 10:20], np.append(x[1], [x[1, -1]] * 2)[:11], np.append(x[1], [x[1, -1]] * 2)[11:22]]
    every = np.sort(np.concatenate(chains))
    low, high = np.searchsorted(every, every, "left"), np.searchsorted(every, every, "right")
    z = {v: d_ for v, d_ in zip(every, [_quantile((a + b + 1) / 2, len(every)) for a, b in zip(low, high)])}
    n = np.array([len(c) for c in chains])
    assert np.isclose(got["ess"], _ess([np.array([z[v] for v in c]) for c in chains], n))


def _quantile(rank, total):
    from statistics import NormalDist

    return NormalDist().inv_cdf((rank - 0.375) / (total + 0.25))


def _ess(chains, n):
    """Geyer's initial monotone sequence, lag by lag."""
    least = n.min()
    off = [c - c.mean() for c in chains]
    acov = np.array([np.mean([o[k:] @ o[: len(o) - k] / len(o) for o in off]) for k in range(least)])
    within = np.mean([o @ o / (len(o) - 1) for o in off])
    pooled = within * (least - 1) / least + np.var([c.mean() for c in chains], ddof=1)
    rho = 1 - (within - acov * least / (least - 1)) / pooled
    rho[0], total, before, t = 1.0, 0.0, np.inf, 0
    while t + 1 < least and rho[t] + rho[t + 1] >= 0:
        before = min(before, rho[t] + rho[t + 1])
        total, t = total + before, t + 2
    tau = -1 + 2 * total + (max(rho[t], 0) if t + 1 < least else 0)
    return min(n.sum() / max(tau, 1 / np.log10(n.sum())), n.sum() * np.log10(n.sum()))
