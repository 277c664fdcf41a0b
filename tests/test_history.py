import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from transitspark.operators import history, posterior, sampling
from transitspark.operators.history import History, centred, merged, state_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 250), min_size=1, max_size=5), st.integers(0, 10**6))
def test_merged_states_are_those_of_the_whole(sizes, seed):
    x = np.random.default_rng(seed).normal(1e6, 1, sum(sizes) + 1)
    cuts = np.cumsum([0, *sizes, 1])
    parts = [x[a:b] for a, b in zip(cuts[:-1], cuts[1:]) if b > a]
    s = state_of(parts[0], x[0])
    for p in parts[1:]:
        s = merged(s, state_of(p, x[0]))
    c = x - x.mean()
    assert np.allclose(centred(s), [c[: len(c) - k] @ c[k:] if k < len(c) else 0 for k in range(sampling.LAGS + 1)], atol=1e-6 * max(1, len(x)))


def chain(steps, seed=0):
    rng, rows = np.random.default_rng(seed), []
    for p, phi in (("slow", 0.9), ("fast", 0.1)):
        for e in range(2):
            for w in range(3):
                x = rng.normal(size=steps)
                for i in range(1, steps):
                    x[i] += phi * x[i - 1]
                rows.append(pd.DataFrame({"parameter": p, "ensemble": e, "walker": w, "step": np.arange(steps), "value": x + 50}))
    return pd.concat(rows)


def test_rows_are_those_of_the_whole_chain(spark, tmp_path):
    pdf = chain(600)
    df = spark.createDataFrame(pdf, "parameter string, ensemble int, walker int, step long, value double").repartition(3).cache()
    h = History(spark, f"{tmp_path}/h")
    assert h.rows().count() == 0
    ends = [150, 300, 330, 600]
    for a, b in zip([0, *ends], ends):
        assert h.append(df.where(f"step >= {a} AND step < {b}"), b)
    rows = {(r["steps"], r["parameter"]): r for r in h.rows().collect()}
    assert len(rows) == 8
    for b in ends:
        own = df.where(f"step < {b}")
        sizes = {r["parameter"]: r for r in sampling.effective_sizes(own).collect()}
        sums = {r["parameter"]: r for r in posterior.summary(own).collect()}
        for p in ("slow", "fast"):
            r = rows[b, p]
            assert np.allclose([r["n"], r["mean"], r["sd"], r["tau"], r["ess"]], [sums[p]["n"], sums[p]["mean"], sums[p]["sd"], sizes[p]["tau"], sizes[p]["ess"]])
            values = np.sort(pdf[(pdf["parameter"] == p) & (pdf["step"] < b)]["value"])
            for q, share in posterior.QUANTILES.items():
                assert abs(np.searchsorted(values, r[q]) / len(values) - share) < 0.01
    halved = {r["parameter"]: r["rhat"] for r in posterior.split_rhat(df).collect()}
    assert all(np.isclose(rows[600, p]["rhat"], halved[p]) for p in halved)  # 300 is the middle
    assert not h.append(df, 300) and len(h.done()) == 4
    with pytest.raises(ValueError, match="600"):
        h.append(df, 400)


def test_a_resume_reads_only_what_is_new(spark, tmp_path):
    df = spark.createDataFrame(chain(90, 3), "parameter string, ensemble int, walker int, step long, value double")
    h = History(spark, f"{tmp_path}/h")
    h.append(df.where("step < 40"), 40)

    def dies(batches):
        raise RuntimeError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        h.append(df.where("step >= 40").mapInPandas(dies, df.schema), 90)
    assert h.done() == [40]
    again = History(spark, f"{tmp_path}/h")
    odd = spark.createDataFrame([("fast", 0, 0, 95, float("nan")), ("fast", 0, 0, 96, None), ("new", 0, 0, 97, 1.0)], "parameter string, ensemble int, walker int, step long, value double")
    assert again.append(df.where("step >= 40").unionByName(odd), 90)
    got = {r["parameter"]: r for r in again.rows().where("steps = 90").collect()}
    tau = {r["parameter"]: r["tau"] for r in sampling.effective_sizes(df).collect()}
    assert np.isclose(got["fast"]["tau"], tau["fast"]) and got["slow"]["n"] == 540 and got["new"]["n"] == 1 and got["new"]["tau"] == float("inf")
    assert again.append(odd.where("step < 0"), 120) and again.rows().where("steps = 120 AND n = 540").count() == 2
