import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from transitspark.functions.ephemeris import Ephemeris, near_events, phase, predicted_events
from transitspark.sources import files, light_curves
from transitspark.operators import cleaning, events, posterior, recovery, residuals, sampling, search, snapshots, transit, windows

SCHEMA = "target_id long, product_id string, cadence_id long, time double, flux double, flux_err double"


def curve(spark, time, flux, target=1, err=1e-3):
    n = len(time)
    pdf = pd.DataFrame({"target_id": target, "product_id": ["a", "b"] * (n // 2) + ["a"] * (n % 2), "cadence_id": np.arange(n), "time": time, "flux": flux, "flux_err": err})
    return spark.createDataFrame(pdf, SCHEMA)


def dipped(t, e, depth):
    ph = np.mod(t - e.epoch + e.period / 2, e.period) - e.period / 2
    return 1 - depth * (np.abs(ph) <= e.duration / 2)


def test_known_depth_is_recovered(spark):
    e, rng = Ephemeris(3.0, 0.5, 0.1), np.random.default_rng(42)
    t = np.arange(0, 30, 0.02)
    f = dipped(t, e, 0.02) + rng.normal(0, 5e-4, len(t))
    f[[100, 500, 900]] += 0.2
    clean = cleaning.preprocess(curve(spark, t, f), "positive_only", 5.0).where("is_retained").withColumn("flux", F.col("flux_norm"))
    r = recovery.known_signal(clean, e).first()
    assert abs(r["depth"] - 0.02) < 0.001 and r["snr"] > 10


def test_windows_take_out_a_trend(spark):
    e = Ephemeris(3.5, 0.5, 0.2)
    t = np.arange(0, 40, 0.02)
    r = recovery.windowed_signal(curve(spark, t, dipped(t, e, 0.0072) * (1 + 0.0015 * np.sin(2 * np.pi * t / 18))), e, 0.35).first()
    assert r["depth"] > 0.006 and r["snr"] > 10


def test_protected_clipping_keeps_the_dip(spark):
    e, t = Ephemeris(3.0, 0.5, 0.1), np.arange(0, 30, 0.02)
    f = dipped(t, e, 0.05) + np.random.default_rng(1).normal(0, 1e-3, len(t))
    flags = {m: cleaning.clip(curve(spark, t, f), m, 5.0, e).where("is_clipped").count() for m in ("symmetric", "transit_protected_symmetric", "positive_only", "none")}
    assert flags["symmetric"] > 20 and flags["transit_protected_symmetric"] == flags["positive_only"] == flags["none"] == 0


def test_clipping_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    f = np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 20, 40), [np.nan, np.inf]])
    keep = np.isfinite(f)
    for _ in range(cleaning.ROUNDS):
        m, s = np.median(f[keep]), np.std(f[keep])
        keep = keep & (np.abs(f - m) <= 3 * s)
    got = cleaning.clip(curve(spark, np.arange(len(f), dtype=float), f), "symmetric", 3.0).orderBy("cadence_id").toPandas()
    assert (got["is_retained"].to_numpy() == keep).all()


def test_modes_are_checked(spark):
    df = curve(spark, [0.0], [1.0])
    with pytest.raises(ValueError):
        cleaning.clip(df, "other", 3.0)
    with pytest.raises(ValueError):
        cleaning.clip(df, "transit_protected_symmetric", 3.0)


@settings(max_examples=8, deadline=None)
@given(st.floats(0.3, 4), st.floats(-5, 5), st.floats(0.05, 3))
def test_arithmetic_finds_the_events_of_a_range_join(spark, period, epoch, half):
    e, t = Ephemeris(period, epoch, 0.1), np.linspace(-3, 3, 41)
    df = curve(spark, t, np.ones_like(t))
    got = {(r["cadence_id"], r["cycle"]) for r in near_events(df, e, half).collect()}
    n = np.arange(-60, 61)
    far = np.abs(t[:, None] - (epoch + n * period))
    assert {(int(i), int(n[k])) for i, k in zip(*np.nonzero(far < half - 1e-9))} <= got <= {(int(i), int(n[k])) for i, k in zip(*np.nonzero(far <= half + 1e-9))}


def test_phase_and_centers(spark):
    e = Ephemeris(2.0, 10.0, 0.1)
    df = curve(spark, [10.0, 12.0, 14.0], [1.0] * 3)
    assert [r[0] for r in df.select(phase(F.col("time"), e)).collect()] == [0.0] * 3
    assert [r["center"] for r in predicted_events(df, e).orderBy("center").collect()] == [10.0, 12.0, 14.0]
    assert predicted_events(curve(spark, [10.5, 11.0], [1.0, 1.0]), e).count() == 0  # none within the span
    assert predicted_events(df.limit(0), e).count() == 0


def test_search_finds_an_injected_period(spark):
    rng, e = np.random.default_rng(123), Ephemeris(9.75, 2.2, 0.22)
    t = np.arange(0, 180, 0.08)
    t = t[~(((t > 44) & (t < 49)) | ((t > 101) & (t < 108)) | ((t > 150) & (t < 153)))]
    df = curve(spark, t, dipped(t, e, 0.015) + rng.normal(0, 8e-4, len(t)))
    c = search.SearchConfig(min_period=2, max_period=30, min_duration=2 / 24, max_duration=10 / 24, n_durations=5, n_periods=450)
    peaks = search.distinct_peaks(search.periodogram(df, search.period_grid(df, c), c), 4).orderBy("rank").toPandas()
    best = peaks["period"][0]
    assert min(abs(best * k / e.period - 1) for k in (1, 2, 3)) < 0.03  # the coarse grid often prefers a fraction
    near = spark.createDataFrame([(1, 1, e.period, 0.12, float(t.max() - t.min()))], "target_id long, rank int, period double, step double, span double")
    local = search.periodogram(df, search.local_grid(near, search.SearchConfig(**{**c.__dict__, "local_cap": 1200})), c).orderBy(F.desc("power")).first()
    assert abs(local["period"] - e.period) < 0.02 and abs(local["duration"] - e.duration) < 0.12 and abs(local["depth"] - 0.015) < 0.004


def test_power_scales_with_the_square_of_the_dip():
    rng = np.random.default_rng(5)
    t, y = np.sort(rng.uniform(0, 20, 300)), rng.normal(0, 1, 300)
    c = search.SearchConfig(n_durations=2)
    boxes = search.Boxes(c)
    for p in (1.7, 2.3):
        one, two = (boxes.best(*boxes.fold(t, k * (y - np.median(y)), p), p, 300, k * (y - np.median(y)).sum(), 0.0)[0] for k in (1, 2))
        assert one > 0 and np.isclose(two, 4 * one)


def test_peaks_and_families(spark):
    df = spark.createDataFrame([(1, p, w) for p, w in ((10.0, 5.0), (10.03, 4.9), (20.0, 4.0), (30.0, 3.0))], "target_id long, period double, power double")
    assert [r["period"] for r in search.distinct_peaks(df).orderBy("rank").collect()] == [10.0, 20.0, 30.0]
    df = spark.createDataFrame([(1, k + 1, p) for k, p in enumerate((10.0, 5.0, 20.0, 30.0, 10 / 3, 17.0))], "target_id long, rank int, period double")
    got = search.harmonic_families(df).orderBy("rank").collect()
    assert [r["family"] for r in got] == [1] * 5 + [2]
    assert [r["relation"] for r in got] == ["1", "1/2", "2", "3", "1/3", "1"]


@pytest.mark.parametrize("odd, even, scatter, expected", [(45e-6, 7e-6, 2563e-6, "none"), (4000e-6, 1000e-6, 900e-6, "ratio_and_absolute_difference"), (9000e-6, 6000e-6, 900e-6, "absolute_difference_only")])
def test_odd_even_trigger(spark, odd, even, scatter, expected):
    # four events whose population deviation is the scatter, around two medians
    spread = math.sqrt(max(scatter**2 - (odd - even) ** 2 / 4, 0))
    rows = [(1, True, "odd", odd + s * spread) for s in (-1, 1)] + [(1, True, "even", even + s * spread) for s in (-1, 1)]
    df = spark.createDataFrame(rows, "target_id long, usable boolean, parity string, depth double")
    r = events.odd_even(df).first()
    if spread:
        assert r["trigger"] == expected
    else:
        assert r["ratio"] is not None


def test_window_audit_says_why(spark):
    e = Ephemeris(5.0, 1.0, 0.19)
    t = np.concatenate([1 + 5 * k + np.arange(-0.55, 0.55, 0.0204) for k in range(7)])
    t = t[~((t > 5.8) & (t < 6.2)) & ~((t > 11.2) & (t < 11.6)) & ~((t > 15.4) & (t < 15.9))]
    audit = windows.window_audit(curve(spark, t, np.ones_like(t)), e).orderBy("event_number").toPandas()
    assert not audit["included"][1] and "too_few_expected_in_transit_points" in audit["exclusion_reasons"][1]
    assert "too_few_post_transit_baseline_points" in audit["exclusion_reasons"][2] and "too_few_pre_transit_baseline_points" in audit["exclusion_reasons"][3]
    assert audit["included"][[0, 4, 5]].all()


def test_baselines_and_likelihood(spark):
    x = np.array([-0.2, -0.05, 0.05, 0.2])
    pdf = pd.DataFrame({"target_id": 1, "event_number": 0, "offset": x, "flux": 1.02 - 0.01 * x, "flux_err": [1e-3, 2e-3, 1e-3, 3e-3], "m": [1.0, 0.99, 0.99, 1.0]})
    pdf["flux"] *= pdf["m"]
    df = spark.createDataFrame(pdf)
    r = residuals.event_baselines(df, "m").first()
    assert abs(r["intercept"] - 1.02) < 1e-9 and abs(r["slope"] + 0.01) < 1e-9
    got = residuals.event_log_likelihood(df, "m", 1e-3).first()["log_likelihood"]
    m, xs = pdf["m"].to_numpy(), x / 0.2
    cov = np.diag(pdf["flux_err"] ** 2 + 1e-6) + 0.05**2 * np.outer(m, m) + 0.05**2 * np.outer(m * xs, m * xs)
    d = pdf["flux"].to_numpy() - m
    dense = -0.5 * (d @ np.linalg.solve(cov, d) + np.linalg.slogdet(cov)[1] + 4 * np.log(2 * np.pi))
    assert got == pytest.approx(dense, rel=1e-9)


def test_residual_statistics_are_those_of_numpy(spark):
    rng = np.random.default_rng(9)
    r = rng.normal(0, 1, 200)
    df = spark.createDataFrame(pd.DataFrame({"target_id": 1, "event_number": np.repeat([0, 1], 100), "cadence_id": np.arange(200), "time": np.arange(200.0), "residual": r}))
    c = r - r.mean()
    got = residuals.autocorrelation(df, 5).orderBy("lag").toPandas()["acf"]
    assert np.allclose(got, [(c[:-k] * c[k:]).sum() / (c**2).sum() for k in range(1, 6)])
    b = residuals.binned_scatter(df, (8,)).first()
    means = np.concatenate([r[s : s + 96].reshape(-1, 8).mean(axis=1) for s in (0, 100)])
    assert b["n_blocks"] == 24 and b["rms"] == pytest.approx(means.std(ddof=1))


def test_obscured_light():
    z = np.linspace(0, 1.2, 50)
    assert np.allclose(transit.obscured(np.array([0.0, 0.5]), 0.1, 0.0, 0.0), 0.01)
    fine, transit.NODES = transit.NODES, np.polynomial.legendre.leggauss(400)
    exact = transit.obscured(z, 0.1, 0.4, 0.2)
    transit.NODES = fine
    assert np.abs(transit.obscured(z, 0.1, 0.4, 0.2) - exact).max() < 1e-8
    assert (transit.obscured(np.array([1.1, 2.0, np.inf]), 0.1, 0.4, 0.2) == 0).all()


def _observations(noise):
    timing, rng = transit.Timing(5.0, 1.0), np.random.default_rng(2)
    t = np.concatenate([1 + 5 * k + np.arange(-0.55, 0.55, 0.0204) for k in range(7)])
    event, truth = np.repeat(np.arange(7), len(t) // 7), np.array([0.1, 9.0, 0.35, 0.36, 1 / 3])
    x = t - (1 + 5 * event)
    y = transit.model_flux(t, 0.0204, truth, timing) * (1 + 0.002 * (event - 3) + 0.003 * x) + rng.normal(0, noise, len(t)) if noise else transit.model_flux(t, 0.0204, truth, timing)
    return timing, t, event, x, y


def test_fit_recovers_the_planet(spark):
    timing, t, event, x, y = _observations(3e-4)
    pdf = pd.DataFrame({"target_id": 1, "cadence_id": np.arange(len(t)), "time": t, "flux": y, "flux_err": 3e-4, "event_number": event, "offset": x})
    r = transit.fit_targets(spark.createDataFrame(pdf), timing, 0.19, 0.0204, n_starts=3).first()
    assert abs(r["rp"] - 0.1) < 0.025 and abs(r["a"] - 9.0) < 1.5


def test_exposures_differ_by_cadence(spark):
    """Short and long cadences of one target: with each one's own exposure the planet is found, with one for all it isn't as well."""
    timing, theta = transit.Timing(3.0, 1.0), np.array([0.1, 9.0, 0.3, 0.36, 1 / 3])
    t = np.concatenate([1 + 3 * k + np.linspace(-0.25, 0.25, 60) for k in range(4)])
    long = np.where(np.arange(len(t)) % 2 == 0, 0.002, 0.06)
    y = transit.model_flux(t, long, theta, timing)
    assert np.allclose(y[::2], transit.model_flux(t[::2], 0.002, theta, timing))
    pdf = pd.DataFrame({"target_id": 1, "cadence_id": np.arange(len(t)), "time": t, "flux": y, "flux_err": 1e-4, "event_number": np.repeat(np.arange(4), 60), "offset": np.tile(np.linspace(-0.25, 0.25, 60), 4), "exposure": long})
    df = spark.createDataFrame(pdf)
    own = transit.fit_targets(df, timing, 0.11, 0.02, n_starts=2).first()
    one = transit.fit_targets(df.drop("exposure"), timing, 0.11, 0.02, n_starts=2).first()
    assert abs(own["rp"] - 0.1) < 0.005 and own["objective"] < one["objective"]
    parts = transit.stability_fits(df.withColumn("quarter", F.lit("q1")), timing, 0.11, 0.02, "quarter", n_starts=1)
    rows = {r["subset"]: r for r in parts.collect()}
    assert set(rows) == {"early_mission", "late_mission", "quarter_q1"} and {r["status"] for r in rows.values()} == {transit.FITTED_SUBSET}
    assert rows["early_mission"]["n_cadences"] + rows["late_mission"]["n_cadences"] == rows["quarter_q1"]["n_cadences"] == df.count() and abs(rows["quarter_q1"]["rp"] - 0.1) < 0.01
    few = df.orderBy("time").limit(30).unionByName(df.orderBy("time").limit(60).withColumn("target_id", F.lit(77).cast("long")).withColumn("event_number", F.lit(0).cast("long")))
    thin = transit.stability_fits(few.withColumn("quarter", F.lit(None).cast("string")), timing, 0.11, 0.02, "quarter", n_starts=1).collect()
    assert len(thin) == 4 and all(r["status"] == transit.SKIPPED_SUBSET and r["rp"] is None for r in thin)  # too few cadences, or one event


def test_warnings_on_starts(spark):
    rows = [(1, 0, 0.1, 9.0, 0.3, 0.3, 0.3, 0.0, 10.0, 50, ""), (1, 1, 0.13, 9.0, 0.3, 0.3, 0.3, 0.0, 11.5, 50, ""), (2, 0, 0.1, 9.0, 0.0, 0.3, 0.3, 0.0, 10.0, 50, "b_lower"), (2, 1, 0.2, 9.0, 0.3, 0.3, 0.3, 0.0, 13.0, 50, "")]
    each = spark.createDataFrame(rows, "target_id long, start int, rp double, a double, b double, q1 double, q2 double, jitter double, objective double, n long, boundary_hits string")
    got = {r["target_id"]: r["warnings"] for r in transit.best_fits(each).collect()}
    assert got == {1: "materially_different_near_equal_multistart_solutions", 2: "one_or_more_optimizer_solutions_hit_bounds"}


def test_exposure_sampling_converges():
    timing = transit.Timing(5.0, 1.0)
    t, theta = np.arange(0.8, 1.2, 0.005), np.array([0.1, 9.0, 0.35, 0.36, 1 / 3])
    assert np.abs(transit.model_flux(t, 0.0204, theta, timing, 15) - transit.model_flux(t, 0.0204, theta, timing, 25)).max() < 2e-5


def test_priors_integrate_to_one():
    j = np.linspace(1e-8, 0.02, 100_001)
    p = np.exp([sampling.bounded_half_normal(v, 0.004, 1e-8, 0.02) for v in j])
    assert np.trapezoid(p, j) == pytest.approx(1, rel=2e-5)
    q = np.linspace(0, 1, 20_001)
    assert np.trapezoid(np.exp([sampling.truncated_normal(v, 0.36, 0.08) for v in q]), q) == pytest.approx(1, rel=1e-5)


def test_a_chain_in_two_chunks_is_the_chain_in_one(spark, tmp_path):
    timing, t, event, x, y = _observations(3e-4)
    keep = event < 3
    pdf = pd.DataFrame({"target_id": 1, "cadence_id": np.arange(len(t)), "time": t, "flux": y, "flux_err": 3e-4, "event_number": event, "offset": x})[keep]
    c = sampling.SamplerConfig(ensembles=2, walkers=16, supersample=3)
    center = [math.log(0.1), math.log(9.0), 0.3, 0.36, 0.33, math.log(3e-4), 0.0, 0.0]
    centers = spark.createDataFrame([(1, *center)], "target_id long, " + ", ".join(f"{p} double" for p in sampling.PARAMETERS))
    df = spark.createDataFrame(pdf)
    whole = sampling.run(df, centers, timing, c, 4, 4, str(tmp_path / "a")).orderBy("ensemble", "walker", "step").toPandas()
    parts = sampling.run(df, centers, timing, c, 4, 2, str(tmp_path / "b")).orderBy("ensemble", "walker", "step").toPandas()
    assert len(whole) == 2 * 16 * 4 and np.allclose(whole.to_numpy(float), parts.to_numpy(float))
    again = sampling.run(df, centers, timing, c, 4, 2, str(tmp_path / "b"))  # nothing is drawn anew
    assert again.count() == len(parts)


def test_a_chain_goes_on_with_other_chunks_but_not_with_other_data(spark, tmp_path):
    timing, t, event, x, y = _observations(3e-4)
    keep = event < 2
    pdf = pd.DataFrame({"target_id": 1, "cadence_id": np.arange(len(t)), "time": t, "flux": y, "flux_err": 3e-4, "event_number": event, "offset": x})[keep]
    c = sampling.SamplerConfig(ensembles=1, walkers=16, supersample=3)
    center = [math.log(0.1), math.log(9.0), 0.3, 0.36, 0.33, math.log(3e-4), 0.0, 0.0]
    centers = spark.createDataFrame([(1, *center)], "target_id long, " + ", ".join(f"{p} double" for p in sampling.PARAMETERS))
    df, at = spark.createDataFrame(pdf), str(tmp_path / "c")
    order = ["ensemble", "walker", "step"]
    assert sampling.run(df, centers, timing, c, 3, 2, at).select("step").distinct().count() == 3  # steps 1-2 and 3-3
    longer = sampling.run(df, centers, timing, c, 6, 4, at).orderBy(*order).toPandas()  # and 4-6
    whole = sampling.run(df, centers, timing, c, 6, 6, str(tmp_path / "d")).orderBy(*order).toPandas()
    assert sorted(set(longer["step"])) == [1, 2, 3, 4, 5, 6] and np.allclose(longer.to_numpy(float), whole.to_numpy(float))
    assert sampling.run(df, centers, timing, c, 2, 2, str(tmp_path / "d")).select("step").distinct().count() == 2  # part of a chunk
    for other in ((df.withColumn("flux", F.col("flux") + 1e-6), timing, c), (df, transit.Timing(timing.period + 1e-9, timing.epoch), c), (df, timing, sampling.SamplerConfig(ensembles=1, walkers=18, supersample=3))):
        with pytest.raises(ValueError, match="other data"):
            sampling.run(other[0], centers, *other[1:], 3, 2, at)


def test_refined_candidates_come_closer(spark):
    e, rng = Ephemeris(9.7, 2.0, 0.25), np.random.default_rng(5)
    t = np.arange(0, 80, 0.02)
    df = curve(spark, t, dipped(t, e, 0.01) + rng.normal(0, 5e-4, len(t)))
    c = search.SearchConfig(min_period=5.0, max_period=20.0, n_periods=80, n_durations=5, local_cap=400)
    coarse = spark.createDataFrame([(1, 1, 9.75, 0.01, 0.2, 2.0, 0.1), (1, 2, 14.0, 0.005, 0.2, 1.0, 0.1)], "target_id long, rank int, period double, power double, duration double, transit_time double, step double")
    got = {r["coarse_rank"]: r for r in search.refine(df, coarse, c).collect()}
    best = got[1]
    assert best["refined_rank"] == 1 and got[2]["refined_rank"] == 2
    assert abs(best["refined_period"] - 9.7) < 0.02 and abs(best["refined_duration"] - 0.25) <= 0.04
    assert best["drift_of_duration"] <= c.drift + 0.02 and best["n_periods"] <= 400 and best["n_events"] == 9
    assert "maximum_boundary" not in best["warnings"]
    three = {r["alias"]: r for r in search.aliases(df, got_frame(spark, best), c).collect()}
    assert three["P"]["power"] > three["P/2"]["power"] if three["P/2"]["valid"] else True
    assert not three["P/2"]["valid"] and three["P/2"]["power"] is None and three["2P"]["valid"] and three["P/2"]["n_events"] is three["P/2"]["inconsistent"] is None
    for name in ("P", "2P"):  # each like a single ephemeris
        r = three[name]
        own = events.event_diagnostics(df, Ephemeris(r["period"], r["transit_time"], r["duration"]))
        want = events.odd_even(own).first()
        assert (r["n_events"], r["n_odd"], r["n_even"], r["trigger"]) == (own.count(), want["n_odd"], want["n_even"], want["trigger"])
        assert [r[x] is None or math.isclose(r[x], want[x]) for x in ("odd_depth", "even_depth", "difference", "ratio", "scatter")] == [True] * 5


def got_frame(spark, row):
    return spark.createDataFrame([(row["target_id"], row["refined_period"])], "target_id long, period double")


def test_convergence_needs_all_criteria(spark):
    rng = np.random.default_rng(1)
    rows = [(e, w, s, p, float(rng.normal())) for p in ("a", "b") for e in range(2) for w in range(6) for s in range(400)]
    draws = spark.createDataFrame(rows, "ensemble int, walker int, step int, parameter string, value double")
    sizes, rhat, agrees = sampling.effective_sizes(draws), posterior.split_rhat(draws), posterior.agreement(draws)
    stable, finite = spark.createDataFrame([(True,)], "stable boolean"), spark.createDataFrame([(True,)] * 3, "is_finite boolean")
    held = lambda *a, **k: {r["criterion"]: r["holds"] for r in posterior.criteria(*a, **k).collect()}
    fine = held(rhat, sizes, stable, agrees, finite, ["a", "b"], 400)
    assert len(fine) == 11 and all(fine.values())
    assert not held(rhat, sizes, stable, agrees, finite, ["a", "b", "c"], 400)["complete_valid_rhat"]
    assert not held(rhat, sizes, stable, agrees, finite, ["a", "b"], 10)["chain_length_exceeds_tau_multiple"]
    assert not held(rhat, sizes, stable.limit(0), agrees, finite, ["a", "b"], 400)["posterior_summary_stability"]
    assert not held(rhat, sizes, stable, agrees, finite.unionByName(spark.createDataFrame([(False,)], "is_finite boolean")), ["a", "b"], 400)["finite_log_probability_fraction_is_one"]


def test_convergence_measures(spark):
    rng = np.random.default_rng(0)
    rows = [(e, w, s, "p", float(rng.normal() + 1.0 * e)) for e in range(2) for w in range(4) for s in range(40)]
    df = spark.createDataFrame(rows, "ensemble int, walker int, step int, parameter string, value double")
    assert posterior.split_rhat(df).first()["rhat"] > 1.05
    assert posterior.split_rhat(df.where("ensemble = 0")).first()["rhat"] < 1.05
    ten = df.where("ensemble = 0").withColumn("ensemble", F.explode(F.array(*map(F.lit, range(10)))))
    far = posterior.agreement(ten.withColumn("value", F.col("value") + F.when(F.col("ensemble") == 9, 100).otherwise(0)))
    assert [r["ensemble"] for r in far.where("not agrees").collect()] == [9]
    ess = sampling.effective_sizes(df.where("ensemble = 0")).first()
    assert 50 < ess["ess"] <= 160


def test_effective_sizes_count_draws_of_walkers_that_share_no_step(spark):
    rng = np.random.default_rng(1)
    chains = []
    for w in range(5):
        x = rng.normal(size=150 + 30 * w)
        for k in range(1, len(x)):
            x[k] += 0.6 * x[k - 1]
        chains.append(x)
    rows = [(w % 2, w, 5 * k + w, "p", float(v)) for w, x in enumerate(chains) for k, v in enumerate(x)]
    got = sampling.effective_sizes(spark.createDataFrame(rows, "ensemble int, walker int, step int, parameter string, value double")).first()

    def tau(xs):
        xs, total = [x - x.mean() for x in xs], 0.0
        var = np.mean(np.concatenate(xs) ** 2)
        for lag in range(1, 101):
            rho = np.mean(np.concatenate([x[:-lag] * x[lag:] for x in xs])) / var
            if rho <= 0:
                break
            total += rho
        return 1 + 2 * total

    every = np.concatenate(chains)
    low, high = np.quantile(every, [0.05, 0.95])
    tail = max(tau([(x <= low).astype(float) for x in chains]), tau([(x >= high).astype(float) for x in chains]))
    assert got["tau"] == pytest.approx(tau(chains)) and got["ess"] == pytest.approx(len(every) / tau(chains))
    assert got["tail_ess"] == pytest.approx(len(every) / tail)


def test_snapshot_checks(spark):
    e = Ephemeris(2.0, 1.0, 0.2)
    rows = [(1, "p", 1.0, 1.0, 0.1, 0, 1.0), (1, "p", 1.0, 1.0, 0.1, 0, 1.0), (1, " ", float("nan"), 1.0, 0.0, -1, 1.0), (1, "p", 3.0, 1.0, 0.1, 1, 3.1)]
    df = spark.createDataFrame(rows, "target_id long, product_id string, time double, flux double, flux_err double, event_number long, center double")
    v = snapshots.violations(df).first()
    assert (v["not_finite"], v["not_positive"], v["blank_product"], v["negative_event"]) == (1, 1, 1, 1)
    assert snapshots.duplicate_keys(df).count() == 1
    ev = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 3.0)], "target_id long, event_number long, cycle long, center double")
    got = {r["event_number"]: r for r in snapshots.center_checks(df, ev, e).collect()}
    assert got[0]["predicted"] and not got[1]["predicted"] and not got[-1]["ephemeris"]


def test_empty_and_single_rows(spark):
    e = Ephemeris(2.5, 0.4, 0.4)
    one = curve(spark, [1.0], [1.0])
    for df in (one, one.limit(0)):
        assert recovery.known_signal(df, e).count() == 0
        assert windows.accepted_cadences(df, e).count() == 0
        assert events.odd_even(events.event_diagnostics(df, e)).count() == 0
        assert cleaning.split_summary(cleaning.chronological_split(df, 0.7)).count() == df.count()
        c = search.SearchConfig(n_periods=5)
        assert search.periodogram(df, search.period_grid(df, c), c).count() == 0


def test_missing_values_and_order_change_nothing(spark):
    e, t = Ephemeris(2.5, 0.4, 0.4), np.arange(0, 20, 0.05)
    df = curve(spark, t, dipped(t, e, 0.01) + 1e-4 * np.sin(7 * t))
    noisy = df.unionByName(df.limit(30).withColumn("flux", F.lit(float("nan")))).repartition(7)
    ok = cleaning.clip(noisy, "none", 5.0).where("is_retained")
    a, b = (sorted(map(tuple, events.event_diagnostics(x.select(*df.columns), e).collect())) for x in (df, ok))
    assert a == b


def test_manifests_and_snapshots(spark, tmp_path):
    (tmp_path / "one.csv").write_text("target_id,event_number,cadence_id,product_id,time,flux,flux_err,center\n1,0,5,a,1.5,0.99,0.001,1.4\n")
    (tmp_path / "fit.json").write_text('{"period": 2.5,\n "events": 1}')
    before = files.checksums(spark, str(tmp_path)).toPandas()
    assert set(before["name"]) == {"one.csv", "fit.json"} and before.set_index("name").loc["fit.json", "bytes"] == 29
    accepted, summary = files.read_snapshot(spark, str(tmp_path / "one.csv"), str(tmp_path / "fit.json"))
    assert accepted.first()["time"] == 1.5 and summary.first()["events"] == 1
    (tmp_path / "one.csv").write_text("target_id,event_number,cadence_id,product_id,time,flux,flux_err,center\n")
    (tmp_path / "new.txt").write_text("x")
    (tmp_path / "fit.json").unlink()
    states = files.changed(spark.createDataFrame(before), files.checksums(spark, str(tmp_path))).collect()
    assert {(r["name"], r["state"]) for r in states} == {("one.csv", "changed"), ("new.txt", "new"), ("fit.json", "missing")}
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path / "one.csv"), str(tmp_path / "new.txt"))


def test_light_curves_from_parquet(spark, tmp_path):
    df = curve(spark, np.arange(4.0), np.ones(4))
    df.unionByName(df.withColumn("target_id", F.lit(2).cast("long"))).write.parquet(str(tmp_path / "lc"))
    assert light_curves.read_light_curves(spark, str(tmp_path / "lc"), [2]).select("target_id").distinct().collect()[0][0] == 2
    with pytest.raises(ValueError):
        light_curves.read_light_curves(spark, str(tmp_path / "lc"), [3])
    assert light_curves.stitch([df, df.drop("flux_err")]).where("flux_err is null").count() == 4


def test_baselines_of_least_norm_where_a_line_is_open(spark):
    rows = [(1, 0, 0.5, 2.0, 0.1, 1.0), (1, 0, 0.5, 2.2, 0.2, 1.0), (1, 1, -0.3, 1.5, 0.1, 0.9), (1, 2, 0.1, 1.0, 0.1, 0.0), (1, 2, 0.2, 1.0, 0.1, 0.0), (1, 3, 0.0, 1.0, 0.1, 1.0), (1, 3, 0.1, 1.2, 0.1, 1.0), (1, 3, 0.2, 1.3, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "target_id long, event_number long, offset double, flux double, flux_err double, model double")
    got = {r["event_number"]: (r["intercept"], r["slope"]) for r in residuals.event_baselines(df, "model").collect()}
    for event in range(4):
        x, y, s, m = (np.array([r[k] for r in rows if r[1] == event]) for k in (2, 3, 4, 5))
        want = np.linalg.lstsq(np.column_stack([m, m * x]) / s[:, None], y / s, rcond=None)[0]
        assert np.allclose(got[event], want), event


def test_ties_of_products_go_by_their_first_time(spark):
    e, t = Ephemeris(10.0, 5.0, 1.0), np.arange(2.0, 8.0, 0.1)
    pdf = pd.DataFrame({"target_id": 1, "product_id": np.where(np.arange(len(t)) % 2 == 0, "z", "a"), "cadence_id": np.arange(len(t)), "time": t, "flux": 1.0, "flux_err": 0.1})
    assert windows.window_audit(spark.createDataFrame(pdf, SCHEMA), e).first()["source_products"] == "z;a"


def test_clipping_buffers_no_target(spark):
    """Bounds come from counts: no plan has a window over a target, and rounds end as they do one by one."""
    from transitspark.operators import cleaning

    rng = np.random.default_rng(12)
    flux = np.concatenate([np.round(rng.normal(50, 5, 400), 1), [500.0, -300.0, 90.0, 15.0, float("nan")]])
    rows = [(t, i, float(i), float(x)) for t in (1, None) for i, x in enumerate(flux)] + [(2, i, float(i), 7.0) for i in range(5)]
    df = spark.createDataFrame(rows, "target_id long, cadence_id long, time double, flux double")
    for mode in ("symmetric", "positive_only"):
        got = cleaning.preprocess(df, mode, 2.5)
        assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
        kept = ~np.isnan(flux)
        for _ in range(cleaning.ROUNDS):
            m, s = np.median(flux[kept]), flux[kept].std()
            kept &= ~((flux > m + 2.5 * s) | ((flux < m - 2.5 * s) & (mode == "symmetric")))
        found = got.collect()
        for t in (1, None):
            own = {r["cadence_id"]: r for r in found if r["target_id"] == t}
            assert len(own) == len(flux) and [own[i]["is_retained"] for i in range(len(flux))] == kept.tolist() and own[0]["flux_median"] == np.median(flux[kept])
        assert all(r["is_retained"] and r["flux_norm"] == 1.0 for r in found if r["target_id"] == 2)
