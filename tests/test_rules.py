"""Rules of a snapshot: a whole one passes, and each way to break it is found by the rule it breaks."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from transitspark.operators import rules

PERIOD, EPOCH = 3.5, 10.0


def good():
    accepted = [{"time": EPOCH + e * PERIOD + k / 48, "flux": 1.0, "flux_uncertainty": 1e-4, "event_number": e, "predicted_center": EPOCH + e * PERIOD, "product_id": f"p{e % 2}", "quarter": str(e % 2 + 1), "exposure_days": 0.02} for e in (0, 1, 3) for k in range(4)]
    audit = [{"event_number": e, "predicted_midpoint": EPOCH + e * PERIOD, "included": str(e != 2)} for e in range(4)]
    products = [{"product_id": f"p{k}", "quarter": str(k + 1), "exposure_duration_days": 0.02} for k in (0, 1, 2)]
    refined = {c: 0.25 + k for k, c in enumerate(rules.REFINED)}
    configuration = {"supersample_factor": 11, "paths": {"b": "x\\y", "a": [1, 2.5, True]}}
    record = {"run": "a/b", "k": 1}
    summary = {
        "transit_windows": {"included_count": 3, "predicted_count": 4}, "established_inputs": {"full_mission_local_refinement": {"refined_period_days": PERIOD, "refined_transit_time": EPOCH}}, "fitted_results": {"global_timing_refinement": dict(refined)},
        "acceptance_checks": {"published_physical_planet_parameters_used_or_compared": False}, "diagnostic_results": {"residual_summary": {"by_product": [{"product_id": "p0", "cadence_count": 4}, {"product_id": "p1", "cadence_count": 8}]}},
    }
    provenance = {"cadence_counts": {"phase1b_fit_cadence_count": 12}, "phase1b": {"configuration": {"paths": {"a": [1, 2.5, True], "b": "x/y"}, "supersample_factor": 11}, "phase1a_input_record": {"k": 1, "run": "a\\b"}}}
    return {"accepted": accepted, "audit": audit, "products": products, "parameters": [{"stage": "coarse"}, {"stage": "global_timing_refinement", **refined}], "limb": {"u": [0.3, 0.2]}, "configuration": configuration, "summary": summary, "provenance": provenance, "phase1a": record}


def write(folder, s):
    folder.mkdir(exist_ok=True)
    for t, n in {**rules.CSV_FILES, **rules.JSON_FILES, **rules.OPTIONAL_FILES}.items():
        if t not in s:
            (folder / n).unlink(missing_ok=True)
        elif n.endswith("csv"):
            names = list(dict.fromkeys(k for r in s[t] for k in r))
            (folder / n).write_text("\n".join([",".join(names), *(",".join(str(r.get(c, "")) for c in names) for r in s[t])]) + "\n")
        else:
            (folder / n).write_text(json.dumps(s[t], indent=2))
    return str(folder)


def test_a_whole_snapshot_passes(spark, tmp_path):
    tables = rules.frozen(spark, write(tmp_path / "a", good()))
    assert tables["accepted"].count() == 12 and tables["phase1a"].count() == 1
    s = good()
    del s["phase1a"], s["provenance"]["phase1b"]["phase1a_input_record"]
    del s["summary"]["diagnostic_results"]
    assert rules.frozen(spark, write(tmp_path / "a", s))["phase1a"].count() == 0
    del s["limb"]
    with pytest.raises(FileNotFoundError, match="limb"):
        rules.frozen(spark, write(tmp_path / "a", s))


def breaks():
    def put(path, value):
        def f(s):
            *way, last = path
            for k in way:
                s = s[k]
            s[last] = value

        return f

    def gone(path):
        def f(s):
            *way, last = path
            for k in way:
                s = s[k]
            del s[last]

        return f

    cases = [
        *((put(("accepted", 5, c), "nan"), {f"finite_{c}"}) for c in ("time", "flux", "flux_uncertainty", "predicted_center", "exposure_days")), *((put(("accepted", 5, c), "x"), {f"finite_{c}"}) for c in ("time", "event_number")), (put(("accepted", 5, "flux"), "inf"), {"finite_flux"}),
        (put(("accepted", 5, "flux_uncertainty"), 0), {"positive_flux_uncertainty"}), (put(("accepted", 5, "exposure_days"), -1), {"positive_exposure_days", "exposures_of_products"}), (put(("accepted", 5, "product_id"), " "), {"named_product_id", "products_are_known"}), (put(("accepted", 5, "quarter"), ""), {"named_quarter", "quarters_of_products"}),
        (put(("accepted", 5, "event_number"), 0.5), {"whole_event_number", "events_are_those_included"}), (lambda s: s["accepted"].append(dict(s["accepted"][0])), {"unique_time_event_number_product_id", "cadence_count"}), (lambda s: s["products"].append(dict(s["products"][2])), {"unique_product_id"}),
        (put(("accepted", 0, "predicted_center"), EPOCH + 1e-7), {"one_center_an_event"}), (put(("audit", 1, "predicted_midpoint"), EPOCH + PERIOD + 1e-6), {"centers_of_audit"}), (put(("summary", "established_inputs", "full_mission_local_refinement", "refined_period_days"), PERIOD + 1e-6), {"centers_of_ephemeris"}),
        (put(("audit", 2, "included"), "1"), {"included_count", "events_are_those_included"}), (put(("audit", 3, "included"), "no"), {"included_count", "events_are_those_included"}), (gone(("audit", 3)), {"events_are_predicted", "predicted_count"}), (put(("audit", 2, "event_number"), 2.5), {"whole_event_number"}),
        (put(("provenance", "cadence_counts"), {}), {"cadence_count"}), (gone(("products", 0)), {"products_are_known"}), (put(("products", 0, "quarter"), "9"), {"quarters_of_products"}), (put(("products", 2, "quarter"), "1.5"), {"whole_quarter"}), (put(("products", 2, "exposure_duration_days"), 0), {"positive_exposure"}),
        (put(("products", 0, "exposure_duration_days"), 0.021), {"exposures_of_products"}), (put(("summary", "diagnostic_results", "residual_summary", "by_product", 1, "cadence_count"), 7), {"residual_counts_of_products"}), (gone(("summary", "diagnostic_results", "residual_summary", "by_product", 0)), {"residual_counts_of_products"}),
        (put(("parameters", 1, "stage"), "other"), {"has_timing_refinement"}), *((put(("parameters", 1, c), 99), {f"refined_{c}_agrees"}) for c in rules.REFINED), (gone(("summary", "fitted_results", "global_timing_refinement", "q1")), {"refined_q1_agrees"}), (put(("configuration", "supersample_factor"), 0), {"positive_supersample", "configuration_of_provenance"}),
        (put(("summary", "acceptance_checks", "published_physical_planet_parameters_used_or_compared"), True), {"no_published_parameters"}), (put(("summary", "acceptance_checks"), {}), {"no_published_parameters"}), (put(("configuration", "paths", "a", 1), 2.6), {"configuration_of_provenance"}), (gone(("provenance", "phase1b", "configuration")), {"configuration_of_provenance"}),
        (gone(("phase1a",)), {"record_of_provenance"}), (gone(("provenance", "phase1b", "phase1a_input_record")), {"record_of_provenance"}), (put(("phase1a", "k"), 2), {"record_of_provenance"}), (lambda s: [r.pop("quarter") for r in s["accepted"]], {"has_columns"}), (lambda s: [r.pop("included") for r in s["audit"]], {"has_columns"}),
    ]
    return cases


def test_every_rule_is_broken_by_something():
    named = {r.name for r in rules.SNAPSHOT_RULES}
    assert named == set().union(*(names for _, names in breaks()))


def test_broken_snapshots(spark, tmp_path):
    """Each break is found by the rules that it breaks, with samples of the offenders."""

    def one(case):
        k, (spoil, expected) = case
        s = good()
        spoil(s)
        found = rules.report(spark, rules.read_frozen(spark, write(tmp_path / f"b{k}", s)), [r for r in rules.SNAPSHOT_RULES if r.name in expected]).collect()
        assert {r["rule"] for r in found if r["n_failed"]} == expected, (k, expected, found)
        assert all(r["samples"] for r in found if r["n_failed"])

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(one, enumerate(breaks())))


def test_what_cannot_be_verified_says_so(spark):
    t = {"a": spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")}
    made = [rules.Row("a", "r", "v = 'x'", ("v",)), rules.Row("a", "no_column", "w > 0", ("w",)), rules.Unique("b", ("k",)), rules.Columns("b", ("k",)), rules.SameSet("a", "k", "b", "k", "s")]
    got = {r["rule"]: r for r in rules.report(spark, t, made).collect()}
    assert (got["r"]["n_rows"], got["r"]["n_failed"], got["r"]["samples"]) == (2, 1, ['{"k":2}']) and all(got[n]["n_failed"] is None for n in ("no_column", "unique_k", "has_columns", "s"))
    with pytest.raises(ValueError, match="not verifiable"):
        rules.required(rules.report(spark, t, made[1:2]))
    assert rules.report(spark, t, []).count() == 0
