import pytest

from transitspark.operators import metadata as m
from transitspark.sources import fits

PRODUCTS = "target_id long, at int, cadence string, meta map<string, string>"


def test_exposures_by_precedence(spark):
    cases = [
        ({"INT_TIME": "6.02", "NUM_FRM": "270", "FRAMETIM": "6.5", "TIMEDEL": "1"}, "long", ("INT_TIME;NUM_FRM", "INT_TIME=6.02;NUM_FRM=270", "INT_TIME_seconds * NUM_FRM / 86400", 6.02 * 270 / 86400, "")),
        ({"FRAMETIM": "6.5", "NUM_FRM": "270", "INT_TIME": None, "TIMEDEL": "1"} | {}, "long", None),
        ({"FRAMETIM": "6.5", "NUM_FRM": "270", "TIMEDEL": "1"}, "long", ("FRAMETIM;NUM_FRM", "FRAMETIM=6.5;NUM_FRM=270", "FRAMETIM_seconds * NUM_FRM / 86400", 6.5 * 270 / 86400, "frame_time_used_when_integration_time_missing")),
        ({"INT_TIME": "6.02", "TIMEDEL": "0.02"}, "short", ("TIMEDEL", "0.02", "TIMEDEL_days", 0.02, "cadence_interval_used_when_integration_metadata_missing")),
        ({}, "Long cadence", ("", "", "1765.5 seconds / 86400", 1765.5 / 86400, "documented_kepler_long_cadence_integration_time")),
        ({"NUM_FRM": "9"}, "short", (None,) * 5), (None, "short", (None,) * 5), (None, "long", ("", "", "1765.5 seconds / 86400", 1765.5 / 86400, "documented_kepler_long_cadence_integration_time")), ({"TIMEDEL": "x"}, "long", ("TIMEDEL", None, "TIMEDEL_days", None, "cadence_interval_used_when_integration_metadata_missing")),
    ]
    df = spark.createDataFrame([(1, k, c, meta) for k, (meta, c, _) in enumerate(cases)], PRODUCTS)
    got = {r["at"]: tuple(r[n] for n in m.EXPOSURE) for r in m.exposures(df).collect()}
    for k, (_, _, want) in enumerate(cases):
        if want:
            assert got[k] == want, k
    with pytest.raises(ValueError, match="no exposure"):
        m.require_one_cadence(m.exposures(m.identified(df.where("at = 5"), "at")))


def test_identities_and_guards(spark):
    metas = [{"FILENAME": "/a/b.fits", "OBJECT": "x"}, {"FILENAME": "", "filename": "c.fits/"}, {"LABEL": "Star 5", "QUARTER": "7"}, {"quarter": "3"}, None, {"OBJECT": "/"}]
    df = spark.createDataFrame([(9, k, "Long" if k % 2 else "long", x) for k, x in enumerate(metas)] + [(8, 0, "long", None), (8, 1, "short", None), (7, 0, None, None)], PRODUCTS)
    got = m.identified(df, "at").where("target_id = 9").orderBy("product_index").collect()
    assert [r["product_id"] for r in got] == ["b.fits", "c.fits", "Star 5", "product_03", "product_04", "/"] and [r["quarter"] for r in got] == ["", "", "7", "3", "", ""]
    assert [tuple(r) for r in m.mixed_cadences(df).collect()] == [(8, ["long", "short"])]
    with pytest.raises(ValueError, match="mixed cadences: 8"):
        m.require_one_cadence(df)
    m.require_one_cadence(df.where("target_id <> 8"))


def test_labels_and_rows(spark):
    products = m.exposures(m.identified(spark.createDataFrame([(1, 0, "long", {"FILENAME": "a", "TIMEDEL": "0.5", "QUARTER": "2"}), (1, 1, "long", {"LABEL": "b"})], PRODUCTS), "at"))
    cadences = spark.createDataFrame([(1, "a", 1.0, 2.0), (1, "a", float("nan"), 2.0), (1, "a", 1.0, None), (1, "z", 1.0, float("inf"))], "target_id long, product_id string, time double, flux double")
    rows = {r["product_id"]: r for r in m.product_rows(cadences, products, "Kepler", "pdcsap_flux").collect()}
    assert set(rows) == {"a", "b"} and (rows["a"]["input_cadence_count"], rows["a"]["finite_cadence_count"], rows["b"]["input_cadence_count"]) == (3, 1, 0) and rows["a"]["quarter"] == "2" and rows["a"]["mission"] == "Kepler"
    seen = {(r["product_id"], r["exposure_days"], r["quarter"], r["flux_product"]) for r in m.labelled(cadences, products, "Kepler", "pdcsap_flux").collect()}
    assert seen == {("a", 0.5, "2", "pdcsap_flux"), ("z", None, None, "pdcsap_flux")}
    made = m.without_products(cadences, "f").first()
    assert (made["product_id"], made["quarter"], made["cadence"], made["mission"], made["exposure_days"]) == ("synthetic_or_stitched", "", "long", "synthetic_or_stitched", 1765.5 / 86400)


def test_maps_of_headers(spark):
    cards = spark.createDataFrame([("f", 0, 1, "QUARTER", "1", ""), ("f", 1, 0, "QUARTER", "2", ""), ("f", 1, 2, "TIMEDEL", "0.1", ""), ("f", 1, 3, "COMMENT", None, "x"), ("g", None, None, None, None, "bad")], fits.CARDS)
    assert [(r["path"], r["meta"]) for r in m.header_maps(cards, "path").collect()] == [("f", {"QUARTER": "1", "TIMEDEL": "0.1"})]
