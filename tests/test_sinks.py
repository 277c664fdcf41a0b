import json

from pyspark.sql import functions as F

from transitspark.functions import stellar
from transitspark.sources import sinks


def test_strict_json(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, [1.0, inf], {"a": nan, "b": 2.0}, (-inf, [(nan, "x")])), (2, 0.5, None, None, None)], "k int, x double, y array<double>, m map<string, double>, s struct<p: double, q: array<struct<r: float, t: string>>>")
    sinks.write_json(df, f"{tmp_path}/out")
    lines = sorted((json.loads(x, parse_constant=lambda c: 1 / 0) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()), key=lambda r: r["k"])
    assert lines == [{"k": 1, "x": None, "y": [1.0, None], "m": {"a": None, "b": 2.0}, "s": {"p": None, "q": [{"r": None, "t": "x"}]}}, {"k": 2, "x": 0.5, "y": None, "m": None, "s": None}]


def test_csv_of_rows_with_different_columns(spark, tmp_path):
    a, b = spark.createDataFrame([("P", 1)], "alias string, valid int"), spark.createDataFrame([(0, "2P", "x,y")], "valid int, alias string, note string")
    sinks.write_csv([a, b], f"{tmp_path}/c")
    files = list((tmp_path / "c").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines() == ["alias,valid,note", "P,1,", '2P,0,"x,y"']
    sinks.write_csv([a.limit(0), b.limit(0)], f"{tmp_path}/c")
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv")).splitlines() == ["alias,valid,note"]


def test_physical_constraints_and_names(spark):
    nan = float("nan")
    rows = [((0.1, 9.0, 0.3, 0.3, 0.3, 0.0), []), ((0.0, 1.0, 1.0, 1.0, 0.0, -1.0), [0, 1, 2, 6]), ((nan, nan, nan, nan, None, nan), [0, 1, 2, 4, 5, 6]), ((0.1, 0.5, 0.6, 0.5, 0.5, 0.1), [1, 3]), ((0.5, 1.5, 1.49, 1.1, -0.1, 0.0), [1, 4, 5])]
    df = spark.createDataFrame([(k, *r) for k, (r, _) in enumerate(rows)], "k int, rp double, a double, b double, q1 double, q2 double, j double")
    got = df.select("k", stellar.violations(*map(F.col, ("rp", "a", "b", "q1", "q2", "j"))).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == [[stellar.PHYSICAL[i] for i in bad] for _, bad in rows]
    t = spark.createDataFrame([("Kepler-5 ",), (" KIC 819 2672",), ("  a/b: c ",), ("   ",)], "t string").select(stellar.plain_name(F.col("t")), stellar.run_id(F.col("t"))).collect()
    assert [tuple(r) for r in t] == [("kepler5", "Kepler-5"), ("kic8192672", "KIC_819_2672"), ("a/b:c", "a_b_c"), ("", None)]
