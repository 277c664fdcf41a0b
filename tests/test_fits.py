"""FITS files made by hand, byte by byte, and by the writer."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from transitspark.sources import fits, light_curves


def block(*cards):
    data = "".join(c.ljust(80) for c in [*cards, "END"]).encode("latin-1")
    return data + b" " * (-len(data) % 2880)


def padded(data):
    return data + b"\0" * (-len(data) % 2880)


def table(rows, *more, columns=(("TIME", "D"), ("CADENCENO", "J"), ("PDCSAP_FLUX", "E"), ("SAP_QUALITY", "J"))):
    cards = ["XTENSION= 'BINTABLE'", "BITPIX  = 8", "NAXIS   = 2", f"NAXIS1  = {rows.dtype.itemsize}", f"NAXIS2  = {len(rows)}", "PCOUNT  = 0", "GCOUNT  = 1", f"TFIELDS = {len(columns)}"]
    for k, (name, form) in enumerate(columns, 1):
        cards += [f"TTYPE{k}  = '{name}'", f"TFORM{k}  = '{form}'"]
    return block(*cards, *more) + padded(rows.tobytes())


ROW = [("t", ">f8"), ("c", ">i4"), ("f", ">f4"), ("q", ">i4")]
PRIMARY = block("SIMPLE  =                    T / conforms", "BITPIX  = 8", "NAXIS   = 0", "OBJECT  = 'Kepler-22 / b''s star'  / name", "TEFF    =               5518.0 / [K] temperature", "COMMENT free text = here", "QUARTER = 7", "DRN     = 'late'")
IMAGE = block("XTENSION= 'IMAGE   '", "BITPIX  = -32", "NAXIS   = 2", "NAXIS1  = 300", "NAXIS2  = 2000", "PCOUNT  = 0", "GCOUNT  = 1", "DATREL  = 25", "DATA_REL= 24") + padded(b"\1" * 2_400_000)


def rows(n, first=0):
    out = np.zeros(n, ROW)
    out["t"], out["c"], out["f"], out["q"] = np.arange(first, first + n) / 48, np.arange(first, first + n), 1, np.arange(n) % 5
    return out


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        data = super().read(n)
        self.taken += len(data)
        return data


def test_cards_of_all_units_and_first_values(spark, tmp_path):
    many = [f"KEY{i:05d}= {i}" for i in range(2_400)]  # a header of 192,000 bytes
    long = ["LONG    = 'begins &'", "CONTINUE  'goes on &' / one", "CONTINUE  'ends' / two"]
    (tmp_path / "a.fits").write_bytes(PRIMARY + IMAGE + table(rows(3), *many, *long, "QUARTER = 8", "PROCVER = 'x.y'"))
    (tmp_path / "b.fits").write_bytes(b"not a header")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.fits").write_bytes(b"")
    (tmp_path / "d.fits").write_bytes(PRIMARY + block("XTENSION= 'IMAGE   '", "BITPIX  = 8", "NAXIS   = 0")[:1000])
    cards = fits.fits_cards(spark, str(tmp_path))
    a = [r for r in cards.where("path like '%a.fits'").collect()]
    assert {r["hdu"] for r in a} == {0, 1, 2} and sum(r["key"].startswith("KEY") for r in a) == 2_400
    got = {(r["hdu"], r["key"]): r for r in a}
    assert got[0, "OBJECT"]["value"] == "Kepler-22 / b's star" and got[0, "OBJECT"]["comment"] == "name" and got[0, "TEFF"]["value"] == "5518.0"
    assert got[0, "COMMENT"]["value"] is None and got[0, "COMMENT"]["comment"] == "free text = here"
    assert got[2, "LONG"]["value"] == "begins goes on ends" and (2, "CONTINUE") not in got
    told = {r["path"].rpartition("/")[2]: r for r in fits.first_values(cards).collect()}
    assert (told["a.fits"]["quarter"], told["a.fits"]["data_release"], told["a.fits"]["pipeline_version"], told["a.fits"]["header_read_error"]) == ("7", "late", "x.y", False)
    assert [told[n]["header_read_error"] for n in ("b.fits", "c.fits", "d.fits")] == [True, True, True] and told["d.fits"]["quarter"] == "7"
    listed = fits.first_values(cards.where("hdu = 1"), {"data_release": ("DATA_REL", "DATREL")}).first()
    assert listed["data_release"] == "24"  # within a unit the key listed first


def test_what_is_not_asked_for_is_not_read(spark):
    f = Counted(PRIMARY + IMAGE + table(rows(40_000)) + table(rows(5), "OBJECT  = 'other'"))
    size = len(f.getvalue())
    assert [u.hdu for u in fits.units(f, size)] == [0, 1, 2, 3] and f.taken == 4 * fits.BLOCK and size > 3_000_000
    schema = StructType.fromDDL("OBJECT string, TIME double")
    reader = fits.FitsReader({"path": "x", "keys": "OBJECT", "only": '{"OBJECT": ["other"]}'}, schema)
    f.taken = 0
    assert sum(len(b) for b in reader.rows(f, fits.Part("x", 0, size, size))) == 5 and f.taken == 4 * fits.BLOCK + 5 * 20
    f.taken = 0
    middle = size // 2
    assert sum(len(b) for b in reader.rows(f, fits.Part("x", 0, middle, size))) == 0 and f.taken <= 4 * fits.BLOCK


@pytest.mark.parametrize("size", [2_880, 10_007, 10**9])
def test_ranges_take_every_row_once(spark, size):
    data = PRIMARY + table(rows(1_500)) + table(rows(1_700, 5_000)) + block("XTENSION= 'IMAGE   '", "BITPIX  = 8", "NAXIS   = 0")
    reader = fits.FitsReader({"path": "x", "keys": ""}, StructType.fromDDL("CADENCENO long, row long, hdu int"))
    got = []
    for at in range(0, len(data), size):
        for b in reader.rows(io.BytesIO(data), fits.Part("x", at, min(at + size, len(data)), len(data))):
            got += zip(*(b.column(c).to_pylist() for c in ("CADENCENO", "row", "hdu")))
    assert got == [(i, i, 1) for i in range(1_500)] + [(5_000 + i, i, 2) for i in range(1_700)]


def test_forms_of_columns(spark, tmp_path):
    r = np.zeros(3, [("l", "S1"), ("b", "u1"), ("i", ">i2"), ("k", ">i8"), ("s", "S6"), ("v", ">f4", (3,)), ("x", "u1"), ("u", ">i4"), ("z", ">i2")])
    r["l"], r["b"], r["i"], r["k"], r["s"], r["u"], r["z"] = [b"T", b"F", b"\0"], [1, 255, 7], [5, -9, 6], [2**60, 1, 2], [b"ab", b"cd\0x", b"  e "], [-(2**31), 0, 5], [1, 2, -4]
    r["v"] = np.arange(9).reshape(3, 3)
    columns = (("l", "L"), ("b", "1B"), ("i", "I"), ("k", "K"), ("s", "6A"), ("v", "3E"), ("x", "5X"), ("u", "J"), ("z", "I"))
    (tmp_path / "f.fits").write_bytes(PRIMARY + table(r, "TNULL3  = -9", "TZERO8  = 2147483648", "TSCAL9  = 0.5", "TZERO9  = 10", columns=columns))
    got = fits.fits_rows(spark, f"{tmp_path}/f.fits", "L boolean, b int, i int, k long, s string, v array<double>, u long, z double, missing string, OBJECT string, QUARTER int", ("OBJECT", "QUARTER")).collect()
    assert [tuple(x) for x in got] == [
        (True, 1, 5, 2**60, "ab", [0.0, 1.0, 2.0], 0, 10.5, None, "Kepler-22 / b's star", 7), (False, 255, None, 1, "cd", [3.0, 4.0, 5.0], 2**31, 11.0, None, "Kepler-22 / b's star", 7),
        (None, 7, 6, 2, "  e", [6.0, 7.0, 8.0], 2**31 + 5, 8.0, None, "Kepler-22 / b's star", 7),
    ]
    for schema in ("x int", "v double"):
        with pytest.raises(Exception, match="column [xv]"):
            fits.fits_rows(spark, str(tmp_path), schema).collect()


def test_light_curves_of_several_files(spark, tmp_path):
    n = 25_000
    lc = spark.range(n).select((F.col("id") % 3).alias("target_id"), F.when(F.col("id") % 2 == 0, "q1").otherwise("o'q").alias("product_id"), F.col("id").alias("cadence_id"), (F.col("id") / 48).alias("time"), F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("id") * 1.5).alias("flux"), F.lit(0.5).alias("flux_err"), (F.col("id") % 4).alias("quality"))
    folder = f"{tmp_path}/out"
    light_curves.write_fits_light_curves(lc, folder)
    back = light_curves.read_fits_light_curves(spark, folder)
    same = lambda a, b: a.exceptAll(b).count() == 0 == b.exceptAll(a).count()
    assert back.count() == n and same(back, lc.withColumn("target_id", F.col("target_id").cast("string")).drop("quality"))
    assert light_curves.read_fits_light_curves(spark, folder, ["2"], quality_mask=2).count() == lc.where("target_id = 2 and quality < 2").count()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = light_curves.read_fits_light_curves(spark, folder).where("target_id = '1' and product_id in ('q1', 'none')")
        assert pushed.count() == lc.where("target_id = 1 and product_id = 'q1'").count() and "= 1)" not in pushed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError):
        light_curves.read_fits_light_curves(spark, folder, ["9"])
    with pytest.raises(ValueError):
        light_curves.read_fits_light_curves(spark, f"{tmp_path}/none")


def test_units_are_cut_and_nothing_is_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fits, "UNIT_ROWS", 100)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"K": [1] * 70, "V": [float(i) for i in range(70)], "W": [None, *range(69)]}) for _ in range(3)] + [pa.RecordBatch.from_pydict({"K": [None] * 2, "V": [0.5, None], "W": [7, 8]})]
    writer = fits.FitsWriter({"path": str(tmp_path / "w"), "keys": "K"})
    name = writer.write(iter(batches)).name
    with open(tmp_path / "w" / name, "rb") as f:
        data = f.read()
    assert [u.number("NAXIS2") for u in fits.units(io.BytesIO(data), len(data))] == [0, 70, 70, 70, 2] and len(data) % 2880 == 0
    got = fits.fits_rows(spark, str(tmp_path / "w"), "K long, V double, W long", ("K",)).collect()
    assert len(got) == 212 and sum(r["W"] is None for r in got) == 3 and sum(r["K"] is None for r in got) == 2
