import hashlib
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from transitspark.sources import digests, versions


def test_manifests_of_files(spark, tmp_path):
    a = tmp_path / "in"
    (a / "sub").mkdir(parents=True)
    (a / "one.csv").write_bytes(b"x,y\n1,2\n")
    (a / "sub" / "two.bin").write_bytes(bytes(range(256)) * 20_000)  # more than a buffer
    (a / "empty.json").write_bytes(b"")
    m = digests.manifest(spark, str(a))
    rows = {r["name"]: r for r in m.collect()}
    assert {n: (r["bytes"], r["sha256"]) for n, r in rows.items()} == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in (("one.csv", b"x,y\n1,2\n"), ("sub/two.bin", bytes(range(256)) * 20_000), ("empty.json", b""))}
    digests.write_manifest(m, f"{tmp_path}/manifest.json")
    told, stated = digests.read_manifest(spark, f"{tmp_path}/manifest.json")
    assert stated == digests.manifest_digest(told) == digests.manifest_digest(m.repartition(3)) and digests.verify(told, m) == []
    (a / "one.csv").write_bytes(b"x,y\n1,3\n")
    (a / "new").write_bytes(b"n")
    (a / "empty.json").unlink()
    now = digests.manifest(spark, str(a))
    assert {r["name"]: r["state"] for r in digests.compared(told, now).collect()} == {"one.csv": "changed", "new": "new", "empty.json": "missing", "sub/two.bin": "same"}
    assert digests.manifest_digest(now) != stated
    with pytest.raises(ValueError, match="empty.json: missing; new: new; one.csv: changed"):
        digests.verify(told, now)
    some = digests.manifest(spark, str(a), ("one.csv",), ("absent.json", "new"))
    assert {(r["name"], r["optional"]) for r in some.collect()} == {("one.csv", False), ("new", True)}
    with pytest.raises(FileNotFoundError, match="empty.json"):
        digests.manifest(spark, str(a), ("empty.json",))
    lost = told.withColumn("sha256", F.lit(None).cast("string"))
    assert digests.verify(lost, told) == ["empty.json", "one.csv", "sub/two.bin"]
    assert digests.digests(spark.createDataFrame([(f"{a}/gone",)], "path string")).first()["sha256"] is None
    assert digests.manifest(spark, f"{tmp_path}/none").count() == 0


def test_a_large_file_takes_a_buffer_of_memory(tmp_path):
    with open(tmp_path / "large", "wb") as f:
        for _ in range(40):
            f.write(b"\5" * (1 << 20))
    tracemalloc.start()
    got = digests.sha256_of(str(tmp_path / "large"), 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == hashlib.sha256(b"\5" * (40 << 20)).hexdigest() and peak < 4 << 20


SCHEMA = "run string, mode string, n long"


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=repr)


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path):
    t = versions.VersionedTable(spark, f"{tmp_path}/index", SCHEMA)
    assert rows(t) == [] and t.version is None
    t.upsert(spark.createDataFrame([("a", "x", 1), ("b", "x", 2)], SCHEMA).withColumn("at", F.lit(1)), ("run", "mode"), "at")
    first = t.version

    def broken(batches):
        for pdf in batches:
            yield pdf
            raise RuntimeError("the writer dies")

    with pytest.raises(Exception, match="dies"):
        t.replace(t.read().mapInPandas(broken, SCHEMA))
    assert t.version == first and rows(t) == [("a", "x", 1), ("b", "x", 2)]
    spark.createDataFrame([("z", "z", 9)], SCHEMA).write.parquet(f"{tmp_path}/index/version-written-but-not-named")
    news = spark.createDataFrame([("b", "x", 5, 3), ("b", "x", 4, 7), ("c", None, 1, 1), ("c", None, 2, 2)], f"{SCHEMA}, at long")
    t.upsert(news, ("run", "mode"), "at")
    assert rows(t) == [("a", "x", 1), ("b", "x", 4), ("c", None, 2)]
    t.upsert(news.where("run = 'c'"), ("run", "mode"), "at")
    assert rows(t) == [("a", "x", 1), ("b", "x", 4), ("c", None, 2)]  # a null key is replaced, not added
    with pytest.raises(RuntimeError, match="another writer"):
        t.replace(t.read(), first)
    (tmp_path / "index" / versions.POINTER).write_text("{not json")
    (tmp_path / "index" / f".{versions.POINTER}.crc").unlink(missing_ok=True)
    assert rows(t) == []


def test_logs_and_their_rejects(spark, tmp_path):
    log = f"{tmp_path}/log"
    for k in range(3):
        versions.append_log(spark.createDataFrame([(k, 2.5 * k)], "seq long, seconds double").coalesce(1), log)
    (tmp_path / "log" / "torn.json").write_text('{"seq": 9, "sec\n{"seq": "x", "seconds": 1}\n' + json.dumps({"seq": 3, "seconds": None}) + "\n")
    good, bad = versions.read_log(spark, log, "seq long, seconds double")
    assert sorted(r["seq"] for r in good.collect()) == [0, 1, 2, 3] and sorted(r["line"] for r in bad.collect()) == ['{"seq": "x", "seconds": 1}', '{"seq": 9, "sec']
    assert [(r["seq"], r["total_seconds"]) for r in versions.running_totals(good, "seq", "seconds").orderBy("seq").collect()] == [(0, 0.0), (1, 2.5), (2, 7.5), (3, 7.5)]
    (tmp_path / "h.csv").write_text("seq,seconds\n1,0.5\nx,1\n2\n")
    good, bad = versions.read_log(spark, f"{tmp_path}/h.csv", "seq long, seconds double", "csv")
    assert [tuple(r) for r in good.where("seconds is not null").collect()] == [(1, 0.5)] and "x,1" in [r["line"] for r in bad.collect()]
    good, bad = versions.read_log(spark, f"{tmp_path}/none", "seq long")
    assert good.count() == 0 == bad.count()
