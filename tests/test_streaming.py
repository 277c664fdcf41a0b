import numpy as np
import pytest

from transitspark.functions.ephemeris import Ephemeris
from transitspark.sources.light_curves import curves_of
from transitspark.streaming import phase_bins as pb

E = Ephemeris(2.5, 0.4, 0.4)


def curve_of(df):
    return sorted((r["target_id"], r["bin"], r["n"], round(r["phase_mean"], 9), round(r["flux_mean"], 9)) for r in df.collect())


@pytest.fixture
def files(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    return tmp_path


def test_a_restart_in_mid_stream_gives_the_batch_result(spark, files):
    whole = curve_of(pb.curve(pb.sums_by_bin(curves_of(spark.read.parquet(f"{files}/events.parquet")), E, 10)))

    class Dies(pb.PhaseBinSink):
        """Writes its third batch, then fails before the stream hears of it."""

        def __call__(self, batch, batch_id):
            super().__call__(batch, batch_id)
            if batch_id == 2:
                raise RuntimeError("lost")

    folder = f"{files}/sums"
    with pytest.raises(Exception, match="lost"):
        pb.run(pb.event_stream(spark, str(files)), Dies(spark, folder, E, 10)).awaitTermination()
    sink = pb.PhaseBinSink(spark, folder, E, 10)
    half = curve_of(sink.curve())
    assert sink._parts() == [0, 1, 2] and 0 < sum(r[2] for r in half) < sum(r[2] for r in whole)
    sink.compact()  # batch 2 is folded, and comes again
    assert curve_of(sink.curve()) == half
    pb.run(pb.event_stream(spark, str(files)), sink).awaitTermination()
    assert curve_of(sink.curve()) == whole and len(sink._parts()) == 6
    pb.run(pb.event_stream(spark, str(files)), sink).awaitTermination()  # nothing new
    assert curve_of(sink.curve()) == whole
    sink.compact()
    assert curve_of(sink.curve()) == whole


def test_a_batch_that_is_torn_does_not_count(spark, files):
    sink = pb.PhaseBinSink(spark, f"{files}/torn", E, 10)
    assert sink.curve().count() == 0
    sink(curves_of(spark.read.parquet(f"{files}/events.parquet")).limit(100), 0)
    before = curve_of(sink.curve())
    sink(curves_of(spark.read.parquet(f"{files}/events.parquet")).limit(50), 1)
    (files / "torn" / "parts" / "batch=1" / "_SUCCESS").unlink()
    assert curve_of(sink.curve()) == before


def test_sums_are_those_of_plain_means(spark):
    t = np.linspace(-3, 30, 400)
    rows = [(1, "a", i, float(x), float(i % 7), 1.0) for i, x in enumerate(t)] + [(1, "a", 999, float("nan"), 1.0, 1.0), (2, "a", 1000, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "target_id long, product_id string, cadence_id long, time double, flux double, flux_err double")
    ph = np.mod(t - 0.4 + 1.25, 2.5) - 1.25
    at = np.minimum(np.floor((ph / 2.5 + 0.5) * 10).astype(int), 9)
    want = sorted((1, int(b), int((at == b).sum()), round(ph[at == b].mean(), 9), round((np.arange(400) % 7)[at == b].mean(), 9)) for b in np.unique(at))
    assert curve_of(pb.curve(pb.sums_by_bin(df, E, 10))) == want
