"""Phase bins that grow with a stream of cadences.

Each micro-batch is reduced to sums by target and bin, which merge by adding, and is written as a part of its own, named
by the batch. A batch that is run again after a failure replaces its part, so every cadence counts once. Whoever reads
adds the parts of finished batches; `compact` folds old parts into one now and then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ephemeris import Ephemeris, finite, phase
from ..sources.light_curves import curves_of
from ..sources.versions import VersionedTable

SUMS = "target_id long, bin int, n long, phase_sum double, flux_sum double"


def sums_by_bin(cadences: DataFrame, e: Ephemeris, bins: int) -> DataFrame:
    """Counts and sums by target and equal bins of the whole period, the last one closed; cadences without a finite time
    or flux are left out."""
    at = F.least(F.floor((phase(F.col("time"), e) / e.period + 0.5) * bins), F.lit(bins - 1)).cast("int")
    df = cadences.where(finite("time", "flux")).select("target_id", at.alias("bin"), phase(F.col("time"), e).alias("p"), "flux")
    return df.groupBy("target_id", "bin").agg(F.count("*").alias("n"), F.sum("p").alias("phase_sum"), F.sum("flux").alias("flux_sum"))


def added(sums: DataFrame) -> DataFrame:
    return sums.groupBy("target_id", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "phase_sum", "flux_sum")))


def curve(sums: DataFrame) -> DataFrame:
    """(target_id, bin, phase_mean, flux_mean, n) of sums, however they are split."""
    return added(sums).select("target_id", "bin", (F.col("phase_sum") / F.col("n")).alias("phase_mean"), (F.col("flux_sum") / F.col("n")).alias("flux_mean"), "n")


class PhaseBinSink:
    """The folder of a stream's sums: a part for each batch, and a table of those that were folded together."""

    def __init__(self, spark: SparkSession, folder: str, e: Ephemeris, bins: int):
        self.spark, self.folder, self.e, self.bins = spark, folder.rstrip("/"), e, bins
        self.base = VersionedTable(spark, f"{self.folder}/folded", f"{SUMS}, last_batch long")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        if batch_id > self._folded():
            sums_by_bin(batch, self.e, self.bins).write.mode("overwrite").parquet(f"{self.folder}/parts/batch={batch_id}")

    def _folded(self) -> int:
        row = self.base.read().agg(F.max("last_batch")).first()
        return -1 if row[0] is None else row[0]

    def _parts(self) -> list[int]:
        """Batches that were written to their end."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        home = path(f"{self.folder}/parts")
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(home)] if fs.exists(home) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(path(f"{self.folder}/parts/{n}/_SUCCESS")))

    def sums(self) -> DataFrame:
        folded = self._folded()
        out = self.base.read().drop("last_batch")
        fresh = [b for b in self._parts() if b > folded]
        return out.unionByName(self.spark.read.schema(SUMS).parquet(*(f"{self.folder}/parts/batch={b}" for b in fresh))) if fresh else out

    def curve(self) -> DataFrame:
        return curve(self.sums())

    def compact(self) -> None:
        """Folds the parts of all finished batches into one version; the parts may go afterwards, for they no longer count."""
        if parts := self._parts():
            self.base.replace(added(self.sums()).withColumn("last_batch", F.lit(max(parts)).cast("long")))


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    """New files of the events table as light curves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("maxFilesPerTrigger", files_a_batch)
    return curves_of(reader.parquet(f"{sf_dir}/events.parquet") if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def run(cadences: DataFrame, sink: PhaseBinSink, available: bool = True) -> StreamingQuery:
    """Starts the stream; its progress is kept beside the sums, so another start goes on where this one ends. available:
    stop when all that is there now was read."""
    query = cadences.writeStream.foreachBatch(sink).option("checkpointLocation", f"{sink.folder}/progress").queryName(f"phase-bins-{abs(hash(sink.folder))}")
    return (query.trigger(availableNow=True) if available else query).start()
