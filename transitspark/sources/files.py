"""Files as tables: checksums, frozen snapshots from CSV and JSON. All in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a frozen snapshot of accepted cadences.
ACCEPTED = "target_id long, event_number long, cadence_id long, product_id string, time double, flux double, flux_err double, center double"


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file below a path: a manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """Names that a manifest and what is there now don't agree on, and how: missing, new or changed."""
    both = manifest.select("name", F.col("sha256").alias("was")).join(now.select("name", F.col("sha256").alias("is")), "name", "full")
    return both.where("not (was <=> `is`)").select("name", F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "new").otherwise("changed").alias("state"))


def read_snapshot(spark: SparkSession, cadences_csv: str, summary_json: str) -> tuple[DataFrame, DataFrame]:
    """Accepted cadences of a frozen fit from CSV, and its one-row summary from JSON. Lines that don't fit the columns
    are an error, and so are no lines at all."""
    accepted = spark.read.schema(ACCEPTED).option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(cadences_csv)
    if accepted.isEmpty():
        raise ValueError(f"no cadences in {cadences_csv}")
    return accepted, spark.read.option("multiLine", "true").json(summary_json)
