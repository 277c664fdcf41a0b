"""Tables that are replaced as a whole, and logs that grow, without a table format.

A versioned table is a folder of versions and a pointer file that names the one that counts. A new version is written
beside the old one, and the pointer is put in place by a rename when all of it is there: whoever reads in between, or
after a writer was killed, finds the old version whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

POINTER = "CURRENT"


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        path = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    @property
    def version(self) -> str | None:
        """The folder of the version that counts; none where nothing was written, or the pointer is broken."""
        try:
            return json.loads(self._text(POINTER) or "null")["version"]
        except (ValueError, TypeError, KeyError):
            return None

    def read(self) -> DataFrame:
        """The rows of the version that counts; no rows without one."""
        name = self.version
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}") if name else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame, expected: object = ...) -> str:
        """Writes rows as a new version and lets it count. expected: the version that rows were made from; if another one
        counts by now, that is an error, and the new version does not count."""
        name = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        if expected is not ... and self.version != expected:
            raise RuntimeError(f"{self.folder} was replaced by another writer")
        new, current = self._path(f"{self.folder}/{POINTER}-{name}"), self._path(f"{self.folder}/{POINTER}")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps({"version": name}).encode()))
        finally:
            stream.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        over = getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename")
        ways = self.spark.sparkContext._gateway.new_array(over, 1)
        ways[0] = over.OVERWRITE
        hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(new, current, ways)
        return name

    def upsert(self, news: DataFrame, key: tuple[str, ...], order: str) -> str:
        """Puts rows in by key: a row replaces the one of its key; of several new ones of a key, the last by `order`."""
        before = self.version
        return self.replace(upserted(self.read(), news, key, order), before)

    def change(self, f: Callable[[DataFrame], DataFrame]) -> str:
        before = self.version
        return self.replace(f(self.read()), before)


def upserted(index: DataFrame, news: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """index with news put in by key; null keys are keys like any other. Of repeated keys among the news the last one by
    a column wins (ties: the greatest row), by an aggregate, so a hot key is summed before it moves."""
    columns = index.columns
    last = news.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order), *columns)).alias("x")).select("x.*")
    same = [index[k].eqNullSafe(last[k]) for k in key]
    return index.join(last, same, "left_anti").select(*columns).unionByName(last.select(*columns))


def append_log(rows: DataFrame, folder: str) -> None:
    """Rows as lines of JSON after those that are there."""
    rows.write.mode("append").json(folder)


def read_log(spark: SparkSession, path: str, schema: str, kind: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a log of JSON or CSV lines: lines that don't fit the schema are rejects (line), not errors, and
    no rows. A log that is not there is empty; lines that name the columns of a CSV log are passed over."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        return spark.createDataFrame([], schema), spark.createDataFrame([], "line string")
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    lines = spark.read.text(path).where(F.trim("value") != "")
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}
    if kind == "csv":
        lines = lines.where(F.col("value") != ",".join(names))  # headers
        parsed = lines.select(F.from_csv("value", f"{schema}, _line string", how).alias("x"))
    else:
        parsed = lines.select(F.from_json("value", f"{schema}, _line string", how).alias("x"))
    return parsed.where("x._line IS NULL").select(*(f"x.{n}" for n in names)), parsed.where("x._line IS NOT NULL").select(F.col("x._line").alias("line"))


def running_totals(log: DataFrame, order: str, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """log with total_<column> up to and with each row in an order, within the columns `by`; null counts as 0."""
    own = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return log.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(f"total_{c}") for c in columns))
