"""The folder that driver and executors share, for tables and files that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is not set, a local master gets a temporary folder, and a
    cluster an error, for no other folder is known to be shared."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="transitspark-")
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: what follows doesn't do its work twice, and a
    lost executor costs a task."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def files_below(uri: str) -> list[tuple[str, int]]:
    """(address, bytes) of all files below a path, or of the file that it is, by name."""
    fs, path = file_system(uri)
    info = fs.get_file_info(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True))
    head = uri.removesuffix(path) if uri.endswith(path) else ""
    return sorted((head + x.path, x.size) for x in found if x.is_file)
