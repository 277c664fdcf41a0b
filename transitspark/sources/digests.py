"""Digests of files of any size: listed on the driver, hashed in tasks from streams of a fixed buffer.

A manifest has a row for each file: (name, path, bytes, sha256, optional). Its own digest is that of its lines in order of
name, so two manifests are the same if their digests are.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, files_below

#: Bytes that a task holds of a file.
BUFFER = 1 << 20
MANIFEST = "name string, path string, bytes long, sha256 string, optional boolean"


def sha256_of(uri: str, buffer: int = BUFFER) -> str:
    fs, path = file_system(uri)
    digest = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as f:
        while block := f.read(buffer):
            digest.update(block)
    return digest.hexdigest()


def digests(files: DataFrame) -> DataFrame:
    """files(path, ...) with sha256: files are dealt over the tasks by size, large ones first, one after the other in a
    task. A file that is gone has null."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                try:
                    found.append(sha256_of(path))
                except FileNotFoundError:
                    found.append(None)
            yield pdf.assign(sha256=found)

    kept = [c for c in files.columns if c != "sha256"]
    kinds = dict(files.dtypes)
    return files.select(*kept).mapInPandas(each, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", sha256 string")


def manifest(spark: SparkSession, folder: str, required: tuple[str, ...] = (), optional: tuple[str, ...] = ()) -> DataFrame:
    """The manifest of the files below a folder, or of those named: one that is required and missing is an error, an
    optional one is left out. Names are paths below the folder."""
    fs, base = file_system(folder)
    listed = {p.partition(base.rstrip("/") + "/")[2]: (p, n) for p, n in files_below(folder)}
    if required or optional:
        if missing := [n for n in required if n not in listed]:
            raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
        listed = {n: listed[n] for n in (*required, *optional) if n in listed}
    rows = [(n, p, size, n in optional) for n, (p, size) in sorted(listed.items(), key=lambda x: (-x[1][1], x[0]))]
    files = spark.createDataFrame(rows, "name string, path string, bytes long, optional boolean").repartition(min(max(1, len(rows)), 10_000))
    return digests(files).select("name", "path", "bytes", "sha256", "optional")


def manifest_digest(rows: DataFrame) -> str:
    """One digest of a manifest: of the JSON lines of its files in order of name, whatever their paths."""
    lines = rows.select(F.col("name"), F.to_json(F.struct("bytes", "name", "optional", "sha256")).alias("line"))
    digest = hashlib.sha256()
    for r in lines.orderBy("name").toLocalIterator():
        digest.update(r["line"].encode() + b"\n")
    return digest.hexdigest()


def write_manifest(rows: DataFrame, uri: str) -> None:
    """A manifest of a snapshot as one JSON file: its files and its digest. For folders of a job's own files, not for the
    files of a large table."""
    fs, path = file_system(uri)
    files = [r.asDict() for r in rows.orderBy("name").collect()]
    with fs.open_output_stream(path) as f:
        f.write(json.dumps({"files": files, "manifest_sha256": manifest_digest(rows)}, indent=2).encode())


def read_manifest(spark: SparkSession, uri: str) -> tuple[DataFrame, str]:
    """The rows of a written manifest, and the digest that it states."""
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        told = json.loads(f.read())
    rows = [(x["name"], x["path"], x["bytes"], x["sha256"], x["optional"]) for x in told["files"]]
    return spark.createDataFrame(rows, MANIFEST), told["manifest_sha256"]


#: What is said of a file; fixed values.
STATES = ("missing", "new", "changed", "not verifiable", "same")


def compared(told: DataFrame, now: DataFrame) -> DataFrame:
    """(name, state, told, found) of every file of two manifests, by one full join; a digest that either side lacks is
    not verifiable."""
    a = told.select("name", F.lit(True).alias("_a"), F.col("sha256").alias("told"))
    b = now.select("name", F.lit(True).alias("_b"), F.col("sha256").alias("found"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "new").when(F.col("told").isNull() | F.col("found").isNull(), "not verifiable").when(F.col("told") != F.col("found"), "changed").otherwise("same")
    return a.join(b, "name", "full").select("name", state.alias("state"), "told", "found")


def verify(told: DataFrame, now: DataFrame, strict: bool = True) -> list[str]:
    """Names of files that could not be verified. Raises a ValueError where one is missing or changed, or, if strict, new."""
    odd = compared(told, now).where("state <> 'same'").orderBy("name").collect()
    wrong = [r for r in odd if r["state"] in ("missing", "changed") or strict and r["state"] == "new"]
    if wrong:
        raise ValueError("; ".join(f"{r['name']}: {r['state']}" for r in wrong))
    return [r["name"] for r in odd if r["state"] == "not verifiable"]
