"""Makes the package known to Python workers that do not have it on their path."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application. Spark serves the archive to them from the driver."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    archive = Path(tempfile.mkdtemp(prefix="transitspark-")) / "transitspark_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((ROOT / "transitspark").rglob("*.py")):
            z.write(f, f.relative_to(ROOT))
        if (ROOT / "corpus_pipeline.py").exists():
            z.write(ROOT / "corpus_pipeline.py", "corpus_pipeline.py")
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(app)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
