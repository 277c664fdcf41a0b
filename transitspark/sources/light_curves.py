"""Light curves: one row per cadence, any number of targets in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fits import fits_rows, write_fits

#: target_id, product_id, cadence_id, time (days), flux, flux_err.
COLUMNS = ("target_id", "product_id", "cadence_id", "time", "flux", "flux_err")
SECONDS_A_DAY = 86_400.0


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as light curves: ten users are a target, event types are products, every 97th flux is missing (NaN).

    Time is days since the start of 2024. The projection reads four columns and stays in one stage.
    """
    return curves_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def curves_of(events: DataFrame) -> DataFrame:
    """Rows of the events table, or a stream of them, as light curves."""
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select(
        F.expr("user_id div 10").alias("target_id"),
        F.col("event_type").alias("product_id"),
        F.col("event_id").alias("cadence_id"),
        (micros.cast("double") / F.lit(86400e6)).alias("time"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("flux"),
        (F.lit(0.5) + (F.col("event_id") % 3) * 0.25).alias("flux_err"),
    )


def stitch(products: list[DataFrame]) -> DataFrame:
    """Products of one target or many under one schema."""
    out = products[0]
    for p in products[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_light_curves(spark: SparkSession, path: str, targets: list[str] | None = None) -> DataFrame:
    """Light curves from Parquet; a filter on targets reaches the scan. No rows at all is an error."""
    df = spark.read.parquet(path).select(*COLUMNS)
    df = df.where(F.col("target_id").isin(targets)) if targets else df
    if df.isEmpty():
        raise ValueError(f"no cadences in {path}")
    return df


def write_fits_light_curves(curves: DataFrame, folder: str) -> None:
    """Light curves as FITS files: a table for each target and product, cadences in order of time."""
    named = curves.select(F.col("target_id").cast("string").alias("OBJECT"), F.col("product_id").alias("PRODUCT"), F.col("time").alias("TIME"), F.col("cadence_id").alias("CADENCENO"), F.col("flux").alias("PDCSAP_FLUX"), F.col("flux_err").alias("PDCSAP_FLUX_ERR"), F.col("quality").cast("long").alias("SAP_QUALITY") if "quality" in curves.columns else F.lit(0).cast("long").alias("SAP_QUALITY"))
    write_fits(named, folder, ("OBJECT", "PRODUCT"), ("TIME", "CADENCENO"))


def read_fits_light_curves(spark: SparkSession, path: str, targets: list[str] | None = None, flux: str = "PDCSAP_FLUX", error: str | None = None, quality_mask: int = 0, product_key: str = "PRODUCT", target_key: str = "OBJECT") -> DataFrame:
    """Light curves of all FITS files at or below a path: target and product from headers, times and fluxes from tables.

    Cadences with a bit of quality_mask are left out. Tables of other targets than those asked for are hopped
    over. error is the column of errors; by default that of the flux and `_ERR`. No rows at all is an error.
    """
    error = error or f"{flux}_ERR"
    schema = f"`{target_key}` string, `{product_key}` string, CADENCENO long, TIME double, `{flux}` double, `{error}` double" + ", SAP_QUALITY long" * bool(quality_mask)
    rows = fits_rows(spark, path, schema, (target_key, product_key), {target_key: targets} if targets else None)
    rows = rows.where((F.coalesce("SAP_QUALITY", F.lit(0)).bitwiseAND(F.lit(quality_mask))) == 0) if quality_mask else rows
    out = rows.select(F.col(target_key).alias("target_id"), F.col(product_key).alias("product_id"), F.col("CADENCENO").alias("cadence_id"), F.col("TIME").alias("time"), F.col(flux).alias("flux"), F.col(error).alias("flux_err"))
    if out.isEmpty():
        raise ValueError(f"no cadences in {path}")
    return out
