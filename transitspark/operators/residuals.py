"""Linear baselines per event, residual statistics, autocorrelation and binned scatter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def event_baselines(accepted: DataFrame, model: str) -> DataFrame:
    """Per event, intercept and slope of a weighted line times the model column: five sums and a 2 x 2 system.

    Where cadences of one time, or a single one, leave a line open, it is the one of least norm among those that fit best; a model
    of zeros has a line of zeros.
    """
    w, m, x, y = 1 / F.pow(F.greatest(F.col("flux_err"), F.lit(1e-12)), 2), F.col(model), F.col("offset"), F.col("flux")
    s = accepted.groupBy("target_id", "event_number").agg(
        F.sum(w * m * m).alias("a"), F.sum(w * m * m * x).alias("b"), F.sum(w * m * m * x * x).alias("d"), F.sum(w * m * y).alias("p"), F.sum(w * m * x * y).alias("q"), F.count("*").alias("n")
    )
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    det = F.when(det > 1e-12 * F.col("a") * F.col("d"), det)
    at = F.try_divide("b", "a")  # the one time
    least = F.coalesce(F.try_divide(F.col("p"), F.col("a") * (1 + at * at)), F.lit(0.0))
    intercept, slope = (F.col("p") * F.col("d") - F.col("q") * F.col("b")) / det, (F.col("q") * F.col("a") - F.col("p") * F.col("b")) / det
    return s.select("target_id", "event_number", "n", F.coalesce(intercept, least).alias("intercept"), F.coalesce(slope, least * at, F.lit(0.0)).alias("slope"))


def residual_stats(residuals: DataFrame, *by: str) -> DataFrame:
    """Mean, sample deviation and 1.4826 times the median absolute deviation of the column residual."""
    own = W.partitionBy(*by)
    df = residuals.withColumn("_m", F.median("residual").over(own))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("std"), (1.4826 * F.median(F.abs(F.col("residual") - F.col("_m")))).alias("mad"))


def autocorrelation(residuals: DataFrame, lags: int = 20) -> DataFrame:
    """(target_id, lag, acf) in order of time, around the mean; null where a target has no more rows than the lag.

    All lags are taken in one pass over one sort per target.
    """
    own, order = W.partitionBy("target_id"), W.partitionBy("target_id").orderBy("time", "cadence_id")
    df = residuals.withColumn("_r", F.col("residual") - F.avg("residual").over(own))
    df = df.withColumns({f"_{k}": F.col("_r") * F.lag("_r", k).over(order) for k in range(1, lags + 1)})
    sums = df.groupBy("target_id").agg(F.sum(F.col("_r") * F.col("_r")).alias("_0"), *(F.sum(f"_{k}").alias(f"_{k}") for k in range(1, lags + 1)))
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_{k}"), F.col("_0")).alias("acf")) for k in range(1, lags + 1)))
    return sums.select("target_id", F.explode(pairs).alias("x")).select("target_id", "x.*")


def binned_scatter(residuals: DataFrame, sizes: tuple[int, ...] = (1, 2, 4, 8, 16, 32)) -> DataFrame:
    """Per target and block size, the sample deviation of means of full blocks of neighbours within an event, and what
    independent noise would give."""
    order = W.partitionBy("target_id", "event_number").orderBy("time", "cadence_id")
    df = residuals.withColumn("_k", F.row_number().over(order) - 1).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    blocks = df.groupBy("target_id", "event_number", "size", F.floor(F.col("_k") / F.col("size")).alias("block")).agg(F.avg("residual").alias("mean"), F.count("*").alias("n")).where("n = size")
    base = residuals.groupBy("target_id").agg(F.stddev_samp("residual").alias("base"))
    out = blocks.groupBy("target_id", "size").agg(F.count("*").alias("n_blocks"), F.stddev_samp("mean").alias("rms"))
    return out.join(base, "target_id").select("target_id", "size", "n_blocks", "rms", (F.col("base") / F.sqrt("size")).alias("expected"))


def _line_sums(accepted: DataFrame, model: str, jitter: float, sigma0: float, sigma1: float) -> DataFrame:
    """Per event, the precision matrix (a b, b d) of the line's coefficients with their priors, and what else of the
    likelihood is a sum."""
    own = W.partitionBy("target_id", "event_number")
    scale = F.max(F.abs("offset")).over(own)
    df = accepted.withColumn("_x", F.when(scale > 0, F.col("offset") / scale).otherwise(0.0))
    v, m, x, r = F.pow(F.col("flux_err"), 2) + jitter**2, F.col(model), F.col("_x"), F.col("flux") - F.col(model)
    return df.groupBy("target_id", "event_number").agg(
        (F.sum(m * m / v) + 1 / sigma0**2).alias("a"), F.sum(m * m * x / v).alias("b"), (F.sum(m * m * x * x / v) + 1 / sigma1**2).alias("d"), F.sum(m * r / v).alias("p"), F.sum(m * x * r / v).alias("q"),
        F.sum(r * r / v).alias("rr"), F.sum(F.log(v)).alias("logs"), F.count("*").alias("n"),
    ).withColumn("det", F.col("a") * F.col("d") - F.col("b") * F.col("b"))


def event_log_likelihood(accepted: DataFrame, model: str, jitter: float, sigma0: float = 0.05, sigma1: float = 0.05) -> DataFrame:
    """Per event, the log likelihood with the line's two coefficients (prior means 1 and 0) integrated out in closed
    form: sums per event and a 2 x 2 determinant, no loop over cadences."""
    s = _line_sums(accepted, model, jitter, sigma0, sigma1)
    a, b, d, det = (F.col(c) for c in ("a", "b", "d", "det"))
    quad = F.col("rr") - (F.col("p") ** 2 * d - 2 * F.col("p") * F.col("q") * b + F.col("q") ** 2 * a) / det
    total = quad + F.col("logs") + F.log(F.lit(sigma0**2 * sigma1**2)) + F.log(det) + F.col("n") * F.log(F.lit(2.0) * F.pi())
    return s.select("target_id", "event_number", "n", (-0.5 * total).alias("log_likelihood"))


def event_conditionals(accepted: DataFrame, model: str, jitter: float, sigma0: float = 0.05, sigma1: float = 0.05) -> DataFrame:
    """Per event, mean, deviation and covariance of the line's two coefficients, given model and data."""
    s = _line_sums(accepted, model, jitter, sigma0, sigma1)
    a, b, d, p, q, det = (F.col(c) for c in ("a", "b", "d", "p", "q", "det"))
    return s.select(
        "target_id", "event_number", (1 + (p * d - q * b) / det).alias("intercept_mean"), ((q * a - p * b) / det).alias("slope_mean"),
        F.sqrt(d / det).alias("intercept_sd"), F.sqrt(a / det).alias("slope_sd"), (-b / det).alias("covariance"),
    )


def model_difference(rows: DataFrame, one: str, other: str, residual: str) -> DataFrame:
    """Per target, how far two model columns are apart, and as a share of the scatter of a residual column: whether a
    model is sampled finely enough."""
    gap = F.col(other) - F.col(one)
    s = rows.groupBy("target_id").agg(F.max(F.abs(gap)).alias("largest"), F.sqrt(F.avg(gap * gap)).alias("rms"), F.stddev_samp(residual).alias("scatter"))
    return s.withColumn("of_scatter", F.when(F.col("scatter") > 0, F.col("largest") / F.col("scatter")))
