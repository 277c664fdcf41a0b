"""Posterior samples as long tables: summaries, convergence, stability and agreement of ensembles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written
from .series import alike, pieces, placed, quantiles

QUANTILES = {"q02_5": 0.025, "q16": 0.16, "median": 0.5, "q84": 0.84, "q97_5": 0.975}
CHAIN = ("parameter", "ensemble", "walker")
SHIFT, OVERLAP, STABLE = 3.0, 0.25, 0.25


def after_warmup(chain: DataFrame, warmup: int) -> DataFrame:
    """Draws after the warm-up, but always the last one of a chain."""
    last = F.max("step").over(W.partitionBy("ensemble", "walker"))
    return chain.where(F.col("step") >= F.lit(0)).withColumn("_last", last).where(F.col("step") >= F.least(F.lit(warmup), F.col("_last"))).drop("_last")


def long_form(chain: DataFrame, parameters: list[str]) -> DataFrame:
    return chain.unpivot(["ensemble", "walker", "step"], parameters, "parameter", "value")


def counted(draws: DataFrame, *by: str) -> DataFrame:
    """(by, parameter, value, n) of draws, written once; several summaries can be made of it."""
    return written(draws.groupBy(*by, "parameter", "value").agg(F.count("*").alias("n")))


def summary(draws: DataFrame, *by: str) -> DataFrame:
    """Quantiles, mean and sample deviation of value over the columns `by` and parameter."""
    return summary_of_counts(counted(draws, *by), *by)


def summary_of_counts(counts: DataFrame, *by: str) -> DataFrame:
    """The same of counts(by, parameter, value, n)."""
    keys = [*by, "parameter"]
    times = F.when(F.col("value").isNotNull(), F.col("n"))
    means = written(counts.groupBy(*keys).agg(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum(times)).alias("mean"), F.sum(times).alias("_known"), F.sum("n").alias("n")))
    off = alike(counts.select(*keys, "value", F.col("n").alias("_times")), means, keys)
    off = off.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(F.col("_times") * (F.col("value") - F.col("mean")) ** 2), F.max("_known") - 1)).alias("sd"))
    df = alike(alike(means, off, keys), quantiles(counts, keys, "value", list(QUANTILES.values())), keys, "left")
    return df.select(*by, "parameter", *(F.col("q")[k].alias(n) for k, n in enumerate(QUANTILES)), "mean", "sd", "n")


def split_rhat(draws: DataFrame) -> DataFrame:
    """(parameter, rhat): chains are halved (an odd last draw is left out) and their means held against their spread."""
    return rhat_of(pieces(draws, list(CHAIN), ["step", "value"], "value"))


def rhat_of(cut: DataFrame) -> DataFrame:
    """The same of pieces of draws by CHAIN. A piece gives count, mean and squares of what lies in either half; nulls
    have a place but no value."""
    kinds = dict(cut.dtypes)

    def halved(batches):
        for batch in batches:
            for k, values in enumerate(batch.column("values")):
                start, half = batch.column("_start")[k].as_py(), batch.column("_n")[k].as_py() // 2
                rows = []
                for h in (0, 1):
                    low, high = max(h * half - start, 0), min((h + 1) * half - start, len(values))
                    if half < 2 or low >= high:
                        continue
                    x = values.values[low:high].drop_null().to_numpy()
                    with np.errstate(invalid="ignore", over="ignore"):
                        mean = (x[0] if (x == x[0]).all() else x.mean()) if len(x) else None
                        rows.append((h, high - low, len(x), mean, float(((x - mean) ** 2).sum()) if len(x) else 0.0))
                if rows:
                    own = [pa.concat_arrays([batch.column(c)[k : k + 1]] * len(rows)) for c in CHAIN]
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())))], names=[*CHAIN, "half", "n", "known", "mean", "off"])

    each = placed(cut, list(CHAIN)).select(*CHAIN, "_start", "_n", "values")
    parts = written(each.mapInArrow(halved, ", ".join(f"{c} {kinds[c]}" for c in CHAIN) + ", half long, n long, known long, mean double, off double"))
    own = W.partitionBy(*CHAIN, "half")
    mean = F.when(F.min("mean").over(own) == F.max("mean").over(own), F.min("mean").over(own)).otherwise(F.try_divide(F.sum(F.col("known") * F.col("mean")).over(own), F.sum("known").over(own)))
    squares = F.sum(F.col("off") + F.coalesce(F.col("known") * (F.col("mean") - F.col("m")) ** 2, F.lit(0.0)))
    halves = parts.withColumn("m", mean).groupBy(*CHAIN, "half").agg(F.max("m").alias("m"), F.try_divide(squares, F.sum("known") - 1).alias("v"), F.sum("n").alias("n"))
    out = halves.groupBy("parameter").agg(F.avg("v").alias("within"), F.var_samp("m").alias("spread"), F.min("n").alias("n"), F.count("*").alias("n_halves"))
    rhat = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("within") + F.col("spread")) / F.col("within"))
    return out.select("parameter", "n_halves", F.when(F.col("within") <= 0, F.lit(1.0)).otherwise(rhat).alias("rhat"))


def stability(history: DataFrame, chunks: int = 3) -> DataFrame:
    """Changes of summaries(steps, parameter, quantiles, sd) over the last chunks that exceed STABLE widths."""
    recent = history.withColumn("_age", F.dense_rank().over(W.partitionBy("parameter").orderBy(F.desc("steps")))).where(F.col("_age") <= chunks)
    last = recent.where("_age = 1")
    scale = F.greatest(F.abs(F.col("l.q84") - F.col("l.q16")), F.coalesce(F.col("l.sd"), F.lit(0.0)), F.lit(1e-12))
    pairs = last.alias("l").join(recent.where("_age > 1").alias("r"), "parameter")
    fields = F.array(*(F.struct(F.lit(n).alias("field"), (F.abs(F.col(f"l.{n}") - F.col(f"r.{n}")) / scale).alias("change")) for n in QUANTILES))
    return pairs.select("parameter", F.col("r.steps").alias("steps"), F.explode(fields).alias("x")).select("parameter", "steps", "x.*").withColumn("stable", F.col("change") <= STABLE)


def agreement(draws: DataFrame) -> DataFrame:
    """Each ensemble's summary against that of all: shift of the median in widths, and overlap of the central intervals.

    Parameters are few, so the combined summary is one row each and is broadcast.
    """
    return agreement_of_counts(counted(draws, "ensemble"))


def agreement_of_counts(counts: DataFrame) -> DataFrame:
    """The same of counts(ensemble, parameter, value, n)."""
    each, both = summary_of_counts(counts, "ensemble"), summary_of_counts(written(counts.groupBy("parameter", "value").agg(F.sum("n").alias("n"))))
    df = each.alias("e").join(F.broadcast(both.alias("c")), "parameter")
    scale = F.greatest(F.col("c.q84") - F.col("c.q16"), F.coalesce(F.col("c.sd"), F.lit(0.0)), F.lit(1e-12))
    width = F.greatest(F.least("e.q84", "c.q84") - F.greatest("e.q16", "c.q16"), F.lit(0.0))
    least = F.greatest(F.least(F.col("e.q84") - F.col("e.q16"), F.col("c.q84") - F.col("c.q16")), F.lit(1e-12))
    df = df.select("parameter", "ensemble", (F.abs(F.col("e.median") - F.col("c.median")) / scale).alias("shift"), (width / least).alias("overlap"))
    return df.withColumn("agrees", (F.col("shift") <= SHIFT) & (F.col("overlap") >= OVERLAP))


def truth_coverage(summaries: DataFrame, truth: DataFrame) -> DataFrame:
    """summaries(parameter, quantiles) against truth(parameter, injected): widths, and whether the intervals hold it."""
    df = summaries.join(truth, "parameter")
    inside = lambda low, high: F.col("injected").between(F.col(low), F.col(high))
    return df.select(
        "parameter", "injected", "median", (F.col("q84") - F.col("q16")).alias("width_68"), (F.col("q97_5") - F.col("q02_5")).alias("width_95"),
        inside("q16", "q84").alias("inside_68"), inside("q02_5", "q97_5").alias("inside_95"),
    )


def near_best(log_prob: DataFrame, distances: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0)) -> DataFrame:
    """(distance, fraction) of log_prob(value): the share of finite values that lie so near the best; 0 without any."""
    ok = log_prob.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    best = ok.agg(F.max("value").alias("best"))  # one row
    near = ok.crossJoin(F.broadcast(best)).select(*(F.avg((F.col("value") >= F.col("best") - d).cast("double")).alias(f"d{k}") for k, d in enumerate(distances)))
    pairs = F.array(*(F.struct(F.lit(d).alias("distance"), F.coalesce(F.col(f"d{k}"), F.lit(0.0)).alias("fraction")) for k, d in enumerate(distances)))
    return near.select(F.explode(pairs).alias("x")).select("x.*")


def histogram(draws: DataFrame, bins: int = 30) -> DataFrame:
    """(parameter, bin, n) in equal bins from the least to the greatest value, the last one closed; empty bins are left out."""
    edges = draws.groupBy("parameter").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    df = draws.join(F.broadcast(edges), "parameter")
    at = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    return df.groupBy("parameter", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def correlations(chain: DataFrame, parameters: list[str]) -> DataFrame:
    """(x, y, correlation) of every two parameters, in one aggregate over the chain."""
    pairs = [(x, y) for i, x in enumerate(parameters) for y in parameters[i:]]
    one = chain.agg(*(F.corr(x, y).alias(f"{x}~{y}") for x, y in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"`{x}~{y}`").alias("correlation")) for x, y in pairs))).alias("p")).select("p.*")


def criteria(rhat: DataFrame, sizes: DataFrame, stable: DataFrame, agrees: DataFrame, finite: DataFrame, parameters: list[str], steps: int, most_rhat: float = 1.01, least_size: float = 1000.0, times: float = 50.0) -> DataFrame:
    """(criterion, holds): the eleven conditions of a converged chain, each a row; a chain has converged if all hold.

    rhat(parameter, rhat), sizes(parameter, ess, tail_ess, tau), stable(stable) and agrees(agrees) as made above;
    finite(is_finite) has a row for each draw. A measure that lacks or is not finite for a parameter is incomplete, and
    none of the conditions on it holds.
    """
    n = len(parameters)
    known = F.col("parameter").isin(parameters)
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    count = lambda cond: F.count_if(known & F.coalesce(cond, F.lit(False))) == n
    r = rhat.agg(count(usable("rhat")).alias("complete_valid_rhat"), count(usable("rhat") & (F.col("rhat") < most_rhat)).alias("rhat_all_below_threshold"))
    s = sizes.agg(
        count(usable("ess")).alias("complete_valid_bulk_ess"), count(usable("tail_ess")).alias("complete_valid_tail_ess"), count(usable("ess") & (F.col("ess") >= least_size)).alias("ess_all_above_minimum"),
        count(usable("tail_ess") & (F.col("tail_ess") >= least_size)).alias("tail_ess_all_above_minimum"), count(usable("tau")).alias("complete_valid_autocorrelation"),
        count(usable("tau") & (F.lit(steps) > times * F.col("tau"))).alias("chain_length_exceeds_tau_multiple"),
    )
    all_of = lambda df, c, name: df.agg(F.coalesce(F.every(F.coalesce(F.col(c), F.lit(False))), F.lit(False)).alias(name))
    ends = [all_of(stable, "stable", "posterior_summary_stability"), all_of(agrees, "agrees", "independent_ensemble_agreement"), all_of(finite, "is_finite", "finite_log_probability_fraction_is_one")]
    one = r.crossJoin(s)  # rows of one aggregate each
    for e in ends:
        one = one.crossJoin(e)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("criterion"), F.col(c).alias("holds")) for c in one.columns))).alias("x")).select("x.*")
