"""Convergence history of a growing chain from states that merge: a row of it reads one chunk of draws, never the chain.

The state of a walker's parameter is its number of draws, their sum, the sums of products at each lag, and its first and
last LAGS values: products across the border of two chunks come from the last values of one and the first of the other, so
merged states are those of the whole chain. Quantiles come from sketches (KLL) of each ensemble, which merge, too. R-hat
takes the moments of chunks: the chain is halved at the border of chunks nearest to its middle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .posterior import QUANTILES
from .sampling import LAGS

CHAIN = ["parameter", "ensemble", "walker"]
STATE = "parameter string, ensemble int, walker int, n long, shift double, total double, lags array<double>, head array<double>, tail array<double>"
ROWS = "steps long, parameter string, n long, mean double, sd double, tau double, ess double, rhat double, " + ", ".join(f"{q} double" for q in QUANTILES)
#: Size of the sketches: ranks are right to some 0.2 %.
SKETCH = 2048


def _products(x: np.ndarray) -> np.ndarray:
    """Sums of products at lags 0 to LAGS."""
    return np.array([x[: len(x) - k] @ x[k:] if k < len(x) else 0.0 for k in range(LAGS + 1)])


def state_of(x: np.ndarray, shift: float) -> dict:
    """The state of values in order. They are taken from `shift`, any number near them, so that products keep their digits."""
    y = x - shift
    return {"n": len(y), "shift": shift, "total": float(y.sum()), "lags": _products(y), "head": y[:LAGS], "tail": y[max(0, len(y) - LAGS) :]}


def merged(a: dict, b: dict) -> dict:
    """The state of what a stands for and then b; both from the same shift."""
    across = np.concatenate([a["tail"], b["head"]])
    lags = a["lags"] + b["lags"] + _products(across) - _products(a["tail"]) - _products(b["head"])
    tail = np.concatenate([a["tail"], b["tail"]])
    return {"n": a["n"] + b["n"], "shift": a["shift"], "total": a["total"] + b["total"], "lags": lags, "head": np.concatenate([a["head"], b["head"]])[:LAGS], "tail": tail[max(0, len(tail) - LAGS) :]}


def centred(s: dict) -> np.ndarray:
    """Sums of products of values less their mean, at lags 0 to LAGS."""
    k = np.arange(LAGS + 1)
    first, last = (np.concatenate([[0.0], np.cumsum(v)]) for v in (s["head"], s["tail"][::-1]))
    pad = lambda v: np.concatenate([v, np.full(max(0, LAGS + 1 - len(v)), v[-1])])[: LAGS + 1]
    n, m = s["n"], s["total"] / s["n"]
    return np.where(k < n, s["lags"] - m * (2 * s["total"] - pad(first) - pad(last)) + (n - k) * m * m, 0.0)


def time_of(states: list[dict]) -> tuple[float, float, float, float]:
    """(n, mean, sd, tau) over walkers: the integrated time is one plus twice the autocorrelations up to the first that is
    not positive."""
    n = sum(s["n"] for s in states)
    mean = sum(s["total"] + s["n"] * s["shift"] for s in states) / n
    sums = np.sum([centred(s) for s in states], axis=0)
    spread = sums[0] + sum(s["n"] * (s["total"] / s["n"] + s["shift"] - mean) ** 2 for s in states)
    sd = np.sqrt(spread / (n - 1)) if n > 1 else float("nan")
    longest = max(s["n"] for s in states)
    if longest < 3:
        return n, mean, sd, float("inf")
    if sums[0] <= 0:
        return n, mean, sd, 1.0
    pairs = np.array([sum(max(s["n"] - k, 0) for s in states) for k in range(LAGS + 1)])
    with np.errstate(invalid="ignore", divide="ignore"):
        rho = np.where(pairs > 0, sums / pairs / (sums[0] / n), -1.0)[1:]
    stop = np.flatnonzero(~(rho > 0))
    return n, mean, sd, float(1 + 2 * rho[: stop[0] if len(stop) else len(rho)].sum())


class History:
    """A folder of states and rows, one part for each chunk, named by the steps done by then."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def done(self) -> list[int]:
        """Steps of the chunks that are there whole; rows are written last."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        home = path(f"{self.folder}/rows")
        fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(home)] if fs.exists(home) else []
        return sorted(int(n.removeprefix("steps=")) for n in names if n.startswith("steps=") and fs.exists(path(f"{self.folder}/rows/{n}/_SUCCESS")))

    def _part(self, kind: str, steps: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/steps={steps}")

    def append(self, draws: DataFrame, steps: int) -> bool:
        """Takes in draws(parameter, ensemble, walker, step, value) after those that are there, and writes the row of each
        parameter. Chunks come in order; one that is there already is passed over, and False is returned. Draws that are
        null or not finite are left out; a chunk without any other gives the rows of the chain so far."""
        there = self.done()
        if steps in there:
            return False
        if there and steps < there[-1]:
            raise ValueError(f"steps up to {there[-1]} are there")
        before = there[-1] if there else None
        valid = draws.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select(*CHAIN, "step", "value")
        columns = [c.split()[0] for c in STATE.split(", ")]

        def grow(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            was = [{c: np.asarray(r[c]) if c in ("lags", "head", "tail") else r[c] for c in columns[3:]} for r in old.to_dict("records")]
            x = new.sort_values(["step", "value"])["value"].to_numpy()
            parts = was + ([state_of(x, was[0]["shift"] if was else float(x[0]))] if len(x) else [])
            return pd.DataFrame([[*key, *(reduce(merged, parts)[c] for c in columns[3:])]], columns=columns)

        old = self._part("states", before, STATE) if before is not None else self.spark.createDataFrame([], STATE)
        old.groupBy(*CHAIN).cogroup(valid.groupBy(*CHAIN)).applyInPandas(grow, STATE).write.mode("overwrite").parquet(f"{self.folder}/states/steps={steps}")
        moments = "parameter string, ensemble int, walker int, n long, mean double, spread double"
        own = valid.groupBy(*CHAIN).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("*")).alias("spread"))
        own.write.mode("overwrite").parquet(f"{self.folder}/moments/steps={steps}")
        sketches = valid.groupBy("parameter").agg(F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"))
        if before is not None:
            sketches = sketches.unionByName(self._part("sketches", before, "parameter string, sketch binary")).groupBy("parameter").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
        sketches.write.mode("overwrite").parquet(f"{self.folder}/sketches/steps={steps}")

        def times(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            states = [{c: np.asarray(r[c]) if c in ("lags", "head", "tail") else r[c] for c in columns[3:]} for r in pdf.to_dict("records")]
            n, mean, sd, tau = time_of(states)
            return pd.DataFrame([[*key, n, mean, sd, tau, n / max(tau, 1.0)]], columns=["parameter", "n", "mean", "sd", "tau", "ess"])

        told = self._part("states", steps, STATE).groupBy("parameter").applyInPandas(times, "parameter string, n long, mean double, sd double, tau double, ess double")
        chunks = reduce(DataFrame.unionByName, [self._part("moments", s, moments).withColumn("chunk", F.lit(s)) for s in (*there, steps)])
        middle = min((*there, steps)[:-1] or (steps,), key=lambda s: (abs(s - steps / 2), s))
        halves = chunks.withColumn("half", (F.col("chunk") > middle).cast("int")).groupBy(*CHAIN, "half").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.sum("spread").alias("_in"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("_sq"))
        halves = halves.withColumn("v", (F.col("_in") + F.col("_sq") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1)).where("n > 1")
        rhat = halves.groupBy("parameter").agg(F.avg("v").alias("w"), F.var_samp("mean").alias("b"), F.min("n").alias("least"))
        rhat = rhat.select("parameter", F.expr("CASE WHEN w > 0 THEN sqrt(((least - 1) / least * w + b) / w) ELSE 1 END").alias("rhat"))
        edges = self._part("sketches", steps, "parameter string, sketch binary").select("parameter", *(F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(q) for q, p in QUANTILES.items()))
        rows = told.join(rhat, "parameter", "left").join(edges, "parameter").withColumn("steps", F.lit(steps).cast("long"))
        rows.select(*(c.split()[0] for c in ROWS.split(", "))).write.mode("overwrite").parquet(f"{self.folder}/rows/steps={steps}")
        return True

    def rows(self) -> DataFrame:
        """A row for each chunk and parameter, in the columns of ROWS."""
        parts = [self._part("rows", s, ROWS) for s in self.done()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], ROWS)
