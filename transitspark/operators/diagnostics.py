"""Convergence of chains by ranks: rank-normalised split R-hat, bulk and tail sizes, autocorrelation times by ensemble.

draws(parameter, ensemble, walker, step, value) are long tables; the columns `by` tell several runs apart. Draws that
are null or not finite are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import written
from .sampling import LAGS, _across, _products
from .series import HELD, SEGMENT, alike, numbered, pieces, placed, quantiles, running

CHAIN = ("ensemble", "walker")
#: A window of the autocorrelation is wide enough at so many times the time that it gives.
WIDE = 5.0
#: Numerators and denominators of the normal quantile near the middle, in the tails and far out: algorithm AS 241
#: (Wichura, 1988), from the constant term on. Fixed values.
MIDDLE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
TAIL = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
FAR = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def ratio(coefficients: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    """SQL of a ratio of two polynomials of x, by Horner's rule."""
    top, below = ("(" * (len(c) - 1) + f"{c[-1]!r}" + "".join(f" * {x} + {a!r})" for a in reversed(c[:-1])) for c in coefficients)
    return f"({top} / {below})"


def sql_normal_quantile(p: str) -> str:
    """SQL of the standard normal quantile of p (0 < p < 1), right to some 16 digits; for Spark and other engines."""
    q, r = f"({p} - 0.5e0)", f"sqrt(-ln(least({p}, 1e0 - {p})))"
    out = f"CASE WHEN {r} <= 5e0 THEN {ratio(TAIL, f'({r} - 1.6e0)')} ELSE {ratio(FAR, f'({r} - 5e0)')} END"
    return f"CASE WHEN abs{q} <= 0.425e0 THEN {q} * {ratio(MIDDLE, f'(0.180625e0 - {q} * {q})')} ELSE sign{q} * {out} END"


def normal_quantile(p: str) -> Column:
    return F.expr(sql_normal_quantile(p))


def mean_ranks(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, rank, n, total): for each distinct value of a key its rank from 1, ties at their mean, how often it
    is there, and the rows of the key.

    Distinct values are counted first, see `running`.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running(counts, keys, value).select(*keys, value, (F.col("up_to") - (F.col("n") - 1) / 2).alias("rank"), "n", "total")


def halves(draws: DataFrame, *by: str) -> DataFrame:
    """Finite draws of halved chains: (by, parameter, ensemble, walker, half, k, value), k the place in the half from 0.
    An odd last draw is left out, and so are chains of fewer than four draws."""
    valid = draws.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    chain = [*by, "parameter", *CHAIN]
    df = numbered(valid.select(*chain, "step", "value"), chain, "step", "value").withColumn("_half", F.floor(F.col("_n") / 2))
    df = df.where("_half >= 2 and _place < 2 * _half")
    return df.select(*chain, F.floor(F.col("_place") / F.col("_half")).cast("int").alias("half"), F.pmod("_place", "_half").cast("long").alias("k"), "value")


#: A value that more draws than this have is often: its score is broadcast, one for so many rows at most.
OFTEN = 50_000


def scores(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, n, z): normal scores of the mean ranks of counts(keys, value, n), (rank - 3/8) / (total + 1/4)."""
    ranked = running(counts, keys, "value").withColumn("_p", F.expr("(up_to - (n - 1) / 2e0 - 0.375e0) / (total + 0.25e0)"))
    return ranked.select(*keys, "value", "n", normal_quantile("_p").alias("z"))


#: Scores that are broadcast at most, in rows.
SCORES = 1_000_000


def normal_scores(rows: DataFrame, found: DataFrame, *by: str, most: int = SCORES) -> DataFrame:
    """rows with z of found(by, parameter, value, n, z), the scores of values. Up to `most` of them are broadcast, so rows
    stay where they are; else rows of one value don't meet in a task."""
    keys = [*by, "parameter"]
    if found.count() <= most:
        return alike(rows, F.broadcast(found.drop("n")), [*keys, "value"])
    often = F.broadcast(found.where(F.col("n") > OFTEN).drop("n"))
    rare = alike(alike(rows, often.drop("z"), [*keys, "value"], "left_anti"), found.where(F.col("n") <= OFTEN).drop("n"), [*keys, "value"])
    return rare.unionByName(alike(rows, often, [*keys, "value"]))


def folded(counts: DataFrame, *by: str) -> DataFrame:
    """counts(by, parameter, value, n, ..) whose values are distances from the median of their parameter."""
    keys = [*by, "parameter"]
    all_ = written(counts.groupBy(*keys, "value").agg(F.sum("n").alias("n")))
    middle = written(quantiles(all_, keys, "value", [0.5]).select(*keys, F.col("q")[0].alias("_middle")))
    return counts.join(middle, keys).withColumn("value", F.abs(F.col("value") - F.col("_middle"))).drop("_middle")


def _rhat(counts: DataFrame, *by: str) -> DataFrame:
    """(by, parameter, rhat) of scored values of chains, counts(by, parameter, CHAIN, half, value, n); infinite with fewer
    than two chains, 1 where none varies. Draws are counted by chain and value, so a value that is often is few rows."""
    keys, chain = [*by, "parameter"], [*by, "parameter", *CHAIN, "half"]
    z = scores(counts.groupBy(*keys, "value").agg(F.sum("n").alias("n")), keys).drop("n")
    scored = written(counts.join(z, [*keys, "value"]).select(*chain, "n", "z"))
    mean = F.when(F.min("z") == F.max("z"), F.min("z")).otherwise(F.sum(F.col("n") * F.col("z")) / F.sum("n"))
    means = written(scored.groupBy(*chain).agg(mean.alias("m"), F.sum("n").alias("_n")))
    off = alike(scored, means, chain).groupBy(*chain).agg(F.max("m").alias("m"), (F.sum(F.col("n") * (F.col("z") - F.col("m")) ** 2) / (F.max("_n") - 1)).alias("v"), F.max("_n").alias("n"))
    out = off.groupBy(*keys).agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.min("n").alias("n"), F.count("*").alias("m"))
    value = F.expr("CASE WHEN m < 2 THEN double('inf') WHEN w <= 0 AND b <= 0 THEN 1 WHEN w <= 0 THEN double('inf') ELSE sqrt(((n - 1) / n * w + b) / w) END")
    return out.select(*keys, value.alias("rhat"))


def rank_rhat(draws: DataFrame, *by: str) -> DataFrame:
    """(by, parameter, rhat_bulk, rhat_tail, rhat): split R-hat of normal scores, that of the folded draws, and the
    greater of them. Parameters without a chain of four draws are left out."""
    keys = [*by, "parameter"]
    counts = written(halves(draws, *by).groupBy(*keys, *CHAIN, "half", "value").agg(F.count("*").alias("n")))
    bulk = _rhat(counts, *by).withColumnRenamed("rhat", "rhat_bulk")
    tail = _rhat(folded(counts, *by), *by).withColumnRenamed("rhat", "rhat_tail")
    return bulk.join(tail, keys).withColumn("rhat", F.greatest("rhat_bulk", "rhat_tail"))


#: Series of which sizes are made: scores, and which draws lie up to the 5 % and the 95 % quantile.
OF_RANKS = ("z", "low", "high")


def _pooled(n: np.ndarray, means: np.ndarray, squares: np.ndarray) -> tuple[float, float]:
    """(within, pooled): variance within chains of n values, and with that between their means."""
    least, within = n.min(), float(np.mean(squares / (n - 1)))
    return within, float(within * (least - 1) / least + (np.var(means, ddof=1) if len(n) > 1 else 0.0))


def _falling(rho: np.ndarray, before: float, total: float) -> tuple[bool, float, float]:
    """(done, before, total): autocorrelations are summed in pairs while these are positive, made to fall from `before` on
    (Geyer's initial monotone sequence); of the pair that ends the sum the first half counts if it is positive."""
    pairs = rho[: len(rho) // 2 * 2].reshape(-1, 2).sum(axis=1)
    stop = np.flatnonzero(pairs < 0)
    last = int(stop[0]) if len(stop) else len(pairs)
    falling = np.minimum.accumulate(np.append(before, pairs[:last]))
    return bool(len(stop)), float(falling[-1]), total + float(falling[1:].sum()) + (max(float(rho[2 * last]), 0.0) / 2 if len(stop) else 0.0)


def _size(draws: float, total: float) -> float:
    """Effective size of so many draws, from the sum of pairs."""
    return min(draws / max(2 * total - 1, 1 / np.log10(draws)), draws * np.log10(draws))


def _correlation(acov: np.ndarray, shortest: int, within: float, pooled: float) -> np.ndarray:
    return 1 - (within - acov * shortest / (shortest - 1)) / pooled


def _halved(pdf: pd.DataFrame) -> Iterator[tuple]:
    """(row, half, place in the half, series) of pieces of scores; an odd last draw is left out."""
    for k, (start, n, z, low, high) in enumerate(zip(pdf["_start"], pdf["_n"], pdf["values"], pdf["_low"], pdf["_high"])):
        for half in (0, 1):
            first, last = max(half * (n // 2) - start, 0), min((half + 1) * (n // 2) - start, len(z))
            if first < last:
                x = z[first:last]
                yield k, half, start + first - half * (n // 2), np.array([x, x <= low, x <= high], float)


def _near_lags(cut: DataFrame, chain: list[str]) -> DataFrame:
    """(chain, half, n, means, sums): of each series of a halved chain its mean and sums of products of what is off it, up
    to LAGS places apart, one after the other. A piece gives its own products and its ends; a task that reads the pieces
    of a chain in order holds one at a time."""
    kinds = dict(cut.dtypes)
    own = ", ".join(f"`{c}` {kinds[c]}" for c in chain) + ", half int"

    def totals(batches):
        for pdf in batches:
            rows = [(k, half, x.shape[1], x.sum(axis=1), x[0].min(), x[0].max()) for k, half, _, x in _halved(pdf)]
            k, half, n, sums, least, most = zip(*rows) if rows else [()] * 6
            yield pdf[chain].iloc[list(k)].assign(half=half, n=n, sums=sums, least=least, most=most)

    sums = cut.mapInPandas(totals, own + ", n long, sums array<double>, least double, most double").groupBy(*chain, "half")
    mean = F.when(F.min("least") == F.max("most"), F.min("least")).otherwise(F.sum(F.col("sums")[0]) / F.sum("n"))
    each = sums.agg(F.sum("n").alias("n"), F.array(mean, *(F.sum(F.col("sums")[k]) / F.sum("n") for k in (1, 2))).alias("means"))
    means = written(each.groupBy(*chain).agg(F.transform(F.sort_array(F.collect_list(F.struct("half", "means"))), lambda x: x["means"]).alias("_means")))

    def products(batches):
        for pdf in batches:
            rows = []
            for k, half, at, x in _halved(pdf):
                m = np.asarray(pdf["_means"].iloc[k][half])
                off = x - m[:, None]
                rows.append((k, half, at, x.shape[1], m, _products(off).ravel(), off[:, :LAGS].ravel(), off[:, max(off.shape[1] - LAGS, 0) :].ravel()))
            k, *columns = zip(*rows) if rows else [()] * 8
            yield pdf[chain].iloc[list(k)].assign(**dict(zip(("half", "_at", "n", "means", "sums", "head", "tail"), columns)))

    parts = alike(cut, means, chain).mapInPandas(products, own + ", _at long, n long, " + ", ".join(f"{c} array<double>" for c in ("means", "sums", "head", "tail")))
    parts = parts.repartition(*chain, "half").sortWithinPartitions(*chain, "half", "_at").drop("_at")

    def joined(batches):
        key, n, means, total, tail = None, 0, None, None, None
        for pdf in batches:
            done = []
            for *now, more, m, sums, head, last in pdf.itertuples(index=False):
                now = tuple(None if pd.isna(x) else x for x in now)
                sums, head, last = (np.asarray(x).reshape(len(OF_RANKS), -1) for x in (sums, head, last))
                if now != key:
                    if key is not None:
                        done.append((*key, n, means, total.ravel()))
                    key, n, means, total, tail = now, 0, m, np.zeros_like(sums), last[:, :0]
                total, n = total + sums + _across(tail, head), n + more
                tail = np.concatenate([tail, last], axis=1)[:, -LAGS:]
            yield pd.DataFrame(done, columns=[*chain, "half", "n", "means", "sums"])
        if key is not None:
            yield pd.DataFrame([(*key, n, means, total.ravel())], columns=[*chain, "half", "n", "means", "sums"])

    return parts.mapInPandas(joined, own + ", n long, means array<double>, sums array<double>")


def _far_sizes(cut: DataFrame, still: DataFrame, chain: list[str], keys: list[str], segment: int) -> DataFrame:
    """(keys, series, ess) of still(keys, series, draws, shortest, chains, within, pooled): groups that hang together over
    more than LAGS places. Lags come from transforms of pairs of segments, in rounds, see `autocorrelation_times`."""
    kinds = dict(cut.dtypes)
    long, group = [*chain, "half", "series"], [*keys, "series"]
    own = ", ".join(f"`{c}` {kinds[c]}" for c in chain) + ", half int, series int"

    def split(batches):
        for pdf in batches:
            rows = [(k, half, s, at, pdf["_n"].iloc[k] // 2, x.shape[1], x[s]) for k, half, at, x in _halved(pdf) for s in pdf["_series"].iloc[k]]
            k, *columns = zip(*rows) if rows else [()] * 7
            yield pdf[chain].iloc[list(k)].assign(**dict(zip(("half", "series", "_start", "_n", "n", "values"), columns)))

    wanted = written(still.groupBy(*keys).agg(F.collect_list("series").alias("_series")))
    parts = alike(cut, wanted, keys).mapInPandas(split, own + ", _start long, _n long, n long, values array<double>")
    segments = _aligned(written(parts), long, segment)
    state = ["draws long", "shortest long", "chains long", "within double", "pooled double", "before double", "total double", "done boolean"]
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", series int"

    def chains(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, sum(np.asarray(x) / n for x, n in zip(pdf["sums"], pdf["_n"]))]], columns=[*group, "_lags", "acov"])

    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        draws, shortest, m, within, pooled, before, total = (pdf[c.split()[0]].iloc[0] for c in state[:-1])
        done = False
        for lags, acov in sorted(zip(pdf["_lags"], pdf["acov"])):
            rho = _correlation(np.asarray(acov)[: max(shortest - lags * segment, 0)] / m, shortest, within, pooled)
            if lags == 0:
                rho[0] = 1.0
            done, before, total = _falling(rho, before, total)
            done = done or shortest <= (lags + 1) * segment
            if done:
                break
        return pd.DataFrame([[*key, draws, shortest, m, within, pooled, before, total, done]], columns=[*group, *(c.split()[0] for c in state)])

    found, first, last = [], 0, 1
    still = still.withColumns({"before": F.lit(float("inf")), "total": F.lit(0.0)})
    while True:
        sums = _lag_sums(alike(segments, still.select(*group), group), long, segment, first, last)
        acov = sums.groupBy(*group, "_lags").applyInPandas(chains, f"{out}, _lags long, acov array<double>")
        after = written(alike(acov, still, group).groupBy(*group).applyInPandas(scan, f"{out}, {', '.join(state)}"))
        found.append(after.where("done"))
        still = after.where("NOT done").drop("done")
        if still.isEmpty():
            break
        first, last = last, min(2 * last, last + ROUND)
    return reduce(DataFrame.unionByName, found)


def rank_sizes(draws: DataFrame, *by: str, segment: int = SEGMENT, most: int = SCORES) -> DataFrame:
    """(by, parameter, ess, tail_ess): bulk size of normal scores of halved chains, and the smaller size of the two
    indicators of draws up to the 5 % and the 95 % quantile. Parameters without a chain of four draws are left out.

    Values are counted, and each draw's score takes its value's place, before draws are put in order; a draw lies up to a
    quantile if its score does. So draws are moved once, and kept once as arrays. Sums of products at LAGS lags are
    mostly enough to find where a sum over lags ends; only what hangs together longer is cut into segments.
    """
    keys, chain = [*by, "parameter"], [*by, "parameter", *CHAIN]
    valid = draws.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select(*chain, "step", "value")
    ends = written(valid.groupBy(*chain).agg(F.count("*").alias("_n"), F.max(F.struct("step", "value"))["value"].alias("value")))
    odd = ends.where("_n >= 4 AND _n % 2 = 1").groupBy(*keys, "value").agg((-F.count("*")).alias("n"))
    counts = alike(valid, ends.where("_n >= 4").select(*chain), chain).groupBy(*keys, "value").agg(F.count("*").alias("n"))
    counts = written(counts.unionByName(odd).groupBy(*keys, "value").agg(F.sum("n").alias("n")).where("n > 0"))
    found = written(scores(counts, keys))
    up_to = lambda k: F.max(F.when(F.col("value") <= F.col("q")[k], F.col("z")))
    edges = written(alike(found, written(quantiles(counts, keys, "value", [0.05, 0.95])), keys).groupBy(*keys).agg(up_to(0).alias("_low"), up_to(1).alias("_high")))
    cut = placed(pieces(normal_scores(valid, found, *by, most=most).select(*chain, "step", "z"), chain, ["step", "z"], "z", segment), chain)
    cut = alike(cut.where("_n >= 4"), edges, keys)
    kinds = dict(valid.dtypes)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, rows = pdf["n"].to_numpy(), []
        means, sums = np.stack(pdf["means"]), np.stack(pdf["sums"]).reshape(len(n), len(OF_RANKS), -1)
        shortest, count = int(n.min()), float(n.sum())
        for s in range(len(OF_RANKS)):
            within, pooled = _pooled(n, means[:, s], sums[:, s, 0])
            ess = float("nan") if shortest < 4 else count if pooled <= 1e-300 else None
            if ess is None:
                rho = _correlation((sums[:, s, : min(LAGS, shortest)] / n[:, None]).mean(axis=0), shortest, within, pooled)
                rho[0] = 1.0
                done, _, total = _falling(rho, float("inf"), 0.0)
                ess = _size(count, total) if done or shortest <= LAGS else None
            rows.append((*key, s, int(count), shortest, len(n), within, pooled, ess, ess is None))
        return pd.DataFrame(rows, columns=[*keys, "series", "draws", "shortest", "chains", "within", "pooled", "ess", "still"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", series int, draws long, shortest long, chains long, within double, pooled double, ess double, still boolean"
    sizes = written(_near_lags(cut, chain).groupBy(*keys).applyInPandas(one, schema))
    each, still = sizes.where("NOT still").select(*keys, "series", "ess"), sizes.where("still").drop("ess", "still")
    if not still.isEmpty():
        size = F.udf(lambda n, total: float(_size(n, total)), "double")
        each = each.unionByName(_far_sizes(cut, still, chain, keys, segment).select(*keys, "series", size("draws", "total").alias("ess")))
    of = lambda s: F.min(F.when(F.col("series").isin(s), F.col("ess")))
    return each.groupBy(*keys).agg(of([0]).alias("ess"), of([1, 2]).alias("tail_ess"))


def _segments(valid: DataFrame, chain: list[str], segment: int) -> DataFrame:
    """`_aligned` of rows."""
    return _aligned(placed(pieces(valid, chain, ["step", "value"], "value", segment), chain).drop("_range", "_piece"), chain, segment)


def _aligned(cut: DataFrame, chain: list[str], segment: int) -> DataFrame:
    """(chain, _n, _at, c0, x): centred values of a chain from place _at * segment on, in arrays of `segment` values (the
    last one shorter), and the chain's sum of squares; written once."""
    kinds = dict(cut.dtypes)
    own = ", ".join(f"`{c}` {kinds[c]}" for c in chain)

    def totals(batches):
        for pdf in batches:
            yield pdf[chain].assign(n=pdf["n"], total=[x.sum() for x in pdf["values"]], least=[x.min() for x in pdf["values"]], most=[x.max() for x in pdf["values"]])

    mean = F.when(F.min("least") == F.max("most"), F.min("least")).otherwise(F.sum("total") / F.sum("n"))
    means = written(cut.mapInPandas(totals, own + ", n long, total double, least double, most double").groupBy(*chain).agg(mean.alias("_mean")))

    def aligned(batches):
        for pdf in batches:
            rows = []
            for k, (start, values, m) in enumerate(zip(pdf["_start"], pdf["values"], pdf["_mean"])):
                x = values - m
                edges = [0, *range(segment - start % segment, len(x), segment), len(x)]
                rows += [(k, (start + i) // segment, start + i, x[i:j]) for i, j in zip(edges, edges[1:])]
            k, at, first, x = zip(*rows)
            yield pdf[[*chain, "_n"]].iloc[list(k)].assign(_at=at, first=first, x=x)

    parts = alike(cut, means, chain).mapInPandas(aligned, own + ", _n long, _at long, first long, x array<double>")
    whole = parts.groupBy(*chain, "_n", "_at").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "x"))), lambda p: p["x"])).alias("x"))
    segments = written(whole)
    squares = written(segments.groupBy(*chain).agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("c0")))
    return alike(segments, squares, chain)


def _lag_sums(segments: DataFrame, chain: list[str], segment: int, first: int, last: int) -> DataFrame:
    """(chain, _n, c0, _lags, sums): sums of products at lags _lags * segment + (0 to segment - 1) of each chain, for _lags
    from first to last - 1. A segment meets the two that lie so far before it; a task adds up what it makes."""
    kinds = dict(segments.dtypes)
    later = segments.select(*chain, "_n", "c0", "_at", F.col("x").alias("later"), F.explode(F.sequence(F.lit(first), F.lit(last - 1)).cast("array<long>")).alias("_lags")).where("_lags <= _at")
    near = segments.select(*chain, F.col("_at").alias("_a"), F.col("x").alias("near"))
    far = segments.select(*chain, F.col("_at").alias("_b"), F.col("x").alias("far"))
    pairs = alike(later.withColumn("_a", F.col("_at") - F.col("_lags")).withColumn("_b", F.col("_a") - 1), near, [*chain, "_a"])
    pairs = alike(pairs, far, [*chain, "_b"], "left").select(*chain, "_n", "c0", "_lags", "later", "near", "far")
    size = 1 << (3 * segment - 1).bit_length()

    def products(batches):
        held = {}

        def table():
            return pd.DataFrame([(*k, x) for k, x in held.items()], columns=[*chain, "_n", "c0", "_lags", "sums"])

        for pdf in batches:
            for *key, later, near, far in pdf.itertuples(index=False):
                z = np.zeros(2 * segment)
                if far is not None:
                    z[: len(far)] = far  # whole, for it is not the last one
                z[segment : segment + len(near)] = near
                # lag r pairs later[t] with z[segment + t - r]
                full = np.fft.irfft(np.fft.rfft(later, size) * np.conj(np.fft.rfft(z, size)), size)
                sums = full[(np.arange(segment) - segment) % size]
                key = tuple(key)
                held[key] = held[key] + sums if key in held else sums
                if len(held) * segment > HELD:
                    yield table()
                    held.clear()
        if held:
            yield table()

    own = ", ".join(f"`{c}` {kinds[c]}" for c in chain) + ", _n long, c0 double, _lags long, sums array<double>"
    return pairs.mapInPandas(products, own)


#: Arrays of lags that one round looks at, at most.
ROUND = 64


def autocorrelation_times(draws: DataFrame, parameters: list[str], wide: float = WIDE, segment: int = SEGMENT) -> DataFrame:
    """(ensemble, parameter, tau, available, retained_steps, error): the integrated autocorrelation time of each ensemble.

    Walkers' autocorrelations are averaged over the ensemble; they are summed up to the first lag that is at least `wide`
    times the time so far. They come from transforms of pairs of segments, so no task holds a walker, and in rounds:
    the lags of one segment first, then more and more for ensembles whose time is still open, up to the longest walker.
    Every ensemble has a row for each parameter; without draws, or with a walker that never moves, the row is not
    available and says why. Lags past the end of a shorter walker count as 0.
    """
    valid = draws.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    group = ["ensemble", "parameter"]
    chain = [*group, "walker"]
    segments = _segments(valid, chain, segment)
    walkers = segments.select(*chain, "_n", "c0").distinct()
    usable = F.coalesce((F.col("c0") > 0) & (F.col("c0") < float("inf")), F.lit(False))
    known = written(walkers.groupBy(*group).agg(F.max("_n").alias("longest"), F.count("*").alias("walkers"), F.every(usable).alias("fine")))
    kinds = dict(draws.dtypes)
    schema = f"ensemble {kinds['ensemble']}, parameter string, longest long, walkers long, total double, tau double, done boolean"

    def scan(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        longest, walkers, total = int(pdf["longest"].iloc[0]), int(pdf["walkers"].iloc[0]), float(pdf["total"].iloc[0])
        done, tau, last = False, None, 0
        for lags, own in pdf.groupby("_lags"):
            last = int(lags)
            mean = sum(np.asarray(x) / c for x, c in zip(own["sums"], own["c0"])) / walkers
            at = np.arange(last * segment, (last + 1) * segment)
            running = total + np.cumsum(mean)
            enough = np.flatnonzero((at < longest) & (at >= wide * (2 * running - 1)))
            if len(enough):
                done, tau = True, float(2 * running[enough[0]] - 1)
                break
            total = float(running[min(segment, longest - last * segment) - 1])
        if not done and longest <= (last + 1) * segment:
            done, tau = True, 2 * total - 1
        if done and not np.isfinite(tau):
            tau = None
        return pd.DataFrame([[*key, longest, walkers, total, tau, done]], columns=[*group, "longest", "walkers", "total", "tau", "done"])

    still, found, first, last = known.where("fine").select(*group, "longest", "walkers", F.lit(0.0).alias("total")), [], 0, 1
    while True:
        sums = _lag_sums(alike(segments, still.select(*group), group), chain, segment, first, last).drop("_n")
        after = written(alike(sums, still, group).groupBy(*group).applyInPandas(scan, schema))
        found.append(after.where("done").select(*group, "tau"))
        still = after.where("NOT done").drop("tau", "done")
        if still.isEmpty():
            break
        first, last = last, min(2 * last, last + ROUND)
    taus = known.where("NOT fine").select(*group, F.lit(None).cast("double").alias("tau"))
    for x in found:
        taus = taus.unionByName(x)
    times = alike(taus, known.select(*group, F.col("longest").alias("retained_steps")), group)
    every = draws.select("ensemble").distinct().select("ensemble", F.explode(F.array(*map(F.lit, parameters))).alias("parameter"))
    return every.join(times, group, "left").select(
        *group, "tau", F.col("tau").isNotNull().alias("available"), F.coalesce("retained_steps", F.lit(0)).cast("long").alias("retained_steps"),
        F.when(F.col("retained_steps").isNull(), "no_finite_draws").when(F.col("tau").isNull(), "nonfinite_autocorrelation_time").alias("error"),
    )


def worst_time(times: DataFrame, multiple: float = 50.0) -> DataFrame:
    """(worst_tau, all_available, unavailable_count, long_enough) of autocorrelation_times: one row; a run is long enough
    if all times are known and every ensemble keeps more than `multiple` times the worst."""
    one = times.agg(F.max(F.when(F.col("available"), F.col("tau"))).alias("worst_tau"), F.coalesce(F.every("available"), F.lit(False)).alias("all_available"), F.count_if(~F.col("available")).alias("unavailable_count"), F.min("retained_steps").alias("_least"))
    return one.select("worst_tau", "all_available", "unavailable_count", F.coalesce(F.col("all_available") & (F.col("_least") > multiple * F.col("worst_tau")), F.lit(False)).alias("long_enough"))
