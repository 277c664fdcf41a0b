"""Queries over the given tables, each with the SQL that gives the same rows.

Light curves come from the events table. Results are rounded on both sides, for sums over other partitions differ in
the last place.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import astuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ephemeris import Ephemeris, center, finite, in_window, phase, predicted_events
from ..functions.stellar import PHYSICAL, duration_informed_a, inclination_degrees, plain_name, q_to_u, run_id, u_to_q, violations
from ..operators import cleaning, diagnostics, events, history, metadata, posterior, recovery, residuals, rules, sampling, search, snapshots, transit, windows
from ..operators.series import pieces
from ..sources import fits
from ..sources.light_curves import from_events, read_fits_light_curves, write_fits_light_curves
from ..sources.shared import shared_folder, written
from ..sources.versions import VersionedTable
from ..streaming import phase_bins

E = Ephemeris(2.5, 0.4, 0.4)
SIGMA, HALF, FRACTION = 3.0, 0.6, 0.7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def finite_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark, sf_dir).where(finite("time", "flux"))


# ---------------------------------------------------------------------------------------------------- SQL fragments
CAD = """cad AS (SELECT event_id AS cadence_id, user_id // 10 AS target_id, event_type AS product_id,
  CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 86400000000::DOUBLE AS time,
  CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS flux, 0.5::DOUBLE + (event_id % 3) * 0.25::DOUBLE AS flux_err FROM events)"""
FIN = CAD + ", fin AS (SELECT * FROM cad WHERE isfinite(time) AND isfinite(flux))"
P, T0, D = (f"{x!r}::DOUBLE" for x in astuple(E))


def sql_phase(t: str = "time") -> str:
    r = f"fmod({t} - {T0} + {P} / 2, {P})"
    return f"(CASE WHEN {r} < 0 THEN fmod({r} + {P}, {P}) ELSE {r} END - {P} / 2)"


def sql_events(table: str = "fin") -> str:
    return f"""ev AS (SELECT target_id, n AS cycle, n - first AS event_number, {T0} + n * {P} AS center FROM
  (SELECT target_id, first, unnest(generate_series(first, last)) AS n FROM
    (SELECT target_id, CAST(ceil((min(time) - {T0}) / {P}) AS BIGINT) AS first, CAST(floor((max(time) - {T0}) / {P}) AS BIGINT) AS last FROM {table} GROUP BY target_id)
   WHERE last >= first))"""


def sql_windows(half: float, table: str = "fin", kind: str = "LEFT") -> str:
    return sql_events(table) + f""", win AS (SELECT ev.target_id, ev.cycle, ev.event_number, ev.center, c.cadence_id, c.product_id, c.time, c.flux, c.flux_err, c.time - ev.center AS "offset"
  FROM ev {kind} JOIN {table} c ON c.target_id = ev.target_id AND abs(c.time - ev.center) <= {half!r}::DOUBLE)"""


def sql_rounded(columns: str, source: str, digits: int = 6) -> str:
    """`name` is taken as it is, `~name` is rounded."""
    parts = [f"round({c[1:]}, {digits}) AS {c[1:]}" if c[0] == "~" else c for c in columns.split()]
    return f"SELECT {', '.join(parts)} FROM {source}"


def sql_clip(mode: str, sigma: float = SIGMA, scale: float = 1.25) -> str:
    usable = "isfinite(time) AND isfinite(flux)"
    if mode == "transit_protected_symmetric":
        usable += f" AND NOT (abs({sql_phase()}) <= {scale * E.duration / 2!r}::DOUBLE)"
    out = [CAD, f"k0 AS (SELECT *, isfinite(time) AND isfinite(flux) AS is_finite, ({usable}) AS inn, ({usable}) AS kept FROM cad)"]
    for k in range(cleaning.ROUNDS if mode != "none" else 0):
        bad = f"flux > m + {sigma!r} * s" + ("" if mode == "positive_only" else f" OR flux < m - {sigma!r} * s")
        out.append(
            f"m{k} AS (SELECT target_id, median(flux) AS m, stddev_pop(flux) AS s FROM k{k} WHERE kept GROUP BY target_id), "
            f"k{k + 1} AS (SELECT k.* EXCLUDE (kept), kept AND NOT coalesce({bad}, false) AS kept FROM k{k} k LEFT JOIN m{k} USING (target_id))"
        )
    last = f"k{cleaning.ROUNDS if mode != 'none' else 0}"
    out.append(f"clipped AS (SELECT * EXCLUDE (inn, kept), inn AND NOT kept AS is_clipped, is_finite AND NOT (inn AND NOT kept) AS is_retained FROM {last})")
    return ", ".join(out)


# ------------------------------------------------------------------------------------------------------------ files
def _fits_files(spark: SparkSession, sf_dir: str) -> str:
    """Finite cadences as FITS files in the shared folder; the quality of every eleventh is 4, of every thirteenth 1."""
    folder = shared_folder(spark)
    quality = F.when(F.col("cadence_id") % 11 == 0, 4).otherwise(0) + F.when(F.col("cadence_id") % 13 == 0, 1).otherwise(0)
    write_fits_light_curves(finite_curves(spark, sf_dir).withColumn("quality", quality), folder)
    return folder


@query(f"WITH {FIN} SELECT CAST(target_id AS VARCHAR) AS target_id, product_id, cadence_id, round(time, 6) AS time, round(flux, 6) AS flux, flux_err FROM fin WHERE cadence_id % 11 <> 0")
def fits_light_curves(spark, sf_dir):
    """Light curves written as FITS tables and read back, without the cadences whose quality has bit 4."""
    return rounded(read_fits_light_curves(spark, _fits_files(spark, sf_dir), quality_mask=4))


@query(f"WITH {FIN} SELECT CAST(target_id AS VARCHAR) AS target_id, product_id, count(*) AS n_rows, 40::BIGINT AS row_bytes FROM fin GROUP BY ALL")
def fits_table_headers(spark, sf_dir):
    """Rows of each target and product as the headers of the tables tell them; no row is read."""
    cards = fits.fits_cards(spark, _fits_files(spark, sf_dir)).where("hdu > 0 AND key IN ('OBJECT', 'PRODUCT', 'NAXIS1', 'NAXIS2')")
    units = cards.groupBy("path", "hdu").pivot("key", ["OBJECT", "PRODUCT", "NAXIS1", "NAXIS2"]).agg(F.first("value"))
    return units.groupBy(F.col("OBJECT").alias("target_id"), F.col("PRODUCT").alias("product_id")).agg(F.sum(F.col("NAXIS2").cast("long")).alias("n_rows"), F.max(F.col("NAXIS1").cast("long")).alias("row_bytes"))


# ------------------------------------------------------------------------------------------- summaries and cleaning
_SUMMARY = "count(*) AS n_cadences, min(time) AS time_min, max(time) AS time_max, median(flux) AS flux_median, stddev_pop(flux) AS flux_std"


@query(f"WITH {FIN}, s AS (SELECT target_id, {_SUMMARY} FROM fin GROUP BY target_id) {sql_rounded('target_id n_cadences ~time_min ~time_max ~flux_median ~flux_std', 's')}")
def lc_summary(spark, sf_dir):
    return rounded(recovery.summarize(finite_curves(spark, sf_dir), "target_id"))


@query(f"WITH {FIN}, s AS (SELECT target_id, product_id, {_SUMMARY} FROM fin GROUP BY ALL) {sql_rounded('target_id product_id n_cadences ~time_min ~time_max ~flux_median ~flux_std', 's')}")
def lc_summary_by_product(spark, sf_dir):
    return rounded(recovery.summarize(finite_curves(spark, sf_dir), "target_id", "product_id"))


@query(f"WITH {CAD} SELECT target_id, count(*) AS n, count(*) FILTER (isfinite(time) AND isfinite(flux)) AS n_finite FROM cad GROUP BY target_id")
def finite_filter_counts(spark, sf_dir):
    return from_events(spark, sf_dir).groupBy("target_id").agg(F.count("*").alias("n"), F.count_if(finite("time", "flux")).alias("n_finite"))


@query(f"WITH {FIN}, m AS (SELECT target_id, product_id, median(flux) AS flux_median FROM fin GROUP BY ALL), j AS (SELECT cadence_id, flux / nullif(flux_median, 0) AS flux_norm FROM fin JOIN m USING (target_id, product_id)) {sql_rounded('cadence_id ~flux_norm', 'j')}")
def normalize_per_product(spark, sf_dir):
    return rounded(cleaning.normalize(finite_curves(spark, sf_dir), "target_id", "product_id").select("cadence_id", "flux_norm"))


@query(f"WITH {FIN}, m AS (SELECT target_id, median(flux) AS flux_median FROM fin GROUP BY ALL), j AS (SELECT cadence_id, flux / nullif(flux_median, 0) AS flux_norm FROM fin JOIN m USING (target_id)) {sql_rounded('cadence_id ~flux_norm', 'j')}")
def normalize_global(spark, sf_dir):
    return rounded(cleaning.normalize(finite_curves(spark, sf_dir), "target_id").select("cadence_id", "flux_norm"))


@query(f"""WITH {CAD}, c AS (SELECT * EXCLUDE (flux_err), CASE WHEN cadence_id % 5 = 0 THEN CAST('nan' AS DOUBLE) WHEN cadence_id % 7 = 0 THEN -1.0 ELSE flux_err END AS flux_err FROM cad),
 f AS (SELECT target_id, product_id, median(flux_err) FILTER (isfinite(flux_err) AND flux_err > 0) AS fill FROM c GROUP BY ALL),
 r AS (SELECT c.target_id, c.product_id, cadence_id, flux, CASE WHEN isfinite(flux_err) AND flux_err > 0 THEN flux_err ELSE coalesce(fill, 1) END AS err FROM c JOIN f USING (target_id, product_id) WHERE isfinite(time) AND isfinite(flux)),
 m AS (SELECT target_id, product_id, CASE WHEN median(flux) = 0 THEN 1 ELSE median(flux) END AS m FROM r GROUP BY ALL), n AS (SELECT r.target_id, cadence_id, flux / m AS flux, err / abs(m) AS err FROM r JOIN m USING (target_id, product_id)),
 t AS (SELECT target_id, CASE WHEN median(flux) = 0 THEN 1 ELSE median(flux) END AS m FROM n GROUP BY ALL), x AS (SELECT cadence_id, flux / m AS flux, err / abs(m) AS flux_err FROM n JOIN t USING (target_id)) {sql_rounded('cadence_id ~flux ~flux_err', 'x')}""")
def observation_building(spark, sf_dir):
    """Errors of every fifth cadence are missing and those of every seventh negative first, so that there is something to repair."""
    broken = F.when(F.col("cadence_id") % 5 == 0, float("nan")).when(F.col("cadence_id") % 7 == 0, -1.0).otherwise(F.col("flux_err"))
    return rounded(cleaning.observations(from_events(spark, sf_dir).withColumn("flux_err", broken)).select("cadence_id", "flux", "flux_err"))


def _clip_query(mode: str):
    def f(spark, sf_dir):
        return cleaning.clip(from_events(spark, sf_dir), mode, SIGMA, E).select("cadence_id", "is_finite", "is_clipped", "is_retained")

    f.__name__ = f"clip_{mode}"
    query(f"WITH {sql_clip(mode)} SELECT cadence_id, is_finite, is_clipped, is_retained FROM clipped")(f)


for _mode in cleaning.MODES:
    _clip_query(_mode)


def _sql_removal(inside: str) -> str:
    gone = {"retained": "is_retained", "nonfinite": "NOT is_finite", "clipped": "is_clipped", "removed": "NOT is_retained"}
    return ", ".join(f"count(*) FILTER ({c} AND {'' if w == 'inside' else 'NOT '}({inside})) AS {n}_{w}" for n, c in gone.items() for w in ("inside", "outside"))


_IN = f"abs({sql_phase()}) <= {1.25 * E.duration / 2!r}::DOUBLE"


@query(f"WITH {sql_clip('symmetric')} SELECT target_id, {_sql_removal(_IN)} FROM clipped GROUP BY target_id")
def removal_counts(spark, sf_dir):
    return cleaning.removal_counts(cleaning.clip(from_events(spark, sf_dir), "symmetric", SIGMA), E)


@query(f"""WITH {sql_clip('symmetric')}, b AS (SELECT target_id, CAST(least(floor(({sql_phase()} / {P} + 0.5) * 20), 19) AS INTEGER) AS phase_bin, count(*) AS cadences,
  count(*) FILTER (NOT is_finite) AS nonfinite, count(*) FILTER (is_clipped) AS clipped FROM clipped WHERE isfinite(time) GROUP BY ALL),
 a AS (SELECT target_id, CAST(unnest(generate_series(0, 19)) AS INTEGER) AS phase_bin FROM (SELECT DISTINCT target_id FROM clipped))
 SELECT target_id, phase_bin, coalesce(cadences, 0) AS cadences, coalesce(nonfinite, 0) AS nonfinite, coalesce(clipped, 0) AS clipped, coalesce(nonfinite + clipped, 0) AS removed,
  round(CASE WHEN cadences > 0 THEN (nonfinite + clipped)::DOUBLE / cadences ELSE 0 END, 6) AS removed_fraction FROM a LEFT JOIN b USING (target_id, phase_bin)""")
def removal_phase_bins(spark, sf_dir):
    return rounded(cleaning.removal_by_phase(cleaning.clip(from_events(spark, sf_dir), "symmetric", SIGMA), E))


@query(f"WITH {FIN} SELECT cadence_id, round({sql_phase()}, 6) AS phase, abs({sql_phase()}) <= {E.duration / 2!r}::DOUBLE AS inside FROM fin")
def phase_fold(spark, sf_dir):
    return finite_curves(spark, sf_dir).select("cadence_id", F.round(phase(F.col("time"), E), 6).alias("phase"), in_window(F.col("time"), E).alias("inside"))


@query(f"""WITH {FIN}, p AS (SELECT *, {sql_phase()} AS phase FROM fin), l AS (SELECT *, min(phase) OVER w AS low, max(phase) OVER w AS high FROM p WINDOW w AS (PARTITION BY target_id)),
 b AS (SELECT target_id, CAST(floor((phase - low) / (high - low) * 50) AS INTEGER) AS bin, phase, flux FROM l WHERE high > low),
 g AS (SELECT target_id, bin, avg(phase) AS phase_mean, avg(flux) AS flux_mean, count(*) AS n FROM b WHERE bin < 50 GROUP BY ALL) {sql_rounded('target_id bin ~phase_mean ~flux_mean n', 'g')}""")
def phase_binned_curve(spark, sf_dir):
    return rounded(recovery.binned_curve(finite_curves(spark, sf_dir), E, 50))


@query(f"""WITH {FIN}, b AS (SELECT target_id, CAST(least(floor(({sql_phase()} / {P} + 0.5) * 24), 23) AS INTEGER) AS bin, {sql_phase()} AS p, flux FROM fin),
 g AS (SELECT target_id, bin, avg(p) AS phase_mean, avg(flux) AS flux_mean, count(*) AS n FROM b GROUP BY ALL) {sql_rounded('target_id bin ~phase_mean ~flux_mean n', 'g')}""")
def streamed_phase_bins(spark, sf_dir):
    """The events table read as a stream, its sums by phase bin kept batch by batch."""
    sink = phase_bins.PhaseBinSink(spark, shared_folder(spark), E, 24)
    phase_bins.run(phase_bins.event_stream(spark, sf_dir), sink).awaitTermination()
    return rounded(sink.curve())


# --------------------------------------------------------------------------------------------------- known recovery
def _sql_depths(source: str, value: str, inside: str, outside: str) -> str:
    return f"""d AS (SELECT target_id, count(*) FILTER ({inside}) AS n_in, count(*) FILTER ({outside}) AS n_out, median({value}) FILTER ({inside}) AS flux_in,
  median({value}) FILTER ({outside}) AS flux_out, stddev_pop({value}) FILTER ({outside}) AS scatter_out FROM {source} GROUP BY target_id HAVING n_in > 0 AND n_out > 1),
 d2 AS (SELECT *, flux_out - flux_in AS depth, CASE WHEN scatter_out > 0 THEN (flux_out - flux_in) / (scatter_out * sqrt(1 / n_in::DOUBLE + 1 / n_out::DOUBLE)) WHEN flux_out - flux_in <= 0 THEN 0 END AS snr, scatter_out = 0 AND flux_out - flux_in > 0 AS snr_unbounded FROM d)"""


_DEPTH = "target_id n_in n_out ~flux_in ~flux_out ~scatter_out ~depth ~snr snr_unbounded"


@query(f"WITH {FIN}, {_sql_depths('fin', 'flux', f'abs({sql_phase()}) <= {E.duration / 2!r}::DOUBLE', f'NOT abs({sql_phase()}) <= {E.duration / 2!r}::DOUBLE')} {sql_rounded(_DEPTH, 'd2')}")
def known_recovery(spark, sf_dir):
    return rounded(recovery.known_signal(finite_curves(spark, sf_dir), E))


_IN_W, _WING = f'abs("offset") <= {1.25 * E.duration / 2!r}::DOUBLE', f'abs("offset") > {2.0 * E.duration / 2!r}::DOUBLE'
_STACK = f"""st AS (SELECT target_id, cycle, count(*) AS n, count(*) FILTER ({_IN_W}) AS ni, count(*) FILTER ({_WING}) AS nw, median(flux) FILTER ({_WING}) AS wing FROM win GROUP BY ALL),
 used AS (SELECT win.*, flux / wing AS relative FROM win JOIN st USING (target_id, cycle) WHERE n >= 10 AND ni >= 1 AND nw >= 4 AND wing <> 0)"""


@query(f"WITH {FIN}, {sql_windows(HALF, kind='INNER')}, {_STACK}, {_sql_depths('used', 'relative', _IN_W, _WING)}, nw AS (SELECT target_id, count(DISTINCT cycle) AS n_windows FROM used GROUP BY ALL) {sql_rounded(_DEPTH + ' n_windows', 'd2 JOIN nw USING (target_id)')}")
def windowed_recovery(spark, sf_dir):
    return rounded(recovery.windowed_signal(finite_curves(spark, sf_dir), E, HALF))


def _sql_compared(mode: str) -> str:
    inside = f"abs({sql_phase()}) <= {E.duration / 2!r}::DOUBLE"
    return f"""(WITH {sql_clip(mode)}, md AS (SELECT target_id, median(flux) AS fm FROM clipped WHERE is_retained GROUP BY target_id),
 c AS (SELECT clipped.*, flux / nullif(fm, 0) AS fn FROM clipped JOIN md USING (target_id) WHERE is_retained), {_sql_depths('c', 'fn', inside, f'NOT {inside}')} SELECT '{mode}' AS mode, * FROM d2)"""


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT * FROM {_sql_compared(m)}" for m in cleaning.MODES) + f") {sql_rounded('mode ' + _DEPTH, 'u')}")
def preprocessing_comparison(spark, sf_dir):
    curves, out = from_events(spark, sf_dir), None
    for mode in cleaning.MODES:
        clean = cleaning.preprocess(curves, mode, SIGMA, E).where("is_retained").select("target_id", "time", F.col("flux_norm").alias("flux"))
        one = recovery.known_signal(clean, E).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


# ------------------------------------------------------------------------------------------- split, events, holdout
_SPLIT = f"sp AS (SELECT *, min(time) OVER w + {FRACTION!r} * (max(time) OVER w - min(time) OVER w) AS split_time FROM fin WINDOW w AS (PARTITION BY target_id)), tr AS (SELECT *, time <= split_time AS is_training FROM sp)"


@query(f"""WITH {FIN}, {_SPLIT}, s AS (SELECT target_id, first(split_time) AS split_time, min(time) FILTER (is_training) AS training_min, max(time) FILTER (is_training) AS training_max,
 min(time) FILTER (NOT is_training) AS holdout_min, max(time) FILTER (NOT is_training) AS holdout_max, count(*) FILTER (is_training) AS training_count, count(*) FILTER (NOT is_training) AS holdout_count,
 min(time) FILTER (NOT is_training) - max(time) FILTER (is_training) AS gap_across_split FROM tr GROUP BY target_id)
 {sql_rounded('target_id ~split_time ~training_min ~training_max ~holdout_min ~holdout_max training_count holdout_count ~gap_across_split', 's')}""")
def chrono_split(spark, sf_dir):
    return rounded(cleaning.split_summary(cleaning.chronological_split(finite_curves(spark, sf_dir), FRACTION)))


@query(f"WITH {FIN}, {sql_events()} {sql_rounded('target_id cycle event_number ~center', 'ev')}")
def predicted_centers(spark, sf_dir):
    return rounded(predicted_events(finite_curves(spark, sf_dir), E))


_OUT = events.OUTER * E.duration
_INSIDE, _BASE = f'coalesce(abs("offset") <= {E.duration / 2!r}::DOUBLE, false)', f'coalesce(abs("offset") > {events.INNER * E.duration!r}::DOUBLE AND abs("offset") <= {_OUT!r}::DOUBLE, false)'
_EVENTS = f"""{{windows}}, stp AS (SELECT *, time - lag(time) OVER (PARTITION BY target_id, cycle ORDER BY time, cadence_id) AS step FROM win),
 e0 AS (SELECT target_id, cycle, event_number, center, count(*) FILTER ({_INSIDE}) AS n_in, count(*) FILTER ({_BASE}) AS n_base, median(flux) FILTER ({_INSIDE}) AS flux_in,
  median(flux) FILTER ({_BASE}) AS flux_base, max(step) AS nearby_gap FROM stp GROUP BY ALL),
 evd AS (SELECT *, n_in >= {events.MIN_IN} AND n_base >= {events.MIN_BASE} AS usable, CASE WHEN n_in >= {events.MIN_IN} AND n_base >= {events.MIN_BASE} THEN flux_base - flux_in END AS depth,
  CASE WHEN event_number % 2 = 1 THEN 'odd' ELSE 'even' END AS parity FROM e0)"""


@query(f"WITH {FIN}, {_EVENTS.replace('{windows}', sql_windows(_OUT))} {sql_rounded('target_id cycle event_number ~center n_in n_base ~flux_in ~flux_base ~nearby_gap usable ~depth parity', 'evd')}")
def event_diagnostics(spark, sf_dir):
    return rounded(events.event_diagnostics(finite_curves(spark, sf_dir), E))


@query(f"""WITH {FIN}, {_EVENTS.replace('{windows}', sql_windows(_OUT))}, o AS (SELECT target_id, count(*) AS n_events, count(*) FILTER (usable AND parity = 'odd') AS n_odd, count(*) FILTER (usable AND parity = 'even') AS n_even,
  median(depth) FILTER (parity = 'odd') AS odd_depth, median(depth) FILTER (parity = 'even') AS even_depth, CASE WHEN count(depth) > 1 THEN stddev_pop(depth) END AS scatter FROM evd GROUP BY target_id),
 o2 AS (SELECT *, abs(odd_depth - even_depth) AS difference, CASE WHEN odd_depth IS NOT NULL AND even_depth IS NOT NULL AND least(abs(odd_depth), abs(even_depth)) > greatest(1e-12, 1e-3 * abs(coalesce(scatter, 0)))
  THEN greatest(abs(odd_depth), abs(even_depth)) / least(abs(odd_depth), abs(even_depth)) END AS ratio FROM o),
 o3 AS (SELECT *, CASE WHEN scatter > 0 AND ratio >= {events.RATIO} AND difference >= {events.MIN_SCATTER} * scatter THEN 'ratio_and_absolute_difference'
  WHEN scatter > 0 AND difference >= {events.SIGMA} * scatter THEN 'absolute_difference_only' ELSE 'none' END AS trigger FROM o2) {sql_rounded('target_id n_events n_odd n_even ~odd_depth ~even_depth ~scatter ~difference ~ratio trigger', 'o3')}""")
def odd_even(spark, sf_dir):
    return rounded(events.odd_even(events.event_diagnostics(finite_curves(spark, sf_dir), E)))


@query(f"""WITH {FIN}, {_SPLIT}, hd AS (SELECT * FROM tr WHERE NOT is_training), {sql_windows(_OUT, 'hd')},
 f AS (SELECT *, {_INSIDE} AS i, {_BASE} AS b FROM win), u AS (SELECT *, count(*) FILTER (i) OVER w >= {events.MIN_IN} AND count(*) FILTER (b) OVER w >= {events.MIN_BASE} AS usable FROM f WINDOW w AS (PARTITION BY target_id, cycle)),
 h AS (SELECT target_id, count(DISTINCT cycle) AS n_events, count(DISTINCT cycle) FILTER (usable) AS n_usable, median(flux) FILTER (usable AND i) AS flux_in, median(flux) FILTER (usable AND b) AS flux_base,
  stddev_pop(flux) FILTER (usable AND b) AS scatter, count(flux) FILTER (usable AND i) AS n_in, count(flux) FILTER (usable AND b) AS n_base FROM u GROUP BY target_id),
 hs AS (SELECT target_id, 0.002::DOUBLE * (max(time) - min(time)) / {P} AS drift FROM hd GROUP BY target_id),
 h2 AS (SELECT *, drift / {D} AS drift_of_duration, flux_base - flux_in AS depth, CASE WHEN n_usable = 0 THEN NULL WHEN scatter > 0 THEN (flux_base - flux_in) / (scatter * sqrt(1 / n_in::DOUBLE + 1 / n_base::DOUBLE)) WHEN flux_base - flux_in <= 0 THEN 0 END AS snr FROM h LEFT JOIN hs USING (target_id))
 {sql_rounded('target_id n_events n_usable ~flux_in ~flux_base ~scatter n_in n_base ~depth ~snr ~drift ~drift_of_duration', 'h2')}""")
def holdout(spark, sf_dir):
    kept_back = cleaning.chronological_split(finite_curves(spark, sf_dir), FRACTION).where("not is_training")
    return rounded(events.holdout(kept_back, E, 0.002))


# ------------------------------------------------------------------------------------------------ windows and fits
_H = windows.half_width(E)


def _sql_reasons() -> str:
    tests = [f"n_in < {windows.MIN_IN}", f"n_left < {windows.MIN_SIDE}", f"n_right < {windows.MIN_SIDE}", f"n_pre < {windows.MIN_PRE}", f"n_post < {windows.MIN_POST}", f"coalesce(in_transit_gap > {E.duration / 2!r}::DOUBLE, false)"]
    return "concat_ws(';', " + ", ".join(f"CASE WHEN {t} THEN '{r}' END" for t, r in zip(tests, windows.REASONS)) + ")"


_AUDIT = f"""{sql_windows(_H)}, wi AS (SELECT *, {_INSIDE} AS is_in FROM win), ws AS (SELECT *, time - lag(time) OVER w AS step,
  CASE WHEN is_in THEN time - max(CASE WHEN is_in THEN time END) OVER (PARTITION BY target_id, cycle ORDER BY time, cadence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS in_step
  FROM wi WINDOW w AS (PARTITION BY target_id, cycle ORDER BY time, cadence_id)),
 pr AS (SELECT target_id, cycle, string_agg(product_id, ';' ORDER BY n DESC, seen, product_id) AS source_products FROM (SELECT target_id, cycle, product_id, count(*) AS n, min(time) AS seen FROM win WHERE product_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
 a0 AS (SELECT target_id, cycle, event_number, center, count(time) AS n, count(*) FILTER (is_in) AS n_in, count(*) FILTER (is_in AND "offset" < 0) AS n_left, count(*) FILTER (is_in AND "offset" >= 0) AS n_right,
  count(*) FILTER ("offset" <= {-windows.INNER * E.duration!r}::DOUBLE) AS n_pre, count(*) FILTER ("offset" >= {windows.INNER * E.duration!r}::DOUBLE) AS n_post, max(step) AS largest_gap, max(in_step) AS in_transit_gap FROM ws GROUP BY ALL),
 audit AS (SELECT a0.*, coalesce(source_products, '') AS source_products, {_sql_reasons()} AS exclusion_reasons, {_sql_reasons()} = '' AS included FROM a0 LEFT JOIN pr USING (target_id, cycle)),
 acc AS (SELECT win.* FROM win JOIN audit USING (target_id, cycle) WHERE included AND win.cadence_id IS NOT NULL)"""


@query(f"WITH {FIN}, {_AUDIT} {sql_rounded('target_id cycle event_number ~center n n_in n_left n_right n_pre n_post ~largest_gap ~in_transit_gap source_products exclusion_reasons included', 'audit')}")
def window_audit(spark, sf_dir):
    return rounded(windows.window_audit(finite_curves(spark, sf_dir), E))


@query(f"WITH {FIN}, {_AUDIT} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(exclusion_reasons, ';')) AS reason FROM audit WHERE NOT included) GROUP BY reason")
def exclusion_reasons(spark, sf_dir):
    return windows.exclusion_counts(windows.window_audit(finite_curves(spark, sf_dir), E))


@query(f"WITH {FIN}, {_AUDIT} {sql_rounded('target_id event_number cadence_id product_id ~time ~flux ~center', 'acc')}")
def accepted_cadences(spark, sf_dir):
    return rounded(windows.accepted_cadences(finite_curves(spark, sf_dir), E).select("target_id", "event_number", "cadence_id", "product_id", "time", "flux", "center"))


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted cadences with a box for a model: a tenth deep inside the dip."""
    return windows.accepted_cadences(finite_curves(spark, sf_dir), E).withColumn("model", F.when(F.abs("offset") <= E.duration / 2, 0.9).otherwise(1.0))


_MODEL = f'accm AS (SELECT *, CASE WHEN abs("offset") <= {E.duration / 2!r}::DOUBLE THEN 0.9::DOUBLE ELSE 1::DOUBLE END AS model FROM acc)'
_WLS = f"""{_MODEL}, sm AS (SELECT target_id, event_number, sum(w * model * model) AS a, sum(w * model * model * "offset") AS b, sum(w * model * model * "offset" * "offset") AS d, sum(w * model * flux) AS p, sum(w * model * "offset" * flux) AS q, count(*) AS n
  FROM (SELECT *, 1 / (flux_err * flux_err) AS w FROM accm) GROUP BY ALL),
 wls AS (SELECT target_id, event_number, n, (p * d - q * b) / (a * d - b * b) AS intercept, (q * a - p * b) / (a * d - b * b) AS slope FROM sm)"""


@query(f"WITH {FIN}, {_AUDIT}, {_WLS} {sql_rounded('target_id event_number n ~intercept ~slope', 'wls')}")
def baseline_wls(spark, sf_dir):
    return rounded(residuals.event_baselines(_accepted(spark, sf_dir), "model"))


def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = _accepted(spark, sf_dir)
    lines = residuals.event_baselines(accepted, "model").select("target_id", "event_number", "intercept", "slope")
    return accepted.join(lines, ["target_id", "event_number"]).withColumn("residual", F.col("flux") - F.col("model") * (F.col("intercept") + F.col("slope") * F.col("offset")))


_RES = f'{_AUDIT}, {_WLS}, res AS (SELECT accm.*, flux - model * (intercept + slope * "offset") AS residual FROM accm JOIN wls USING (target_id, event_number))'


def _sql_stats(by: str) -> str:
    return f"""rm AS (SELECT *, median(residual) OVER (PARTITION BY {by}) AS mm FROM res), rs AS (SELECT {by}, count(*) AS n, avg(residual) AS mean, stddev_samp(residual) AS std, 1.4826 * median(abs(residual - mm)) AS mad FROM rm GROUP BY ALL)"""


@query(f"WITH {FIN}, {_RES}, {_sql_stats('target_id, product_id')} {sql_rounded('target_id product_id n ~mean ~std ~mad', 'rs')}")
def residual_by_product(spark, sf_dir):
    return rounded(residuals.residual_stats(_residuals(spark, sf_dir), "target_id", "product_id"))


@query(f"WITH {FIN}, {_RES}, {_sql_stats('target_id')} {sql_rounded('target_id n ~mean ~std ~mad', 'rs')}")
def residual_summary(spark, sf_dir):
    return rounded(residuals.residual_stats(_residuals(spark, sf_dir), "target_id"))


@query(f"""WITH {FIN}, {_RES}, c AS (SELECT *, residual - avg(residual) OVER (PARTITION BY target_id) AS r, row_number() OVER (PARTITION BY target_id ORDER BY time, cadence_id) AS k FROM res),
 z AS (SELECT target_id, sum(r * r) AS z FROM c GROUP BY ALL), l AS (SELECT target_id, CAST(unnest(generate_series(1, 20)) AS INTEGER) AS lag, z FROM z),
 x AS (SELECT l.target_id, l.lag, sum(a.r * b.r) / nullif(any_value(l.z), 0) AS acf FROM l LEFT JOIN c a ON a.target_id = l.target_id LEFT JOIN c b ON b.target_id = a.target_id AND b.k = a.k - l.lag GROUP BY ALL)
 {sql_rounded('target_id lag ~acf', 'x')}""")
def acf(spark, sf_dir):
    return rounded(residuals.autocorrelation(_residuals(spark, sf_dir)))


@query(f"""WITH {FIN}, {_RES}, k AS (SELECT *, row_number() OVER (PARTITION BY target_id, event_number ORDER BY time, cadence_id) - 1 AS k FROM res), s AS (SELECT *, unnest([1, 2, 4, 8, 16, 32]) AS size FROM k),
 b AS (SELECT target_id, event_number, size, k // size AS block, avg(residual) AS m FROM s GROUP BY ALL HAVING count(*) = size),
 o AS (SELECT target_id, size, count(*) AS n_blocks, stddev_samp(m) AS rms FROM b GROUP BY ALL), t AS (SELECT target_id, stddev_samp(residual) AS base FROM res GROUP BY ALL),
 x AS (SELECT target_id, size, n_blocks, rms, base / sqrt(size) AS expected FROM o JOIN t USING (target_id)) {sql_rounded('target_id size n_blocks ~rms ~expected', 'x')}""")
def rms_binning(spark, sf_dir):
    return rounded(residuals.binned_scatter(_residuals(spark, sf_dir)))


@query(f"""WITH {FIN}, {_AUDIT}, {_MODEL}, x0 AS (SELECT *, max(abs("offset")) OVER (PARTITION BY target_id, event_number) AS sc FROM accm),
 x AS (SELECT target_id, event_number, model AS m, CASE WHEN sc > 0 THEN "offset" / sc ELSE 0 END AS x, flux - model AS r, flux_err * flux_err + 0.01 * 0.01 AS v FROM x0),
 s AS (SELECT target_id, event_number, sum(m * m / v) + 400 AS a, sum(m * m * x / v) AS b, sum(m * m * x * x / v) + 400 AS d, sum(m * r / v) AS p, sum(m * x * r / v) AS q, sum(r * r / v) AS rr, sum(ln(v)) AS logs, count(*) AS n FROM x GROUP BY ALL),
 y AS (SELECT target_id, event_number, n, -0.5 * (rr - (p * p * d - 2 * p * q * b + q * q * a) / (a * d - b * b) + logs + ln(0.05 * 0.05 * 0.05 * 0.05::DOUBLE) + ln(a * d - b * b) + n * ln(2 * pi())) AS log_likelihood FROM s)
 {sql_rounded('target_id event_number n ~log_likelihood', 'y', 4)}""")
def marginal_loglike_events(spark, sf_dir):
    return rounded(residuals.event_log_likelihood(_accepted(spark, sf_dir), "model", 0.01), 4)


@query(f"""WITH {FIN}, {_AUDIT}, {_MODEL}, x0 AS (SELECT *, max(abs("offset")) OVER (PARTITION BY target_id, event_number) AS sc FROM accm),
 x AS (SELECT target_id, event_number, model AS m, CASE WHEN sc > 0 THEN "offset" / sc ELSE 0 END AS x, flux - model AS r, flux_err * flux_err + 0.01 * 0.01 AS v FROM x0),
 s AS (SELECT target_id, event_number, sum(m * m / v) + 400 AS a, sum(m * m * x / v) AS b, sum(m * m * x * x / v) + 400 AS d, sum(m * r / v) AS p, sum(m * x * r / v) AS q FROM x GROUP BY ALL),
 y AS (SELECT target_id, event_number, 1 + (p * d - q * b) / (a * d - b * b) AS intercept_mean, (q * a - p * b) / (a * d - b * b) AS slope_mean, sqrt(d / (a * d - b * b)) AS intercept_sd,
  sqrt(a / (a * d - b * b)) AS slope_sd, -b / (a * d - b * b) AS covariance FROM s) {sql_rounded('target_id event_number ~intercept_mean ~slope_mean ~intercept_sd ~slope_sd ~covariance', 'y')}""")
def baseline_conditionals(spark, sf_dir):
    return rounded(residuals.event_conditionals(_accepted(spark, sf_dir), "model", 0.01))


@query(f"""WITH {FIN}, {_RES}, d AS (SELECT *, CASE WHEN abs("offset") <= {1.1 * E.duration / 2!r}::DOUBLE THEN 0.9::DOUBLE ELSE 1::DOUBLE END - model AS gap FROM res),
 y AS (SELECT target_id, max(abs(gap)) AS largest, sqrt(avg(gap * gap)) AS rms, stddev_samp(residual) AS scatter FROM d GROUP BY ALL), z AS (SELECT *, CASE WHEN scatter > 0 THEN largest / scatter END AS of_scatter FROM y)
 {sql_rounded('target_id ~largest ~rms ~scatter ~of_scatter', 'z')}""")
def model_convergence(spark, sf_dir):
    """A box a tenth wider stands for the model of finer samples."""
    rows = _residuals(spark, sf_dir).withColumn("finer", F.when(F.abs("offset") <= 1.1 * E.duration / 2, 0.9).otherwise(1.0))
    return rounded(residuals.model_difference(rows, "model", "finer", "residual"))


@query(f"WITH {FIN} SELECT target_id, product_id, CASE WHEN count(DISTINCT flux_err) = 1 THEN max(flux_err) END AS flux_err, CASE WHEN count(DISTINCT product_id) = 1 THEN max(product_id) END AS product FROM fin GROUP BY ALL")
def unique_or_null(spark, sf_dir):
    return finite_curves(spark, sf_dir).groupBy("target_id", "product_id").agg(recovery.unique_or_null("flux_err").alias("flux_err"), recovery.unique_or_null("product_id").alias("product"))


# -------------------------------------------------------------------------------------------------------- snapshots
@query(f"WITH {FIN}, {_AUDIT} SELECT target_id, count(*) AS n, count(*) FILTER (NOT (isfinite(time) AND isfinite(flux) AND isfinite(flux_err) AND isfinite(center))) AS not_finite, count(*) FILTER (flux_err <= 0) AS not_positive, count(*) FILTER (trim(product_id) = '') AS blank_product, count(*) FILTER (event_number < 0) AS negative_event FROM acc GROUP BY target_id")
def snapshot_violations(spark, sf_dir):
    return snapshots.violations(windows.accepted_cadences(finite_curves(spark, sf_dir), E))


@query(f"WITH {FIN}, {_AUDIT}, two AS (SELECT * FROM acc UNION ALL SELECT * FROM acc WHERE cadence_id % 50 = 0), g AS (SELECT target_id, event_number, product_id, time, count(*) AS n FROM two GROUP BY ALL HAVING count(*) > 1) {sql_rounded('target_id event_number product_id ~time n', 'g')}")
def duplicate_keys(spark, sf_dir):
    """Cadences of every fiftieth id are doubled first, so that there is something to find."""
    accepted = windows.accepted_cadences(finite_curves(spark, sf_dir), E)
    return rounded(snapshots.duplicate_keys(accepted.unionByName(accepted.where("cadence_id % 50 = 0"))))


@query(f"""WITH {FIN}, {_AUDIT}, g AS (SELECT target_id, event_number, min(center) AS low, max(center) AS high FROM acc GROUP BY ALL)
 SELECT g.target_id, g.event_number, high - low <= 1e-9 AS constant, abs(low - ev.center) <= 1e-9 AS predicted, abs(low - ({T0} + ev.cycle * {P})) <= 1e-8 AS ephemeris FROM g JOIN ev USING (target_id, event_number)""")
def center_check(spark, sf_dir):
    curves = finite_curves(spark, sf_dir)
    return snapshots.center_checks(windows.accepted_cadences(curves, E), predicted_events(curves, E), E)


@query(f"WITH {FIN}, {_AUDIT}, u AS (SELECT product_id, count(*) AS n_accepted FROM acc GROUP BY ALL), i AS (SELECT product_id, count(*) AS n_input FROM fin GROUP BY ALL) SELECT product_id, n_accepted, n_input, coalesce(n_accepted, 0) <= coalesce(n_input, -1) AS consistent FROM u FULL JOIN i USING (product_id)")
def product_check(spark, sf_dir):
    curves = finite_curves(spark, sf_dir)
    return snapshots.product_checks(windows.accepted_cadences(curves, E), curves.groupBy("product_id").agg(F.count("*").alias("n_input")))


@query(f"""WITH {FIN}, {_AUDIT}, e AS (SELECT target_id, event_number, center, min(time) AS first, max(time) AS last FROM acc GROUP BY ALL), c AS (SELECT CAST(a AS INTEGER) AS period_side, CAST(b AS INTEGER) AS epoch_side FROM (VALUES (-1), (1)) x(a), (VALUES (-1), (1)) y(b)),
 m AS (SELECT *, epoch_side * 0.05::DOUBLE + round_even((center - {T0}) / {P}, 0) * period_side * 0.01::DOUBLE AS moved FROM e, c)
 SELECT target_id, period_side, epoch_side, count(*) AS n_events, round(max(abs(moved)), 6) AS largest_move, count(*) FILTER (center + moved >= first AND center + moved <= last) AS n_supported FROM m GROUP BY ALL""")
def timing_support_corners(spark, sf_dir):
    return rounded(snapshots.timing_corners(windows.accepted_cadences(finite_curves(spark, sf_dir), E), E, 0.01, 0.05))


@query(f"""WITH {FIN}, {_AUDIT}, m AS (SELECT target_id, CAST(round_even((median(time) - {T0}) / {P}, 0) AS BIGINT) AS mid_cycle FROM acc GROUP BY ALL),
 v AS (SELECT target_id, cycle, median(center) AS center, min(time) AS first, max(time) AS last FROM acc GROUP BY ALL), r AS (SELECT *, least(center - first, last - center) - 0.25::DOUBLE * {D} AS room, abs(cycle - mid_cycle) AS away FROM v JOIN m USING (target_id)),
 g AS (SELECT target_id, mid_cycle, count(*) AS n_events, count(*) FILTER (room <= 0) AS n_beyond, min(CASE WHEN away > 0 THEN room / away END) AS least_ FROM r GROUP BY ALL),
 x AS (SELECT target_id, mid_cycle, {T0} + mid_cycle * {P} AS mid_epoch, 0.25::DOUBLE * {D} AS epoch_half_width, CASE WHEN n_beyond = 0 AND least_ IS NOT NULL THEN least(greatest(0.02 * {P}, {D}), 0.95 * least_) END AS period_half_width, n_events, n_beyond, n_beyond = 0 AND least_ IS NOT NULL AS supported FROM g)
 {sql_rounded('target_id mid_cycle ~mid_epoch ~epoch_half_width ~period_half_width n_events n_beyond supported', 'x')}""")
def timing_support(spark, sf_dir):
    return rounded(snapshots.timing_support(windows.accepted_cadences(finite_curves(spark, sf_dir), E), E, 0.25))


_SPOILT = """bad AS (SELECT target_id, event_number, cadence_id, time, flux, CASE WHEN cadence_id % 40 = 0 THEN 0 WHEN cadence_id % 41 = 0 THEN CAST('nan' AS DOUBLE) ELSE flux_err END AS flux_err, CASE WHEN cadence_id % 60 = 0 THEN ' ' ELSE product_id END AS product_id FROM acc),
 twice AS (SELECT * FROM bad UNION ALL SELECT * FROM bad WHERE cadence_id % 50 = 0), ia AS (SELECT DISTINCT concat(target_id, ':', event_number) AS k FROM twice), ib AS (SELECT DISTINCT concat(target_id, ':', event_number) AS k FROM audit WHERE (included OR event_number % 7 = 1) AND event_number % 5 <> 0)"""
_SPOILT_RULES = {
    "finite_flux": "NOT isfinite(flux)", "finite_flux_err": "NOT isfinite(flux_err)", "positive_flux_err": "NOT (flux_err > 0) OR isnan(flux_err)", "named_product_id": "trim(product_id) = ''",
}


@query(f"WITH {FIN}, {_AUDIT}, {_SPOILT} " + " UNION ALL ".join(f"SELECT 'accepted' AS \"table\", '{n}' AS rule, count(*) AS n_rows, count(*) FILTER ({c}) AS n_failed FROM twice" for n, c in _SPOILT_RULES.items())
       + " UNION ALL SELECT 'accepted', 'unique_cadence_id', NULL, count(*) FROM (SELECT cadence_id FROM twice GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'accepted', 'events_are_those_included', NULL, (SELECT count(*) FROM ia ANTI JOIN ib USING (k)) + (SELECT count(*) FROM ib ANTI JOIN ia USING (k))"
       + " UNION ALL SELECT 'accepted', 'one_center_an_event', NULL, 0")
def rule_report(spark, sf_dir):
    """Rules on accepted cadences of which some are spoilt: errors and products are missing, every fiftieth is there twice, and the audit has other events."""
    curves = finite_curves(spark, sf_dir)
    key = F.concat(F.col("target_id").cast("string"), F.lit(":"), F.col("event_number").cast("string"))
    errors = F.when(F.col("cadence_id") % 40 == 0, 0.0).when(F.col("cadence_id") % 41 == 0, float("nan")).otherwise(F.col("flux_err"))
    bad = windows.accepted_cadences(curves, E).withColumns({"flux_err": errors, "product_id": F.when(F.col("cadence_id") % 60 == 0, " ").otherwise(F.col("product_id")), "event": key})
    audit = windows.window_audit(curves, E).withColumn("event", key)
    made = [
        rules.Row("accepted", "finite_flux", rules.finite("flux"), ("flux",)), rules.Row("accepted", "finite_flux_err", rules.finite("flux_err"), ("flux_err",)), rules.Row("accepted", "positive_flux_err", "flux_err > 0 AND NOT isnan(flux_err)", ("flux_err",)),
        rules.Row("accepted", "named_product_id", "trim(product_id) <> ''", ("product_id",)), rules.Unique("accepted", ("cadence_id",)), rules.SameSet("accepted", "event", "audit", "event", "events_are_those_included", other_where="(included OR event_number % 7 = 1) AND event_number % 5 <> 0"),
        rules.Statement("accepted", "one_center_an_event", "SELECT event FROM {accepted} GROUP BY event HAVING max(center) - min(center) > 1e-9", ("accepted",)),
    ]
    return rules.report(spark, {"accepted": bad.unionByName(bad.where("cadence_id % 50 = 0")), "audit": audit}, made).drop("samples")


@query("""WITH p AS (SELECT p_partkey, p_partkey // 20 AS target_id, p_partkey % 20 AS at, p_size AS s, CASE WHEN p_partkey % 6 = 5 THEN 'short' ELSE 'Long' END AS cadence FROM part),
 x AS (SELECT *, s % 2 = 0 AS has_int, s % 3 <> 0 AS has_frames, s % 5 = 0 AS has_frame_time, s % 7 < 3 AS has_interval, row_number() OVER (PARTITION BY target_id ORDER BY p_partkey) - 1 AS i FROM p),
 y AS (SELECT *, CASE WHEN has_int AND has_frames THEN 'INT_TIME;NUM_FRM' WHEN has_frame_time AND has_frames THEN 'FRAMETIM;NUM_FRM' WHEN has_interval THEN 'TIMEDEL' WHEN cadence = 'Long' THEN '' END AS exposure_metadata_key,
  CASE WHEN has_int AND has_frames THEN 6.0::DOUBLE * s / 86400 WHEN has_frame_time AND has_frames THEN 6.5::DOUBLE * s / 86400 WHEN has_interval THEN 0.5::DOUBLE WHEN cadence = 'Long' THEN 1765.5::DOUBLE / 86400 END AS days FROM x)
 SELECT target_id, CAST(i AS INTEGER) AS product_index, CASE WHEN s % 4 = 0 THEN concat('lc', p_partkey, '.fits') WHEN s % 4 = 1 THEN concat('star ', s) ELSE concat('product_', lpad(CAST(i AS VARCHAR), 2, '0')) END AS product_id, CASE WHEN s % 4 = 2 THEN CAST(s % 17 AS VARCHAR) ELSE '' END AS quarter,
  exposure_metadata_key, round(days, 9) AS exposure_duration_days FROM y""")
def product_metadata(spark, sf_dir):
    """Parts stand for products whose headers have some keys and lack others: identity, quarter and exposure by precedence."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").alias("s"))
    entry = lambda holds, key, value: F.when(holds, F.struct(F.lit(key).alias("key"), value.cast("string").alias("value")))
    s = F.col("s")
    entries = F.array_compact(F.array(
        entry(s % 2 == 0, "INT_TIME", F.lit("6.0")), entry(s % 3 != 0, "NUM_FRM", s), entry(s % 5 == 0, "FRAMETIM", F.lit("6.5")), entry(s % 7 < 3, "TIMEDEL", F.lit("0.5")),
        entry(s % 4 == 0, "FILENAME", F.concat(F.lit("/data/lc"), F.col("p_partkey").cast("string"), F.lit(".fits"))), entry(s % 4 == 1, "OBJECT", F.concat(F.lit("star "), s.cast("string"))), entry(s % 4 == 2, "QUARTER", s % 17),
    ))
    products = p.select(F.expr("p_partkey div 20").alias("target_id"), "p_partkey", F.when(F.col("p_partkey") % 6 == 5, "short").otherwise("Long").alias("cadence"), F.map_from_entries(entries).alias("meta"))
    found = metadata.exposures(metadata.identified(products, "p_partkey"))
    return rounded(found.select("target_id", "product_index", "product_id", "quarter", "exposure_metadata_key", "exposure_duration_days"), 9)


# ----------------------------------------------------------------------------------------------------------- search
_SMALL = search.SearchConfig(max_duration=0.2, n_durations=3, n_periods=40)


def _sql_grid(c: search.SearchConfig) -> str:
    return f"""sp AS (SELECT target_id, max(time) - min(time) AS span, least({c.max_period!r}::DOUBLE, (max(time) - min(time)) / {c.min_transits}) AS longest FROM fin GROUP BY target_id),
 grid AS (SELECT target_id, span, k, 1 / (1 / {c.shortest!r}::DOUBLE - (1 / {c.shortest!r}::DOUBLE - 1 / longest) * k / {c.n_periods - 1}) AS period FROM (SELECT *, CAST(unnest(generate_series(0, {c.n_periods - 1})) AS INTEGER) AS k FROM sp WHERE longest > {c.shortest!r}::DOUBLE))"""


@query(f"WITH {FIN}, {_sql_grid(search.SearchConfig())} {sql_rounded('target_id ~span k ~period', 'grid')}")
def period_grid(spark, sf_dir):
    return rounded(search.period_grid(finite_curves(spark, sf_dir), search.SearchConfig()))


@query(f"""WITH {FIN}, {_sql_grid(_SMALL)}, c AS (SELECT target_id, 1 AS rank, period, 0.002::DOUBLE AS step, span FROM grid WHERE k = 20),
 w AS (SELECT *, greatest({_SMALL.shortest!r}::DOUBLE, period - {_SMALL.coarse_steps} * greatest(step, period * 1e-4)) AS low, period + {_SMALL.coarse_steps} * greatest(step, period * 1e-4) AS high, {_SMALL.drift!r}::DOUBLE * {_SMALL.min_duration!r}::DOUBLE * period / span AS wanted FROM c),
 n AS (SELECT *, CAST(ceil(greatest(high - low, wanted) / wanted) + 1 AS BIGINT) AS asked FROM w), m AS (SELECT *, least(greatest(asked, 3), {_SMALL.local_cap}) AS n FROM n),
 g AS (SELECT target_id, rank, k, low + (high - low) * k / (n - 1) AS period, asked > {_SMALL.local_cap} AS capped FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM m)) {sql_rounded('target_id rank k ~period capped', 'g')}""")
def local_period_grid(spark, sf_dir):
    grid = search.period_grid(finite_curves(spark, sf_dir), _SMALL).where("k = 20")
    return rounded(search.local_grid(grid.select("target_id", F.lit(1).alias("rank"), "period", F.lit(0.002).alias("step"), "span"), _SMALL))


@query()
def bls_periodogram(spark, sf_dir):
    curves = finite_curves(spark, sf_dir)
    return rounded(search.periodogram(curves, search.period_grid(curves, _SMALL), _SMALL))


@query()
def bls_top_candidates(spark, sf_dir):
    """The distinct peaks of the whole search, and their families."""
    curves, c = finite_curves(spark, sf_dir), search.SearchConfig()
    return rounded(search.harmonic_families(search.distinct_peaks(search.periodogram(curves, search.period_grid(curves, c), c), c.top)))


_COARSE = search.SearchConfig(n_periods=12, max_duration=0.1, n_durations=2, oversample=4)
_WIDTH = _COARSE.min_duration / _COARSE.oversample
_LENGTHS = [max(1, round(d / _WIDTH)) for d in _COARSE.durations]


@query(f"""WITH {FIN}, {_sql_grid(_COARSE)}, o AS (SELECT target_id, median(flux) AS m, min(time) AS t0, count(*) AS n FROM fin GROUP BY target_id HAVING count(*) > 2),
 y AS (SELECT fin.target_id, time - t0 AS t, flux - m AS y, n FROM fin JOIN o USING (target_id)), s AS (SELECT target_id, sum(y) AS total, any_value(n) AS n FROM y GROUP BY target_id),
 g AS (SELECT target_id, period, CAST(ceil(period / {_WIDTH!r}::DOUBLE) AS INTEGER) AS bins FROM grid), b AS (SELECT target_id, period, least(CAST(floor(fmod(t, period) / {_WIDTH!r}::DOUBLE) AS INTEGER), bins - 1) AS at, count(*) AS w, sum(y) AS s FROM y JOIN g USING (target_id) GROUP BY ALL),
 e AS (SELECT target_id, period, bins, unnest({_LENGTHS}) AS k FROM g), p AS (SELECT e.target_id, e.period, k, ((b.at - j.j) % bins + bins) % bins AS start, w, s FROM e JOIN b USING (target_id, period), LATERAL (SELECT unnest(generate_series(0, k - 1)) AS j) j),
 q AS (SELECT target_id, period, k, start, sum(w) AS w, sum(s) AS s FROM p GROUP BY ALL), r AS (SELECT q.*, (total - q.s) / (n - w) - q.s / w AS deep FROM q JOIN s USING (target_id) WHERE w < n),
 z AS (SELECT target_id, period, greatest(max(CASE WHEN deep >= 0 THEN 0.5 * w * deep * deep ELSE 0 END), 0) AS power FROM r GROUP BY ALL) {sql_rounded('target_id ~period ~power', 'z', 4)}""")
def bls_power(spark, sf_dir):
    """The power of a coarse search: what the best box at each of twelve periods explains."""
    curves = finite_curves(spark, sf_dir)
    return rounded(search.periodogram(curves, search.period_grid(curves, _COARSE), _COARSE).select("target_id", "period", "power"), 4)


_BOX_POWER = "CASE WHEN deep >= 0 THEN 0.5 * w * deep * deep ELSE 0 END"


@query(f"""WITH {FIN}, {_sql_grid(_COARSE)}, o AS (SELECT target_id, median(flux) AS m, min(time) AS t0, count(*) AS n FROM fin GROUP BY target_id HAVING count(*) > 2),
 y AS (SELECT fin.target_id, time - t0 AS t, flux - m AS y, n, t0 FROM fin JOIN o USING (target_id)), s AS (SELECT target_id, sum(y) AS total, any_value(n) AS n, any_value(t0) AS t0 FROM y GROUP BY target_id),
 g AS (SELECT target_id, period, CAST(ceil(period / {_WIDTH!r}::DOUBLE) AS INTEGER) AS bins FROM grid), b AS (SELECT target_id, period, least(CAST(floor(fmod(t, period) / {_WIDTH!r}::DOUBLE) AS INTEGER), bins - 1) AS at, count(*) AS w, sum(y) AS s FROM y JOIN g USING (target_id) GROUP BY ALL),
 e AS (SELECT target_id, period, bins, unnest({_LENGTHS}) AS k, unnest({_COARSE.durations}::DOUBLE[]) AS duration FROM g), p AS (SELECT e.target_id, e.period, duration, ((b.at - j.j) % bins + bins) % bins AS start, w, s FROM e JOIN b USING (target_id, period), LATERAL (SELECT unnest(generate_series(0, k - 1)) AS j) j),
 q AS (SELECT target_id, period, duration, start, sum(w) AS w, sum(s) AS s FROM p GROUP BY ALL), r AS (SELECT q.*, n, t0, (total - q.s) / (n - w) - q.s / w AS deep FROM q JOIN s USING (target_id) WHERE w < n),
 f AS (SELECT *, {_BOX_POWER} AS power, max({_BOX_POWER}) OVER (PARTITION BY target_id, period) AS greatest FROM r),
 h AS (SELECT * FROM f WHERE greatest > 0 AND power >= greatest * (1 - {search.SAME!r}::DOUBLE) QUALIFY row_number() OVER (PARTITION BY target_id, period ORDER BY duration, start) = 1),
 z AS (SELECT g.target_id, g.period, coalesce(power, 0) AS power, coalesce(duration, {_COARSE.durations[0]!r}::DOUBLE) AS duration, coalesce(deep, 0) AS depth, coalesce(fmod(start * {_WIDTH!r}::DOUBLE + duration / 2, g.period) + t0, 0) AS transit_time,
  coalesce(deep / sqrt(1 / w::DOUBLE + 1 / (n - w)::DOUBLE), 0) AS depth_snr FROM g JOIN o USING (target_id) LEFT JOIN (SELECT target_id, period, power, duration, deep, start, w FROM h) x USING (target_id, period)) {sql_rounded('target_id ~period ~power ~duration ~depth ~transit_time ~depth_snr', 'z', 4)}""")
def bls_boxes(spark, sf_dir):
    """The best box of a coarse search at each period: its power, duration, depth, middle and depth in deviations."""
    curves = finite_curves(spark, sf_dir)
    return rounded(search.periodogram(curves, search.period_grid(curves, _COARSE), _COARSE), 4)


@query(ORACLES["bls_boxes"])
def bls_boxes_in_slices(spark, sf_dir):
    """The same with every series folded in slices of at most some forty cadences."""
    curves = finite_curves(spark, sf_dir)
    return rounded(search.periodogram(curves, search.period_grid(curves, _COARSE), _COARSE, slice_rows=40), 4)


@query()
def refined_candidates(spark, sf_dir):
    """Distinct peaks of a broad search, searched again around their periods."""
    curves, c = finite_curves(spark, sf_dir), search.SearchConfig(n_periods=60, max_duration=0.4, n_durations=4, top=3, local_cap=150, local_duration_step=0.05)
    grid = search.period_grid(curves, c)
    scan = written(search.periodogram(curves, grid, c))
    step = grid.join(grid.select("target_id", (F.col("k") + 1).alias("k"), F.col("period").alias("before")), ["target_id", "k"], "left").select("target_id", "period", F.abs(F.col("period") - F.coalesce("before", "period")).alias("step"))
    peaks = search.distinct_peaks(scan, c.top).select("target_id", "rank", "period")
    return rounded(search.refine(curves, peaks.join(scan, ["target_id", "period"]).join(step, ["target_id", "period"]), c))


@query()
def alias_diagnostics(spark, sf_dir):
    """Boxes at half, once and twice the period of the known dip."""
    curves, c = finite_curves(spark, sf_dir), search.SearchConfig(max_duration=0.4, local_duration_step=0.05)
    return rounded(search.aliases(curves, curves.select("target_id").distinct().withColumn("period", F.lit(E.period)), c))


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of a customer stand for the peaks of a target."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("target_id"), (F.lit(1.0) + F.col("o_orderkey") % 97 / 4).alias("period"), F.col("o_totalprice").alias("power"))


_PEAKS = f"""pk AS (SELECT o_custkey AS target_id, 1.0::DOUBLE + (o_orderkey % 97) / 4::DOUBLE AS period, o_totalprice AS power FROM orders),
 rk AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY power DESC, period) AS i FROM pk)"""
_DISTINCT = f"""{_PEAKS}, st AS (SELECT target_id, i, period, power, [period] AS acc, true AS took FROM rk WHERE i = 1 UNION ALL
  SELECT r.target_id, r.i, r.period, r.power, CASE WHEN t THEN list_append(s.acc, r.period) ELSE s.acc END, t FROM st s JOIN (SELECT * FROM rk) r ON r.target_id = s.target_id AND r.i = s.i + 1,
  LATERAL (SELECT len(s.acc) < 10 AND len(list_filter(s.acc, lambda y: abs(r.period - y) < {search.SEPARATION} * greatest(r.period, y))) = 0 AS t)),
 dp AS (SELECT target_id, CAST(row_number() OVER (PARTITION BY target_id ORDER BY i) AS INTEGER) AS rank, period, power FROM st WHERE took)"""


@query(f"WITH RECURSIVE {_DISTINCT} {sql_rounded('target_id rank ~period ~power', 'dp')}")
def peak_dedup(spark, sf_dir):
    return rounded(search.distinct_peaks(_peaks(spark, sf_dir)))


_RATIOS = "[" + ", ".join(f"{r!r}::DOUBLE" for _, r in search.RELATIONS) + "]"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in search.RELATIONS) + "]"


def _sql_fits(x: str, y: str) -> str:
    return f"len(list_filter({_RATIOS}, lambda r: abs({x} / {y} - r) / r <= {search.TOLERANCE})) > 0"


@query(f"""WITH RECURSIVE {_DISTINCT}, fm AS (SELECT target_id, rank, [period] AS refs FROM dp WHERE rank = 1 UNION ALL
  SELECT d.target_id, d.rank, CASE WHEN len(list_filter(f.refs, lambda y: {_sql_fits('d.period', 'y')})) > 0 THEN f.refs ELSE list_append(f.refs, d.period) END FROM fm f JOIN dp d ON d.target_id = f.target_id AND d.rank = f.rank + 1),
 lr AS (SELECT target_id, max_by(refs, rank) AS refs FROM fm GROUP BY target_id), fa AS (SELECT dp.target_id, rank, period, refs, CAST(list_position(list_transform(refs, lambda y: {_sql_fits('period', 'y')}), true) AS INTEGER) AS family FROM dp JOIN lr USING (target_id)),
 x AS (SELECT *, refs[family] AS reference, period / refs[family] AS ratio FROM fa), z AS (SELECT *, list_transform({_RATIOS}, lambda r: abs(ratio / r - 1)) AS off FROM x),
 o AS (SELECT target_id, rank, period, family, reference, ratio, {_NAMES}[list_position(off, list_min(off))] AS relation, list_min(off) AS mismatch FROM z) {sql_rounded('target_id rank ~period family ~reference ~ratio relation ~mismatch', 'o')}""")
def harmonic_families(spark, sf_dir):
    return rounded(search.harmonic_families(search.distinct_peaks(_peaks(spark, sf_dir)).select("target_id", "rank", "period")))


# -------------------------------------------------------------------------------------------------------- posterior
_PARAMETERS = ["log_rp", "log_a", "z_b"]


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders stand for the draws of four ensembles of six walkers."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        (F.col("l_orderkey") % 4).cast("int").alias("ensemble"), (F.col("l_suppkey") % 6).cast("int").alias("walker"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("step"),
        F.log("l_quantity").alias("log_rp"), (F.col("l_extendedprice") / 10000).alias("log_a"), (F.col("l_discount") - F.col("l_tax")).alias("z_b"),
    )


_CHAIN = """ch AS (SELECT CAST(l_orderkey % 4 AS INTEGER) AS ensemble, CAST(l_suppkey % 6 AS INTEGER) AS walker, l_orderkey * 8 + l_linenumber AS step, ln(l_quantity) AS log_rp, l_extendedprice / 10000 AS log_a, l_discount - l_tax AS z_b FROM lineitem),
 dr AS (SELECT ensemble, walker, step, unnest(['log_rp', 'log_a', 'z_b']) AS parameter, unnest([log_rp, log_a, z_b]) AS value FROM ch WHERE step >= 1000)"""


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posterior.long_form(_chain(spark, sf_dir).where("step >= 1000"), _PARAMETERS)


def _sql_summary(by: str, source: str = "dr", name: str = "su") -> str:
    q = ", ".join(f"quantile_cont(value, {p}) AS {n}" for n, p in posterior.QUANTILES.items())
    return f"{name} AS (SELECT {by}, {q}, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM {source} GROUP BY ALL)"


_SUMMED = "parameter ~q02_5 ~q16 ~median ~q84 ~q97_5 ~mean ~sd n"


@query(f"WITH {_CHAIN}, {_sql_summary('parameter')} {sql_rounded(_SUMMED, 'su')}")
def posterior_quantiles(spark, sf_dir):
    return rounded(posterior.summary(_draws(spark, sf_dir)))


@query("WITH ch AS (SELECT CAST(l_orderkey % 4 AS INTEGER) AS ensemble, CAST(l_suppkey % 6 AS INTEGER) AS walker, l_orderkey * 8 + l_linenumber AS step FROM lineitem), l AS (SELECT *, max(step) OVER (PARTITION BY ensemble, walker) AS last FROM ch), "
       "k AS (SELECT * FROM l WHERE step >= least(20000, last)) SELECT ensemble, walker, count(*) AS n, min(step) AS first FROM k GROUP BY ALL")
def warmup_removal(spark, sf_dir):
    return posterior.after_warmup(_chain(spark, sf_dir), 20_000).groupBy("ensemble", "walker").agg(F.count("*").alias("n"), F.min("step").alias("first"))


@query("WITH i AS (SELECT o_orderkey AS run, o_orderstatus AS status, o_totalprice AS best FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS run, 'done' AS status, o_totalprice + 1 AS best FROM orders WHERE o_orderkey % 2 = 0) "
       "SELECT run, status, round(best, 6) AS best FROM n UNION ALL SELECT run, status, round(best, 6) FROM i WHERE run NOT IN (SELECT run FROM n)")
def run_index_upsert(spark, sf_dir):
    """Orders stand for runs: a third is new, and every second one has news."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("best"))
    news = o.where("run % 2 = 0").select("run", F.lit("done").alias("status"), (F.col("best") + 1).alias("best"))
    return rounded(snapshots.upsert(o.where("run % 3 <> 0"), news, "run"))


@query("WITH n AS (SELECT o_custkey AS run, o_orderstatus AS mode, o_orderkey AS seq, o_totalprice AS best FROM orders), i AS (SELECT * FROM n WHERE seq % 3 = 0), u AS (SELECT * FROM n WHERE seq % 3 <> 0 AND run % 2 = 0), "
       "l AS (SELECT *, 1 AS k FROM i QUALIFY row_number() OVER (PARTITION BY run, mode ORDER BY seq DESC) = 1), m AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY run, mode ORDER BY seq DESC) = 1) "
       "SELECT run, mode, seq, round(best, 6) AS best FROM m UNION ALL SELECT run, mode, seq, round(best, 6) FROM l ANTI JOIN m USING (run, mode)")
def run_index_versions(spark, sf_dir):
    """A versioned index of runs: orders of every third key first, then news of even customers, of which the last counts."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("run"), F.col("o_orderstatus").alias("mode"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("best"))
    index = VersionedTable(spark, shared_folder(spark), "run long, mode string, seq long, best double")
    index.upsert(o.where("seq % 3 = 0"), ("run", "mode"), "seq")
    index.upsert(o.where("seq % 3 <> 0 AND run % 2 = 0"), ("run", "mode"), "seq")
    return rounded(index.read())


@query(f"""WITH {FIN}, {_sql_depths('fin', 'flux', f'abs({sql_phase()}) <= {E.duration / 2!r}::DOUBLE', f'NOT abs({sql_phase()}) <= {E.duration / 2!r}::DOUBLE')},
 x AS (SELECT target_id, depth, flux_out, 2.0::DOUBLE AS depth_reference, 50.0::DOUBLE AS flux_out_reference, depth - 2 AS depth_difference, flux_out - 50 AS flux_out_difference, (depth - 2) / 2 AS depth_share, (flux_out - 50) / 50 AS flux_out_share FROM d2)
 {sql_rounded('target_id ~depth ~flux_out depth_reference flux_out_reference ~depth_difference ~flux_out_difference ~depth_share ~flux_out_share', 'x')}""")
def published_comparison(spark, sf_dir):
    found = recovery.known_signal(finite_curves(spark, sf_dir), E)
    return rounded(snapshots.compared(found, found.select("target_id", F.lit(2.0).alias("depth"), F.lit(50.0).alias("flux_out")), "depth", "flux_out"))


@query(f"WITH {_CHAIN}, {_sql_summary('ensemble, parameter')} {sql_rounded('ensemble ' + _SUMMED, 'su')}")
def ensemble_summary(spark, sf_dir):
    return rounded(posterior.summary(_draws(spark, sf_dir), "ensemble"))


@query(f"""WITH {_CHAIN}, k AS (SELECT *, row_number() OVER (PARTITION BY parameter, ensemble, walker ORDER BY step, value) - 1 AS k, count(*) OVER (PARTITION BY parameter, ensemble, walker) // 2 AS h FROM dr),
 hv AS (SELECT parameter, ensemble, walker, k // h AS half, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM k WHERE h >= 2 AND k < 2 * h GROUP BY ALL),
 o AS (SELECT parameter, count(*) AS n_halves, avg(v) AS w, var_samp(m) AS s, min(n) AS n FROM hv GROUP BY ALL), x AS (SELECT parameter, n_halves, sqrt(((n - 1) / n::DOUBLE * w + s) / w) AS rhat FROM o) {sql_rounded('parameter n_halves ~rhat', 'x')}""")
def split_rhat(spark, sf_dir):
    return rounded(posterior.split_rhat(_draws(spark, sf_dir)))


def _grown(counts: DataFrame) -> DataFrame:
    """Summaries after one to four ensembles, of their counts."""
    chunks = counts.withColumn("steps", F.explode(F.array(*map(F.lit, range(1, 5))))).where("ensemble < steps").withColumn("steps", F.col("steps") * 100)
    return posterior.summary_of_counts(written(chunks.groupBy("steps", "parameter", "value").agg(F.sum("n").alias("n"))), "steps")


@query(f"""WITH {_CHAIN}, gr AS (SELECT *, unnest([1, 2, 3, 4]) AS chunk FROM dr), cu AS (SELECT chunk * 100 AS steps, parameter, value FROM gr WHERE ensemble < chunk), {_sql_summary('steps, parameter', 'cu')},
 ag AS (SELECT *, dense_rank() OVER (PARTITION BY parameter ORDER BY steps DESC) AS age FROM su), pa AS (SELECT r.parameter, r.steps, greatest(abs(l.q84 - l.q16), coalesce(l.sd, 0), 1e-12) AS sc,
  unnest([{', '.join(f"'{n}'" for n in posterior.QUANTILES)}]) AS field, unnest([{', '.join(f'abs(l.{n} - r.{n})' for n in posterior.QUANTILES)}]) AS dd FROM ag l JOIN ag r USING (parameter) WHERE l.age = 1 AND r.age BETWEEN 2 AND 3),
 x AS (SELECT parameter, steps, field, dd / sc AS change, dd / sc <= {posterior.STABLE} AS stable FROM pa) {sql_rounded('parameter steps field ~change stable', 'x')}""")
def stability_check(spark, sf_dir):
    """Summaries after one to four ensembles stand for a history of four chunks."""
    return rounded(posterior.stability(_grown(posterior.counted(_draws(spark, sf_dir), "ensemble"))))


@query(f"""WITH {_CHAIN}, {_sql_summary('ensemble, parameter')}, {_sql_summary('parameter', name='al')}, j AS (SELECT su.parameter, ensemble, abs(su.median - al.median) / greatest(al.q84 - al.q16, al.sd, 1e-12) AS shift,
  greatest(least(su.q84, al.q84) - greatest(su.q16, al.q16), 0) / greatest(least(su.q84 - su.q16, al.q84 - al.q16), 1e-12) AS overlap FROM su JOIN al USING (parameter)),
 x AS (SELECT *, shift <= {posterior.SHIFT} AND overlap >= {posterior.OVERLAP} AS agrees FROM j) {sql_rounded('parameter ensemble ~shift ~overlap agrees', 'x')}""")
def ensemble_agreement(spark, sf_dir):
    return rounded(posterior.agreement(_draws(spark, sf_dir)))


@query(f"""WITH {_CHAIN}, {_sql_summary('parameter')}, t AS (SELECT unnest(['log_rp', 'log_a', 'z_b']) AS parameter, unnest([3.0::DOUBLE, 0.2::DOUBLE, 0.0::DOUBLE]) AS injected),
 x AS (SELECT parameter, injected, median, q84 - q16 AS width_68, q97_5 - q02_5 AS width_95, injected BETWEEN q16 AND q84 AS inside_68, injected BETWEEN q02_5 AND q97_5 AS inside_95 FROM su JOIN t USING (parameter))
 {sql_rounded('parameter injected ~median ~width_68 ~width_95 inside_68 inside_95', 'x')}""")
def truth_coverage(spark, sf_dir):
    truth = spark.createDataFrame(list(zip(_PARAMETERS, (3.0, 0.2, 0.0))), "parameter string, injected double")
    return rounded(posterior.truth_coverage(posterior.summary(_draws(spark, sf_dir)), truth))


@query(f"""WITH {_CHAIN}, l AS (SELECT -log_a AS v FROM ch), m AS (SELECT max(v) AS best FROM l), d AS (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE]) AS distance),
 x AS (SELECT distance, avg(CASE WHEN v >= best - distance THEN 1.0 ELSE 0.0 END) AS fraction FROM l, m, d GROUP BY ALL) {sql_rounded('distance ~fraction', 'x')}""")
def near_best_fractions(spark, sf_dir):
    """The negative price of a line stands for the log probability of a draw."""
    return rounded(posterior.near_best(_chain(spark, sf_dir).select((-F.col("log_a")).alias("value"))))


@query(f"""WITH {_CHAIN}, e AS (SELECT parameter, min(value) AS low, max(value) AS high FROM dr GROUP BY ALL)
 SELECT parameter, CAST(least(floor((value - low) / (high - low) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM dr JOIN e USING (parameter) GROUP BY ALL""")
def posterior_histogram(spark, sf_dir):
    return posterior.histogram(_draws(spark, sf_dir))


@query(f"""WITH {_CHAIN}, x AS ({' UNION ALL '.join(f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS correlation FROM ch" for i, x in enumerate(_PARAMETERS) for y in _PARAMETERS[i:])}) {sql_rounded('x y ~correlation', 'x')}""")
def posterior_correlation(spark, sf_dir):
    return rounded(posterior.correlations(_chain(spark, sf_dir), _PARAMETERS))


# ---------------------------------------------------------------------------------------------------------- scalars
@query("""WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS q1, (p_partkey % 100) / 100.0::DOUBLE AS q2 FROM part), u AS (SELECT *, 2 * sqrt(q1) * q2 AS u1, sqrt(q1) * (1 - 2 * q2) AS u2 FROM p)
 SELECT p_partkey, round(u1, 6) AS u1, round(u2, 6) AS u2, round((u1 + u2) * (u1 + u2), 6) AS q1, round(CASE WHEN u1 + u2 > 0 THEN u1 / (2 * (u1 + u2)) END, 6) AS q2 FROM u""")
def limb_darkening_convert(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_size") / 50).alias("a"), (F.col("p_partkey") % 100 / 100).alias("b"))
    u1, u2 = q_to_u(F.col("a"), F.col("b"))
    p = p.withColumns({"u1": u1, "u2": u2})
    q1, q2 = u_to_q(F.col("u1"), F.col("u2"))
    return rounded(p.select("p_partkey", "u1", "u2", q1.alias("q1"), q2.alias("q2")))


@query(f"""WITH p AS (SELECT p_partkey, 1 + p_size / 2.0::DOUBLE AS a, (p_partkey % 30) / 10.0::DOUBLE AS b FROM part)
 SELECT p_partkey, round(CASE WHEN b <= a THEN degrees(acos(b / a)) END, 6) AS inclination, round(greatest(least(sqrt(greatest((1 + 0.1::DOUBLE) * (1 + 0.1::DOUBLE) - b * b, 1e-4)) / greatest(sin(pi() * {D} / {P}), 1e-3), 80), 1 + 0.1::DOUBLE + 1e-3), 6) AS a_from_duration FROM p""")
def inclination(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.lit(1.0) + F.col("p_size") / 2).alias("a"), (F.col("p_partkey") % 30 / 10).alias("b"))
    return rounded(p.select("p_partkey", inclination_degrees(F.col("a"), F.col("b")).alias("inclination"), duration_informed_a(F.lit(0.1), F.col("b"), F.lit(E.duration), F.lit(E.period)).alias("a_from_duration")))


_BROKEN = {
    "rp_must_be_positive": "rp <= 0", "a_over_rstar_must_exceed_1_plus_rp": "a <= 1 + greatest(rp, 0)", "impact_parameter_outside_transiting_range": "b < 0 OR b >= 1 + greatest(rp, 0)", "inclination_invalid": "a > 0 AND b > a",
    "q1_outside_unit_interval": "NOT q1 BETWEEN 0 AND 1", "q2_outside_unit_interval": "NOT q2 BETWEEN 0 AND 1", "jitter_must_be_nonnegative": "jitter < 0",
}


@query("""WITH p AS (SELECT p_partkey, (p_size - 5) / 100::DOUBLE AS rp, (p_partkey % 13 - 1)::DOUBLE / 2 AS a, (p_partkey % 7 - 1)::DOUBLE / 3 AS b, (p_size - 2) / 45::DOUBLE AS q1, (p_partkey % 11) / 9::DOUBLE AS q2, (p_partkey % 5 - 1) / 100::DOUBLE AS jitter FROM part)
 SELECT p_partkey, """ + "concat_ws(';', " + ", ".join(f"CASE WHEN {_BROKEN[n]} THEN '{n}' END" for n in PHYSICAL) + ") AS broken FROM p")
def physical_constraints(spark, sf_dir):
    """Parts stand for parameter sets, of which many break something."""
    k, size = F.col("p_partkey"), F.col("p_size")
    found = violations((size - 5) / 100, (k % 13 - 1) / 2, (k % 7 - 1) / 3, (size - 2) / 45, k % 11 / 9, (k % 5 - 1) / 100)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.array_join(found, ";").alias("broken"))


@query(r"""SELECT p_partkey, replace(replace(lower(p_name), ' ', ''), '-', '') AS name, nullif(regexp_replace(trim(concat(' ', p_brand, ' / ', p_type, '  ')), '[^A-Za-z0-9_.-]+', '_', 'g'), '') AS run FROM part""")
def names(spark, sf_dir):
    """Names by which targets are compared, and names of runs that may be part of a path."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", plain_name(F.col("p_name")).alias("name"), run_id(F.concat(F.lit(" "), "p_brand", F.lit(" / "), "p_type", F.lit("  "))).alias("run"))


# ------------------------------------------------------------------------------------------------ model and sampling
_TRUE = (0.1, 5.5, 0.3, 0.36, 1 / 3)
_TIMING = transit.Timing(E.period, E.epoch)
_EXPOSURE = 0.0204


def _injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted cadences whose flux is a transit plus a noise of their own: a thousandth of how far their value lies
    from the median of their target, in medians, within three."""
    curves = cleaning.normalize(finite_curves(spark, sf_dir), "target_id")
    noise = F.greatest(F.least(F.col("flux_norm") - 1, F.lit(3.0)), F.lit(-3.0)) * 1e-3

    def add(batches):
        for pdf in batches:
            yield pdf.assign(flux=transit.model_flux(pdf["time"].to_numpy(), _EXPOSURE, np.array(_TRUE), _TIMING) + pdf["noise"])[["target_id", "product_id", "cadence_id", "time", "flux", "flux_err"]]

    dipped = curves.select("target_id", "product_id", "cadence_id", "time", "flux", F.lit(1e-3).alias("flux_err"), noise.alias("noise"))
    dipped = dipped.mapInPandas(add, "target_id long, product_id string, cadence_id long, time double, flux double, flux_err double")
    return written(windows.accepted_cadences(written(dipped), E))


@query()
def transit_model(spark, sf_dir):
    """Cadences with an injected transit, the input of the fits."""
    return rounded(_injected(spark, sf_dir).select("target_id", "cadence_id", "event_number", "offset", "flux"))


@query()
def transit_fit(spark, sf_dir):
    return rounded(transit.fit_targets(_injected(spark, sf_dir), _TIMING, E.duration, _EXPOSURE), 4)


@query()
def fit_stability(spark, sf_dir):
    """Fits of halves of the time and of each product."""
    return rounded(transit.stability_fits(_injected(spark, sf_dir), _TIMING, E.duration, _EXPOSURE, "product_id", n_starts=1), 4)


@query()
def posterior_sampling(spark, sf_dir):
    """Eight steps of two small ensembles per target around the injected transit, and what they say of each parameter."""
    accepted = _injected(spark, sf_dir)
    c = sampling.SamplerConfig(ensembles=2, walkers=16, supersample=3)
    center = [math.log(_TRUE[0]), math.log(_TRUE[1]), _TRUE[2] / (1 + _TRUE[0]), *_TRUE[3:], math.log(1e-3), 0.0, 0.0]
    centers = accepted.select("target_id").distinct().select("target_id", *(F.lit(float(v)).alias(n) for n, v in zip(sampling.PARAMETERS, center)))
    chain = sampling.run_chunk(accepted, centers, _TIMING, c, 8)
    draws = chain.unpivot(["target_id", "ensemble", "walker", "step"], list(sampling.PARAMETERS), "parameter", "value")
    return rounded(posterior.summary(draws, "target_id"))


_SIZES = f"""{_CHAIN}, ed AS (SELECT parameter, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM dr GROUP BY ALL),
 nb AS (SELECT parameter, ensemble, walker, value, row_number() OVER (PARTITION BY parameter, ensemble, walker ORDER BY step, value) AS k FROM dr),
 ct AS (SELECT nb.parameter, ensemble, walker, k, value - avg(value) OVER w AS v, CAST(value <= low AS DOUBLE) - avg(CAST(value <= low AS DOUBLE)) OVER w AS l, CAST(value >= high AS DOUBLE) - avg(CAST(value >= high AS DOUBLE)) OVER w AS h
  FROM nb JOIN ed USING (parameter) WINDOW w AS (PARTITION BY nb.parameter, ensemble, walker)),
 ld AS (SELECT *, k - lag AS kb FROM ct, (SELECT unnest(generate_series(0, {sampling.LAGS})) AS lag)),
 pr AS (SELECT a.parameter, a.lag, sum(a.v * b.v) AS v, sum(a.l * b.l) AS l, sum(a.h * b.h) AS h, count(*) AS n FROM ld a JOIN ct b ON b.parameter = a.parameter AND b.ensemble = a.ensemble AND b.walker = a.walker AND b.k = a.kb GROUP BY ALL),
 rh AS (SELECT p.parameter, p.lag, unnest(['v', 'l', 'h']) AS series, unnest([(p.v / p.n) / (z.v / z.n), (p.l / p.n) / (z.l / z.n), (p.h / p.n) / (z.h / z.n)]) AS rho FROM pr p JOIN pr z ON z.parameter = p.parameter AND z.lag = 0 WHERE p.lag > 0),
 fs AS (SELECT *, min(CASE WHEN NOT coalesce(rho > 0, false) THEN lag END) OVER (PARTITION BY parameter, series) AS stop FROM rh),
 ta AS (SELECT parameter, series, 1 + 2 * coalesce(sum(rho) FILTER (lag < coalesce(stop, {sampling.LAGS + 1})), 0) AS tau FROM fs GROUP BY ALL), nn AS (SELECT parameter, count(*) AS n FROM dr GROUP BY ALL),
 sz AS (SELECT parameter, any_value(n) / greatest(max(tau) FILTER (series = 'v'), 1) AS ess, any_value(n) / greatest(max(tau) FILTER (series <> 'v'), 1) AS tail_ess, max(tau) FILTER (series = 'v') AS tau FROM ta JOIN nn USING (parameter) GROUP BY parameter)"""


@query(f"WITH {_SIZES} {sql_rounded('parameter ~ess ~tail_ess ~tau', 'sz', 4)}")
def effective_sample_sizes(spark, sf_dir):
    return rounded(sampling.effective_sizes(_draws(spark, sf_dir)), 4)


def _sql_prefix_sizes(k: int) -> str:
    """Sizes over the first k of three shares of the steps."""
    return f"SELECT {k} AS chunk, parameter, n, mean, sd, tau, ess FROM (WITH {_SIZES.replace('WHERE step >= 1000)', f'WHERE step >= 1000 AND step <= 1000 + ((SELECT max(l_orderkey) * 8 + 8 FROM lineitem) - 1000) // 3 * {k})', 1)} SELECT parameter, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, any_value(sz.tau) AS tau, any_value(sz.ess) AS ess FROM dr JOIN sz USING (parameter) GROUP BY parameter)"


@query(f"WITH x AS ({' UNION ALL '.join(_sql_prefix_sizes(k) for k in (1, 2, 3))}) SELECT CAST(chunk AS INTEGER) AS chunk, parameter, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(tau, 4) AS tau, round(ess, 3) AS ess FROM x")
def convergence_history(spark, sf_dir):
    """A history of three chunks of the draws, each row from its own chunk and the state before it."""
    draws, h = _draws(spark, sf_dir), history.History(spark, shared_folder(spark))
    last = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.max("l_orderkey")).first()[0] * 8 + 8
    third = (last - 1000) // 3
    for k in (1, 2, 3):
        h.append(draws.where(F.col("step").between(1001 + third * (k - 1) if k > 1 else 1000, 1000 + third * k)), 1000 + third * k)
    return h.rows().select(F.expr(f"CAST((steps - 1000) div {third} AS int)").alias("chunk"), "parameter", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("tau", 4).alias("tau"), F.round("ess", 3).alias("ess"))


def _sql_all(condition: str, source: str) -> str:
    return f"(SELECT count(*) FILTER (coalesce({condition}, false)) = {len(_PARAMETERS)} FROM {source})"


_CRITERIA = {
    "complete_valid_rhat": _sql_all("isfinite(rhat)", "r"), "rhat_all_below_threshold": _sql_all("isfinite(rhat) AND rhat < 1.01", "r"), "complete_valid_bulk_ess": _sql_all("isfinite(ess)", "s"), "complete_valid_tail_ess": _sql_all("isfinite(tail_ess)", "s"),
    "ess_all_above_minimum": _sql_all("isfinite(ess) AND ess >= 1000", "s"), "tail_ess_all_above_minimum": _sql_all("isfinite(tail_ess) AND tail_ess >= 1000", "s"), "complete_valid_autocorrelation": _sql_all("isfinite(tau)", "s"),
    "chain_length_exceeds_tau_multiple": _sql_all("isfinite(tau) AND 1000 > 50 * tau", "s"), "posterior_summary_stability": "(SELECT bool_and(coalesce(stable, false)) FROM st)", "independent_ensemble_agreement": "(SELECT bool_and(coalesce(agrees, false)) FROM ag)",
    "finite_log_probability_fraction_is_one": "(SELECT bool_and(isfinite(l_extendedprice / 10000)) FROM lineitem)",
}


@query(f"WITH r AS ({ORACLES['split_rhat']}), s AS ({ORACLES['effective_sample_sizes']}), st AS ({ORACLES['stability_check']}), ag AS ({ORACLES['ensemble_agreement']}) " + " UNION ALL ".join(f"SELECT '{n}' AS criterion, coalesce({c}, false) AS holds" for n, c in _CRITERIA.items()))
def convergence_criteria(spark, sf_dir):
    """The eleven conditions on the draws of four ensembles."""
    draws = _draws(spark, sf_dir)
    counts, cut = posterior.counted(draws, "ensemble"), pieces(draws, list(posterior.CHAIN), ["step", "value"], "value")
    both = written(counts.groupBy("parameter", "value").agg(F.sum("n").alias("n")))
    finite_ = _chain(spark, sf_dir).select(finite("log_a").alias("is_finite"))
    return posterior.criteria(posterior.rhat_of(cut), sampling.sizes_of(cut, both), posterior.stability(_grown(counts)), posterior.agreement_of_counts(counts), finite_, _PARAMETERS, 1000)


_HALVES = """nk AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY parameter, ensemble, walker) // 2 AS h FROM dr WINDOW w AS (PARTITION BY parameter, ensemble, walker ORDER BY step, value)),
 ha AS (SELECT parameter, ensemble, walker, k // h AS half, value FROM nk WHERE h >= 2 AND k < 2 * h)"""


def _sql_rank_rhat(source: str, name: str) -> str:
    return f"""{name}_r AS (SELECT *, rank() OVER (PARTITION BY parameter ORDER BY value) + (count(*) OVER (PARTITION BY parameter, value) - 1) / 2.0::DOUBLE AS rank, count(*) OVER (PARTITION BY parameter) AS total FROM {source}),
 {name}_z AS (SELECT *, {diagnostics.sql_normal_quantile('p')} AS z FROM (SELECT *, (rank - 0.375) / (total + 0.25) AS p FROM {name}_r)),
 {name}_c AS (SELECT parameter, ensemble, walker, half, avg(z) AS m, var_samp(z) AS v, count(*) AS n FROM {name}_z GROUP BY ALL),
 {name} AS (SELECT parameter, sqrt(((min(n) - 1) / min(n)::DOUBLE * avg(v) + var_samp(m)) / avg(v)) AS rhat_{name} FROM {name}_c GROUP BY parameter)"""


@query(f"""WITH {_CHAIN}, {_HALVES}, fo AS (SELECT * REPLACE (abs(value - median(value) OVER (PARTITION BY parameter)) AS value) FROM ha), {_sql_rank_rhat('ha', 'bulk')}, {_sql_rank_rhat('fo', 'tail')},
 x AS (SELECT parameter, rhat_bulk, rhat_tail, greatest(rhat_bulk, rhat_tail) AS rhat FROM bulk JOIN tail USING (parameter)) {sql_rounded('parameter ~rhat_bulk ~rhat_tail ~rhat', 'x')}""")
def rank_rhat(spark, sf_dir):
    return rounded(diagnostics.rank_rhat(_draws(spark, sf_dir)))


@query()
def rank_sizes(spark, sf_dir):
    return rounded(diagnostics.rank_sizes(_draws(spark, sf_dir)), 3)


#: Lags that the SQL of autocorrelation times looks at: draws that don't hang together need a window of some five.
_SQL_LAGS = 60


@query(f"""WITH {_CHAIN}, nb AS (SELECT *, row_number() OVER (PARTITION BY parameter, ensemble, walker ORDER BY step, value) AS k, value - avg(value) OVER (PARTITION BY parameter, ensemble, walker) AS v FROM dr),
 ld AS (SELECT *, k - lag AS kb FROM nb, (SELECT unnest(generate_series(0, {_SQL_LAGS})) AS lag)), s AS (SELECT a.parameter, a.ensemble, a.walker, a.lag, sum(a.v * b.v) AS c FROM ld a JOIN nb b ON b.parameter = a.parameter AND b.ensemble = a.ensemble AND b.walker = a.walker AND b.k = a.kb GROUP BY ALL),
 f AS (SELECT a.parameter, a.ensemble, a.lag, sum(a.c / z.c) / any_value(w.n) AS f FROM s a JOIN s z ON z.parameter = a.parameter AND z.ensemble = a.ensemble AND z.walker = a.walker AND z.lag = 0
  JOIN (SELECT parameter, ensemble, count(DISTINCT walker) AS n FROM nb GROUP BY ALL) w ON w.parameter = a.parameter AND w.ensemble = a.ensemble GROUP BY a.parameter, a.ensemble, a.lag),
 t AS (SELECT *, 2 * sum(f) OVER (PARTITION BY parameter, ensemble ORDER BY lag) - 1 AS tau FROM f), x AS (SELECT ensemble, parameter, tau FROM t WHERE lag >= {diagnostics.WIDE} * tau QUALIFY row_number() OVER (PARTITION BY parameter, ensemble ORDER BY lag) = 1),
 m AS (SELECT ensemble, parameter, max(k) AS retained_steps FROM nb GROUP BY ALL), y AS (SELECT ensemble, parameter, tau, true AS available, retained_steps FROM x JOIN m USING (ensemble, parameter)) {sql_rounded('ensemble parameter ~tau available retained_steps', 'y')}""")
def autocorrelation_times(spark, sf_dir):
    """Times of four ensembles; all are available."""
    return rounded(diagnostics.autocorrelation_times(_draws(spark, sf_dir), _PARAMETERS).drop("error"))
