"""Checks of tables by rules: rows that say what must hold, compiled into one aggregate a table.

A report has a row for each rule: (table, rule, n_rows, n_failed, samples). n_failed is null where a rule can't be
verified, for a table or column that it needs is not there. samples are the least and the greatest offender as JSON.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "table string, rule string, n_rows long, n_failed long, samples array<string>"


@dataclass(frozen=True)
class Row:
    """What each row of a table must satisfy, in SQL; null counts as not satisfied. needs: the columns that it reads."""

    table: str
    name: str
    holds: str
    needs: tuple[str, ...]


@dataclass(frozen=True)
class Columns:
    """Columns that a table must have."""

    table: str
    names: tuple[str, ...]
    name: str = "has_columns"


@dataclass(frozen=True)
class Unique:
    """Columns that no two rows of a table share."""

    table: str
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"unique_{'_'.join(self.columns)}"


@dataclass(frozen=True)
class SameSet:
    """Values of a column that must be among those of another table's, and, if both, the other way round. Each side may
    be limited by a condition."""

    table: str
    column: str
    other: str
    other_column: str
    name: str
    where: str = "true"
    other_where: str = "true"
    both: bool = True


@dataclass(frozen=True)
class Statement:
    """SQL over tables, named in braces, that gives the offenders: no rows if all is well."""

    table: str
    name: str
    offenders: str
    tables: tuple[str, ...]
    needs: tuple[tuple[str, str], ...] = ()


def finite(column: str) -> str:
    """SQL: a column that is a finite number, whatever its type."""
    x = f"try_cast(`{column}` AS double)"
    return f"{x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < double('inf')"


def whole(column: str) -> str:
    return f"{finite(column)} AND try_cast(`{column}` AS double) = rint(try_cast(`{column}` AS double))"


def _samples(bad: Column) -> Column:
    row = F.to_json(F.struct("*"))
    return F.array_distinct(F.array_compact(F.array(F.min(F.when(bad, row)), F.max(F.when(bad, row)))))


def _rows_report(df: DataFrame, table: str, rules: list[Row]) -> DataFrame:
    """One aggregate for all rules on rows of a table."""
    bad = [~F.coalesce(F.expr(r.holds), F.lit(False)) for r in rules]
    one = df.agg(F.count("*").alias("n_rows"), *(F.count_if(b).alias(f"n{k}") for k, b in enumerate(bad)), *(_samples(b).alias(f"s{k}") for k, b in enumerate(bad)))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"n{k}").alias("n_failed"), F.col(f"s{k}").alias("samples")) for k, r in enumerate(rules)))
    return one.select(F.lit(table).alias("table"), "n_rows", F.explode(each).alias("x")).select("table", "x.rule", "n_rows", "x.n_failed", "x.samples")


def _offenders_report(found: DataFrame, table: str, rule: str) -> DataFrame:
    return found.agg(F.count("*").alias("n_failed"), _samples(F.lit(True)).alias("samples")).select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.lit(None).cast("long").alias("n_rows"), "n_failed", "samples")


def report(spark: SparkSession, tables: dict[str, DataFrame], rules: list) -> DataFrame:
    """The report of rules on tables. Rules on rows cost one aggregate a table, uniqueness one by its columns, sets an
    anti join of distinct values in each direction."""
    parts, unknown, columns = [], [], {t: set(df.columns) for t, df in tables.items()}
    has = lambda t, *c: t in columns and set(c) <= columns[t]
    by_table: dict[str, list[Row]] = {}
    for r in rules:
        if isinstance(r, Columns):
            missing = sorted(set(r.names) - columns[r.table]) if r.table in columns else None
            unknown.append((r.table, r.name, None, None if missing is None else len(missing), missing or []))
        elif isinstance(r, Row) and has(r.table, *r.needs):
            by_table.setdefault(r.table, []).append(r)
        elif isinstance(r, Unique) and has(r.table, *r.columns):
            parts.append(_offenders_report(tables[r.table].groupBy(*r.columns).count().where("count > 1"), r.table, r.name))
        elif isinstance(r, SameSet) and has(r.table, r.column) and has(r.other, r.other_column):
            a = tables[r.table].where(r.where).select(F.col(r.column).cast("string").alias("value")).distinct()
            b = tables[r.other].where(r.other_where).select(F.col(r.other_column).cast("string").alias("value")).distinct()
            gone = a.join(b, "value", "left_anti").withColumn("lacks", F.lit(r.other))
            parts.append(_offenders_report(gone.unionByName(b.join(a, "value", "left_anti").withColumn("lacks", F.lit(r.table))) if r.both else gone, r.table, r.name))
        elif isinstance(r, Statement) and all(t in tables for t in r.tables) and all(has(t, c) for t, c in r.needs):
            parts.append(_offenders_report(spark.sql(r.offenders, **{t: tables[t] for t in r.tables}), r.table, r.name))
        else:
            unknown.append((r.table, r.name, None, None, []))
    parts += [_rows_report(tables[t], t, some) for t, some in by_table.items()]
    if unknown:
        parts.append(spark.createDataFrame(unknown, REPORT))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], REPORT)


def required(found: DataFrame) -> None:
    """Raises a ValueError that names the rules that fail or can't be verified. A report has a row a rule, no more."""
    broken = found.where("n_failed IS NULL OR n_failed > 0").orderBy("table", "rule").collect()
    if broken:
        raise ValueError("; ".join(f"{r['table']}.{r['rule']}: " + ("not verifiable" if r["n_failed"] is None else f"{r['n_failed']} ({', '.join(r['samples'])})") for r in broken))


# --------------------------------------------------------------------------------------- the snapshot of a frozen fit
#: Tables of a snapshot and the files that hold them; fixed values.
CSV_FILES = {"accepted": "accepted_fit_cadences.csv", "audit": "transit_window_audit.csv", "products": "observation_product_metadata.csv", "parameters": "deterministic_fit_parameters.csv"}
JSON_FILES = {"limb": "limb_darkening_inputs.json", "configuration": "phase1b_configuration.json", "summary": "phase1b_summary.json", "provenance": "provenance_manifest.json"}
OPTIONAL_FILES = {"phase1a": "phase1a_input_record.json"}
#: Parameters on which the table and the summary must agree; fixed values.
REFINED = ("objective_value", "rp_over_rstar", "a_over_rstar", "impact_parameter", "q1", "q2", "white_noise_jitter", "period_days", "transit_time")
_INCLUDED = "lower(trim(included)) IN ('true', '1')"


def _json(table: str, path: str) -> str:
    return f"get_json_object({table}.value, '{path}')"


def _canonical(value: str) -> str:
    """SQL: JSON with sorted keys, and strings with slashes for backslashes."""
    return f"replace(to_json({value}), '\\\\\\\\', '/')"


def _whole_if_there(table: str, *columns: str) -> list[Row]:
    return [Row(table, f"whole_{c}", whole(c), (c,)) for c in columns]


def _expected_count(name: str, path: str, source: str, where: str = "true", needs: tuple = ()) -> Statement:
    counted, listed = path.split(":")
    return Statement(counted, name, f"SELECT * FROM (SELECT (SELECT count(*) FROM {{{source}}} WHERE {where}) AS found, CAST((SELECT {_json('x', listed)} FROM {{{counted}}} x) AS long) AS told) WHERE NOT (found <=> told)", (counted, source), needs)


_EPHEMERIS = "$.established_inputs.full_mission_local_refinement"
SNAPSHOT_RULES: list = [
    Columns("accepted", ("time", "flux", "flux_uncertainty", "event_number", "predicted_center", "product_id", "quarter", "exposure_days")),
    Columns("audit", ("event_number", "predicted_midpoint", "included")), Columns("products", ("product_id", "quarter", "exposure_duration_days")), Columns("parameters", ("stage",)),
    *(Row("accepted", f"finite_{c}", finite(c), (c,)) for c in ("time", "flux", "flux_uncertainty", "event_number", "predicted_center", "exposure_days")),
    *(Row("accepted", f"positive_{c}", f"try_cast({c} AS double) > 0", (c,)) for c in ("flux_uncertainty", "exposure_days")),
    *(Row("accepted", f"named_{c}", f"trim({c}) <> ''", (c,)) for c in ("product_id", "quarter")),
    *_whole_if_there("accepted", "event_number"), Unique("accepted", ("time", "event_number", "product_id")), Unique("products", ("product_id",)),
    *_whole_if_there("audit", "event_number"), *_whole_if_there("products", "quarter"),
    SameSet("accepted", "event_number", "audit", "event_number", "events_are_those_included", other_where=_INCLUDED),
    SameSet("accepted", "product_id", "products", "product_id", "products_are_known", both=False),
    SameSet("accepted", "event_number", "audit", "event_number", "events_are_predicted", both=False),
    _expected_count("included_count", "summary:$.transit_windows.included_count", "audit", _INCLUDED, (("audit", "included"),)),
    _expected_count("predicted_count", "summary:$.transit_windows.predicted_count", "audit"), _expected_count("cadence_count", "provenance:$.cadence_counts.phase1b_fit_cadence_count", "accepted"),
    Statement("accepted", "one_center_an_event", "SELECT event_number, min(try_cast(predicted_center AS double)) AS low, max(try_cast(predicted_center AS double)) AS high FROM {accepted} GROUP BY event_number HAVING NOT coalesce(high - low <= 1e-9, false)", ("accepted",), (("accepted", "predicted_center"), ("accepted", "event_number"))),
    Statement("accepted", "centers_of_audit", f"""SELECT a.event_number, a.center, b.predicted_midpoint FROM (SELECT event_number, median(try_cast(predicted_center AS double)) AS center FROM {{accepted}} GROUP BY event_number) a
      JOIN (SELECT event_number, predicted_midpoint FROM {{audit}} WHERE {_INCLUDED}) b ON try_cast(a.event_number AS double) = try_cast(b.event_number AS double) WHERE NOT coalesce(abs(a.center - try_cast(b.predicted_midpoint AS double)) <= 1e-9, false)""",
      ("accepted", "audit"), (("accepted", "predicted_center"), ("accepted", "event_number"), ("audit", "predicted_midpoint"), ("audit", "included"))),
    Statement("accepted", "centers_of_ephemeris", f"""SELECT event_number, center FROM (SELECT event_number, median(try_cast(predicted_center AS double)) AS center FROM {{accepted}} GROUP BY event_number)
      CROSS JOIN (SELECT CAST({_json('s', _EPHEMERIS + '.refined_period_days')} AS double) AS period, CAST({_json('s', _EPHEMERIS + '.refined_transit_time')} AS double) AS epoch FROM {{summary}} s)
      WHERE NOT coalesce(abs(center - (epoch + try_cast(event_number AS double) * period)) <= 1e-8, false)""", ("accepted", "summary"), (("accepted", "predicted_center"), ("accepted", "event_number"))),
    Statement("accepted", "quarters_of_products", "SELECT DISTINCT a.product_id, a.quarter, p.quarter AS told FROM {accepted} a JOIN {products} p ON a.product_id = p.product_id WHERE NOT (a.quarter <=> p.quarter)", ("accepted", "products"), (("accepted", "quarter"), ("products", "quarter"), ("accepted", "product_id"), ("products", "product_id"))),
    Row("products", "positive_exposure", f"{finite('exposure_duration_days')} AND try_cast(exposure_duration_days AS double) > 0", ("exposure_duration_days",)),
    Statement("accepted", "exposures_of_products", "SELECT DISTINCT a.product_id, a.exposure_days, p.exposure_duration_days FROM {accepted} a JOIN {products} p ON a.product_id = p.product_id WHERE NOT coalesce(abs(try_cast(a.exposure_days AS double) - try_cast(p.exposure_duration_days AS double)) <= 1e-12, false)",
      ("accepted", "products"), (("accepted", "exposure_days"), ("products", "exposure_duration_days"), ("accepted", "product_id"), ("products", "product_id"))),
    Statement("summary", "residual_counts_of_products", """SELECT * FROM (SELECT product_id, count(*) AS n FROM {accepted} GROUP BY product_id) a FULL JOIN
      (SELECT x.product_id, x.cadence_count FROM (SELECT explode(from_json(get_json_object(value, '$.diagnostic_results.residual_summary.by_product'), 'array<struct<product_id: string, cadence_count: long>>')) AS x FROM {summary}) WHERE x.product_id IS NOT NULL AND x.cadence_count IS NOT NULL) s
      USING (product_id) WHERE NOT (n <=> cadence_count) AND (SELECT coalesce(max(get_json_object(value, '$.diagnostic_results.residual_summary.by_product')), '[]') FROM {summary}) <> '[]'""", ("accepted", "summary"), (("accepted", "product_id"),)),
    Statement("parameters", "has_timing_refinement", "SELECT 'global_timing_refinement' AS stage WHERE NOT EXISTS (SELECT 1 FROM {parameters} WHERE stage = 'global_timing_refinement')", ("parameters",), (("parameters", "stage"),)),
    *(Statement("parameters", f"refined_{c}_agrees", f"""SELECT {c}, told FROM (SELECT first({c}) AS {c} FROM {{parameters}} WHERE stage = 'global_timing_refinement') CROSS JOIN (SELECT {_json('s', '$.fitted_results.global_timing_refinement.' + c)} AS told FROM {{summary}} s)
      WHERE NOT coalesce(abs(try_cast({c} AS double) - try_cast(told AS double)) <= {1e-9 if c == 'objective_value' else 1e-12}, false)""", ("parameters", "summary"), (("parameters", "stage"), ("parameters", c))) for c in REFINED),
    Statement("configuration", "positive_supersample", f"SELECT value FROM {{configuration}} c WHERE NOT coalesce(CAST({_json('c', '$.supersample_factor')} AS int) > 0, false)", ("configuration",)),
    Statement("summary", "no_published_parameters", f"SELECT 1 AS leaked FROM {{summary}} s WHERE NOT ({_json('s', '$.acceptance_checks.published_physical_planet_parameters_used_or_compared')} <=> 'false')", ("summary",)),
    Statement("configuration", "configuration_of_provenance", f"""SELECT c.value FROM {{configuration}} c CROSS JOIN {{provenance}} p WHERE NOT ({_canonical("parse_json(c.value)")} <=> {_canonical("variant_get(parse_json(p.value), '$.phase1b.configuration', 'variant')")})""", ("configuration", "provenance")),
    Statement("phase1a", "record_of_provenance", f"""SELECT told, own FROM (SELECT {_canonical("variant_get(parse_json(p.value), '$.phase1b.phase1a_input_record', 'variant')")} AS told FROM {{provenance}} p) CROSS JOIN (SELECT max({_canonical("parse_json(value)")}) AS own FROM {{phase1a}}) WHERE NOT (nullif(told, 'null') <=> own)""", ("provenance", "phase1a")),
]


def read_frozen(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a snapshot's nine files: CSV columns as they are written, JSON files as one row with one column,
    value. The optional file, if missing, is an empty table; another that is missing is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"))
    if missing := [n for n in [*CSV_FILES.values(), *JSON_FILES.values()] if not there(n)]:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    csv = {t: spark.read.option("header", "true").option("inferSchema", "false").option("mode", "FAILFAST").csv(f"{folder}/{n}") for t, n in CSV_FILES.items()}
    whole_files = {t: spark.read.text(f"{folder}/{n}", wholetext=True) for t, n in JSON_FILES.items()}
    optional = {t: spark.read.text(f"{folder}/{n}", wholetext=True) if there(n) else spark.createDataFrame([], "value string") for t, n in OPTIONAL_FILES.items()}
    return csv | whole_files | optional


def frozen(spark: SparkSession, folder: str, rules: list | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot that keeps all rules; others are a ValueError that says which one breaks."""
    tables = read_frozen(spark, folder)
    required(report(spark, tables, SNAPSHOT_RULES if rules is None else rules))
    return tables
