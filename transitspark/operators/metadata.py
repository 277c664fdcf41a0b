"""What is known of a product, resolved by precedence from its metadata: exposure, identity, quarter, cadence.

products(target_id, meta: map<string, string>, cadence, ...) hold the header keys of each product as a map; a value that is
there but empty counts as there for exposures, and as missing for identities. Everything is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Exposure of a long cadence in seconds, where the metadata tell none; keys of identities and quarters, the first one
#: first; names of output values. Fixed values.
LONG_SECONDS = 1765.5
IDENTITY_KEYS = ("FILENAME", "filename", "FILE", "LABEL", "OBJECT")
QUARTER_KEYS = ("QUARTER", "quarter")
EXPOSURE = ("exposure_metadata_key", "exposure_raw_value", "exposure_conversion_formula", "exposure_duration_days", "exposure_fallback")


def header_maps(cards: DataFrame, *by: str) -> DataFrame:
    """(by, meta) of cards(by, hdu, at, key, value): the first value of each key as a map."""
    first = cards.where("key IS NOT NULL AND value IS NOT NULL").groupBy(*by, "key").agg(F.min_by("value", F.struct("hdu", "at")).alias("value"))
    return first.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("meta"))


def first_of(meta: Column, keys: tuple[str, ...], empty_counts: bool = True) -> Column:
    """The value of the first of some keys that the map has; null without any."""
    values = [F.try_element_at(meta, F.lit(k)) for k in keys]
    return F.coalesce(*(v if empty_counts else F.when(v != "", v) for v in values))


def exposures(products: DataFrame) -> DataFrame:
    """products with the five columns of EXPOSURE: the first rule whose keys are there decides. Integration time times
    frames, frame time times frames, the cadence interval, and for long cadences a documented value; where none holds,
    or a number cannot be read, the duration is null and the key and formula say nothing."""
    meta = F.col("meta")
    get = lambda k: F.try_element_at(meta, F.lit(k))
    number = lambda k: F.expr(f"try_cast(try_element_at(meta, '{k}') AS double)")
    has = lambda *k: F.forall(F.array(*map(F.lit, k)), lambda x: F.array_contains(F.map_keys(meta), x))
    pair = lambda a, b: (has(a, b), f"{a};{b}", F.concat(F.lit(f"{a}="), get(a), F.lit(f";{b}="), get(b)), f"{a}_seconds * {b} / 86400", number(a) * number(b) / 86400)
    rules = [
        (*pair("INT_TIME", "NUM_FRM"), ""), (*pair("FRAMETIM", "NUM_FRM"), "frame_time_used_when_integration_time_missing"),
        (has("TIMEDEL"), "TIMEDEL", number("TIMEDEL").cast("string"), "TIMEDEL_days", number("TIMEDEL"), "cadence_interval_used_when_integration_metadata_missing"),
        (F.lower("cadence").startswith("long"), "", F.lit(""), "1765.5 seconds / 86400", F.lit(LONG_SECONDS / 86400), "documented_kepler_long_cadence_integration_time"),
    ]
    ways = [F.struct(F.lit(key).alias("k"), raw.alias("r"), F.lit(formula).alias("f"), days.alias("d"), F.lit(fallback).alias("b")) for _, key, raw, formula, days, fallback in rules]
    chosen = F.coalesce(*(F.when(F.coalesce(holds, F.lit(False)), way) for (holds, *_), way in zip(rules, ways)))
    return products.withColumn("_way", chosen).select("*", *(F.col(f"_way.{x}").alias(n) for x, n in zip("krfdb", EXPOSURE))).drop("_way")


def identified(products: DataFrame, order: str) -> DataFrame:
    """products with product_index, numbered from 0 within the target by a column, product_id and quarter. product_id is
    the last part of the path that the first identity key with a value holds, or product_NN; a quarter that nothing tells is empty."""
    index = F.row_number().over(W.partitionBy("target_id").orderBy(order)) - 1
    named = first_of(F.col("meta"), IDENTITY_KEYS, empty_counts=False)
    base = F.element_at(F.split(F.rtrim(named, F.lit("/")), "/"), -1)
    df = products.withColumn("product_index", index)
    return df.withColumns({"product_id": F.coalesce(F.when(base != "", base), named, F.format_string("product_%02d", "product_index")), "quarter": F.coalesce(first_of(F.col("meta"), QUARTER_KEYS), F.lit(""))})


def mixed_cadences(products: DataFrame) -> DataFrame:
    """(target_id, cadences) of targets whose products are of more than one cadence, whatever the case of their names."""
    kinds = products.where(F.col("cadence").isNotNull()).groupBy("target_id").agg(F.array_sort(F.collect_set(F.lower("cadence"))).alias("cadences"))
    return kinds.where(F.size("cadences") > 1)


def require_one_cadence(products: DataFrame) -> None:
    """Raises a ValueError that names some targets of mixed cadences, or of products without an exposure."""
    if some := mixed_cadences(products).limit(5).collect():
        raise ValueError("mixed cadences: " + "; ".join(f"{r['target_id']}: {', '.join(r['cadences'])}" for r in some))
    if "exposure_duration_days" in products.columns and (some := products.where("exposure_duration_days IS NULL").select("target_id", "product_id").limit(5).collect()):
        raise ValueError("no exposure is known of " + ", ".join(f"{r['target_id']}/{r['product_id']}" for r in some))


def labelled(observations: DataFrame, products: DataFrame, mission: str, flux_product: str) -> DataFrame:
    """observations(target_id, product_id, ...) with quarter, cadence, exposure_days, mission and flux_product of their
    products, as made by `identified` and `exposures`. An observation of an unknown product has none and stays."""
    told = products.select("target_id", "product_id", "quarter", "cadence", F.col("exposure_duration_days").alias("exposure_days"))
    return observations.join(told, ["target_id", "product_id"], "left").withColumns({"mission": F.lit(mission), "flux_product": F.lit(flux_product)})


def without_products(observations: DataFrame, flux_product: str) -> DataFrame:
    """observations that no product is known of, with the labels of a stitched or made-up series."""
    name = F.lit("synthetic_or_stitched")
    return observations.withColumns({"product_id": name, "quarter": F.lit(""), "cadence": F.lit("long"), "exposure_days": F.lit(LONG_SECONDS / 86400), "mission": name, "flux_product": F.lit(flux_product)})


def product_rows(cadences: DataFrame, products: DataFrame, mission: str, flux_product: str) -> DataFrame:
    """A row per product: what it is, how its exposure was found, and its cadences, all and finite; 0 without any."""
    ok = F.col("time").isNotNull() & F.col("flux").isNotNull() & ~F.isnan("time") & ~F.isnan("flux") & (F.abs("time") < float("inf")) & (F.abs("flux") < float("inf"))
    counts = cadences.groupBy("target_id", "product_id").agg(F.count("*").alias("input_cadence_count"), F.count_if(ok).alias("finite_cadence_count"))
    df = products.join(counts, ["target_id", "product_id"], "left").na.fill(0, ["input_cadence_count", "finite_cadence_count"])
    return df.select("target_id", "product_index", "product_id", "quarter", "cadence", F.lit(mission).alias("mission"), F.lit(flux_product).alias("flux_product"), "input_cadence_count", "finite_cadence_count", *EXPOSURE)
