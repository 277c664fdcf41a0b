"""Reports as files that other programs read: strict JSON lines, and one CSV table of rows with different columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strict(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column) & (F.abs(column) < float("inf")), column)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: _strict(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda k, v: _strict(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(_strict(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))
    return column


def without_non_finite(df: DataFrame) -> DataFrame:
    """df with null for every number that is not finite, however deep in arrays, maps and structs it lies: JSON has no
    word for them."""
    return df.select(*(_strict(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as lines of JSON that any reader takes; nulls are written."""
    without_non_finite(df).write.option("ignoreNullFields", "false").mode("overwrite").json(folder)


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of several tables under all their columns, in the order in which they are first seen; null where a table
    lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(frames: list[DataFrame], folder: str) -> None:
    """Rows of several tables as one CSV file with one header. For reports: they pass one task, as one file must."""
    union_of(frames).coalesce(1).write.option("header", "true").option("emptyValue", "").mode("overwrite").csv(folder)
