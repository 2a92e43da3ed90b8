"""Typed equality filters on JSON metadata, and projections of it.

A filter matches only a JSON value of its own type: texts texts, booleans
booleans, numbers numbers of any kind by value. All filters must match. Rows
without metadata pass only when there are no filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FilterValue = str | bool | int | float


def matches(metadata: Column, name: str, value: FilterValue) -> Column:
    got = F.try_variant_get(F.try_parse_json(metadata), f"$.{name}", "variant")
    kind = F.schema_of_variant(got)
    if isinstance(value, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(got, "$", "boolean") == F.lit(value))
    elif isinstance(value, str):
        same = (kind == "STRING") & (F.try_variant_get(got, "$", "string") == F.lit(value))
    else:
        number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        same = number & (F.try_variant_get(got, "$", "double") == F.lit(float(value)))
    return F.coalesce(same, F.lit(False))


def all_match(metadata: Column, filters: dict[str, FilterValue] | None) -> Column:
    if not filters:
        return F.lit(True)
    return reduce(lambda a, b: a & b, [matches(metadata, k, v) for k, v in filters.items()])


def apply_filters(df: DataFrame, filters: dict[str, FilterValue] | None, metadata: str = "metadata") -> DataFrame:
    return df.where(all_match(F.col(metadata), filters)) if filters else df


def strip_metadata(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Nulls the metadata; citation and corpus type stay."""
    return df.withColumn(metadata, F.lit(None).cast("string"))
