"""Grouping rules beyond SQL: bare columns, totals, ordered and JSON aggregates, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bare(column: str, extremum: str, of: str, tie: str) -> Column:
    """A bare column beside one min or max: from the extremum's row, the first by ``tie`` where several tie."""
    key = F.struct(F.col(of), F.col(tie)) if extremum == "min" else F.struct(F.col(of), -F.col(tie))
    picked = F.min_by(column, key) if extremum == "min" else F.max_by(column, key)
    return picked


def total(x: Column) -> Column:
    """sum as a real; 0.0 for no rows."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def group_concat(x: Column, separator: str, order: Column) -> Column:
    held = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("k"), x.cast("string").alias("v")))))
    return F.when(F.count(x) > 0, F.array_join(F.transform(held, lambda e: e["v"]), separator))


def json_group_array(x: Column, order: Column) -> Column:
    held = F.array_sort(F.collect_list(F.struct(order.alias("k"), x.alias("v"))))
    return F.to_json(F.transform(held, lambda e: e["v"]), {"ignoreNullFields": "false"})


def json_group_object(k: Column, v: Column) -> Column:
    pairs = F.array_sort(F.collect_list(F.struct(k.cast("string").alias("k"), v.alias("v"))))
    return F.to_json(F.map_from_entries(pairs), {"ignoreNullFields": "false"})


def limit(df: DataFrame, count: int | None, offset: int = 0) -> DataFrame:
    """A negative count is no limit; a negative offset is zero."""
    if offset > 0:
        df = df.offset(offset)
    return df if count is None or count < 0 else df.limit(count)
