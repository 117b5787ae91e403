"""Window frames that Spark's grammar lacks: GROUPS, and EXCLUDE in any frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, **aggregates) -> DataFrame:
    """Aggregates over a GROUPS frame: a dense rank numbers the peer groups, and a RANGE over it counts them.

    One shuffle: both windows share their partitioning.
    """
    by = Window.partitionBy(*partition)
    ranked = df.withColumn("_group", F.dense_rank().over(by.orderBy(*order)))
    frame = by.orderBy("_group").rangeBetween(start, end)
    return ranked.select(*df.columns, *(x.over(frame).alias(name) for name, x in aggregates.items()))


def excluding_sum(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, value: str, exclude: str, name: str) -> DataFrame:
    """sum(value) over a ROWS frame without the current row, its peer group or its ties.

    The current row is subtracted arithmetically.  Over a whole partition peers are too: their sum is a window over the
    partition and the peer group, which needs no further shuffle.  Under other bounds a frame's values are held, so these
    are for bounded frames.
    """
    by = Window.partitionBy(*partition).orderBy(*order)
    rows = by.rowsBetween(start, end)
    numbered = df.withColumn("_row", F.row_number().over(by)).withColumn("_group", F.dense_rank().over(by)).withColumn("_frame", F.sum(value).over(rows)).withColumn("_held", F.count(value).over(rows))
    own = F.coalesce(F.col(value), F.lit(0)) if start <= 0 <= end else F.lit(0)
    own_n = F.col(value).isNotNull().cast("int") if start <= 0 <= end else F.lit(0)
    if exclude == "CURRENT ROW":
        out, n = own, own_n
    elif start <= Window.unboundedPreceding and end >= Window.unboundedFollowing:
        group = Window.partitionBy(*partition, "_group")
        held, number = F.coalesce(F.sum(value).over(group), F.lit(0)), F.count(value).over(group)
        out, n = (held, number) if exclude == "GROUP" else (held - own, number - own_n)
    else:
        listed = F.collect_list(F.struct("_row", "_group", F.col(value).alias("v"))).over(rows)
        peers = F.filter(listed, lambda e: (e["_group"] == F.col("_group")) & e["v"].isNotNull() & ((e["_row"] != F.col("_row")) if exclude == "TIES" else F.lit(True)))
        numbered = numbered.withColumn("_peers", peers)
        out = F.aggregate("_peers", F.lit(0).cast("double"), lambda a, e: a + e["v"])
        n = F.size("_peers")
    return numbered.select(*df.columns, F.when(F.col("_held") - n > 0, F.col("_frame") - out).alias(name))


def excluding(df: DataFrame, partition: list[str], order: list[Column], start: int, end: int, value: str, exclude: str, fold, name: str) -> DataFrame:
    """Any fold (array of values -> column) over a ROWS frame with exclusion; holds a frame's values, so for bounded frames."""
    by = Window.partitionBy(*partition).orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(by)).withColumn("_group", F.dense_rank().over(by))
    listed = F.collect_list(F.struct("_row", "_group", F.col(value).alias("v"))).over(by.rowsBetween(start, end))
    held = numbered.withColumn("_listed", listed)
    keep = {
        "NO OTHERS": lambda e: F.lit(True),
        "CURRENT ROW": lambda e: e["_row"] != F.col("_row"),
        "GROUP": lambda e: e["_group"] != F.col("_group"),
        "TIES": lambda e: (e["_group"] != F.col("_group")) | (e["_row"] == F.col("_row")),
    }[exclude]
    values = F.filter(F.transform(F.filter("_listed", keep), lambda e: e["v"]), lambda v: v.isNotNull())
    kept = held.withColumn("_values", values)
    return kept.select(*df.columns, F.when(F.size("_values") > 0, fold(F.col("_values"))).alias(name))


def filtered(aggregate, condition: Column, value: Column, window) -> Column:
    """aggregate(value) FILTER (WHERE condition) OVER window."""
    return aggregate(F.when(condition, value)).over(window)
