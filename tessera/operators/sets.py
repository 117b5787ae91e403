"""Compound selects: equal precedence, left to right."""

from __future__ import annotations

from pyspark.sql import DataFrame

_OPERATORS = {"UNION ALL": DataFrame.unionAll, "UNION": lambda a, b: a.union(b).distinct(), "INTERSECT": DataFrame.intersect, "EXCEPT": DataFrame.subtract}


def compound(first: DataFrame, *rest: tuple[str, DataFrame]) -> DataFrame:
    out = first
    for operator, other in rest:
        if len(other.columns) != len(out.columns):
            raise ValueError("SELECTs to the left and right of a compound operator have different numbers of columns")
        out = _OPERATORS[operator](out, other.toDF(*out.columns))
    return out
