"""Recursive common table expressions that Spark's own form lacks: UNION with a seen set, and several arms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from tessera.session import shared_dir

#: rows that a recursion may make before it is an error
ROW_LIMIT = 1_000_000


def recursive_union(seeds: list[DataFrame], steps: list[Callable[[DataFrame], DataFrame]], distinct: bool = True, row_limit: int = ROW_LIMIT, enough: int | None = None) -> DataFrame:
    """Semi-naive fixpoint of the steps over the seeds; each round's lineage is cut by a reliable checkpoint.

    Rounds end early from ``enough`` rows on, for bodies with a LIMIT."""
    spark = seeds[0].sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    union = lambda parts: reduce(DataFrame.union, parts)
    frontier = union(seeds)
    frontier = (frontier.distinct() if distinct else frontier).checkpoint()
    found, total = frontier, frontier.count()
    while enough is None or total < enough:
        new = union([step(frontier) for step in steps])
        if distinct:
            new = new.distinct().subtract(found)
        frontier = new.checkpoint()
        n = frontier.count()
        if not n:
            return found
        total += n
        if total > row_limit:
            raise RuntimeError(f"recursion made more than {row_limit} rows")
        found = found.union(frontier)
    return found
