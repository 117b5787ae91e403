"""Connected components over a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace


def components(edges: DataFrame, ws: Workspace, label: str) -> DataFrame:
    """(node, component): component is the smallest node reachable over ``edges`` (a, b); nodes without edges are absent.

    Every round takes the smallest label among a node and its neighbours, then jumps to that label's own label, so a
    star settles in one round and a chain in a logarithmic number.  Each round is one saved table; the driver sees
    only a count.  An empty edge table gives an empty result; self loops and repeated edges change nothing.
    """
    both = ws.save(
        edges.select(F.col("a").alias("node"), F.col("b").alias("near"))
        .union(edges.select(F.col("b"), F.col("a")))
        .distinct(),
        f"{label}_edges",
    )
    labels = ws.save(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("low", "node").alias("component")), f"{label}_0")
    turn = 0
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("near"), F.col("component").alias("there")), "near")
            .groupBy("node")
            .agg(F.min("there").alias("there"))
        )
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "there").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("component").alias("root"))
        jumped = low.join(roots, "low").select("node", F.least("low", "root").alias("component"), (F.least("low", "root") != F.col("was")).alias("moved"))
        turn += 1
        after = ws.save(jumped, f"{label}_{turn}")
        moved = not after.where("moved").isEmpty()
        ws.drop(f"{label}_{turn - 1}")
        labels = after.select("node", "component")
        if not moved:
            ws.drop(f"{label}_edges")
            return labels
