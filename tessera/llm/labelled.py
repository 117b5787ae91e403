"""The training fold shared by the learned operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3))


def sample(docs: DataFrame, labels: DataFrame, target: str, most: dict[int, int]) -> DataFrame:
    """(text, label) of a bounded, reproducible sample of labelled rows outside the held-out fold.

    ``most`` bounds the rows of each label; they are those with the smallest hash of the id.  Ids with contradictory
    labels, null ids and null labels teach nothing.
    """
    clean = labels.select("doc_id", F.col(target).alias("label")).where("doc_id is not null and label in (0, 1)").where(fold() != 1)
    clean = clean.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.max("label").alias("other")).where("label = other")
    picked = None
    for label, n in most.items():
        own = clean.where(F.col("label") == label).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = own if picked is None else picked.union(own)
    found = docs.select(F.col("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("text", "label")
    out = None
    for label, n in most.items():  # ids that several rows of docs share must not lift the bound
        own = found.where(F.col("label") == label).orderBy(F.xxhash64("text"), "text").limit(n)
        out = own if out is None else out.union(own)
    return out
