"""Bulk-synchronous best-fit packing of tokenised documents into sequences.

Documents are cut into pieces of at most one sequence; pieces of one length are exchangeable, so what a sweep needs of
them is a sorted table length -> count, at most ``capacity`` rows whatever the corpus.  Gaps are kept the same way, size
-> sequences.  A round takes the longest length left, finds its successor among the gaps (the smallest that holds it),
lets as many pieces have those gaps, by rank, as there are, updates the gaps, and repeats; what finds no gap opens
sequences.  Rounds hold one length, so no two lengths conflict at a gap.  Every placed run of ranks is one row of a plan,
and the pieces find their row by length and rank.

Ranks are distributed: within (length, salt) by a window, plus the counts of the salts before, so no length - not even
that of a third of all pieces - is one task's.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.tokens import PieceTokenizer
from tessera.llm.workspace import Workspace, partitions, table

CAPACITY = 4096


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, step, offset): rank r of the row lies in sequence
    first + (r - first rank) * step at that offset.  Best-fit decreasing on classes of equal length and equal gap."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs of sequence numbers (first, how many)
    sizes: list[int] = []  # ascending keys of gaps
    rows, opened = [], 0

    def give_back(size: int, first: int, many: int) -> None:
        if size:
            if size not in gaps:
                gaps[size] = []
                bisect.insort(sizes, size)
            gaps[size].append((first, many))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                size = sizes[at]
                first, many = gaps[size].pop()
                used = min(many, left)
                if many > used:
                    gaps[size].append((first + used, many - used))
                if not gaps[size]:
                    del gaps[size], sizes[at]
            else:  # full sequences of this length, one over the other, and a last one with the rest
                size, fit = capacity, capacity // length
                first, used = opened, max(1, left // fit)
                opened += used
            rows.append((length, rank, used, first, 1, capacity - size))
            give_back(size - length, first, used)
            rank, left = rank + used, left - used
    return rows


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer.of(path)
        for batch in batches:
            for low, ids, offsets in tokenizer.encode(batch.column(1)):
                sizes = np.diff(offsets)
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[row] - start)
                at = offsets[row] + start
                raw = ids.astype("<u4", copy=False)
                codes = [zlib.crc32(raw[i : i + m]) for i, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(low + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(codes, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        K.release()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each text's ids end with one separator, so null and empty texts make a piece of one id.  Rows are packed each,
    repeated ones and null ids included; other columns are ignored.  An empty table packs into nothing.
    """
    if not 0 < capacity < 1 << 16:
        raise ValueError("a capacity of 1 to 65535 ids")
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    salts = 4 * partitions(spark)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer_path, capacity), schema)
    cut = ws.save(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    by_salt = ws.save(cut.groupBy("length", "salt").agg(F.count("*").alias("held")), "counts")
    before = by_salt.select("length", "salt", F.coalesce(F.sum("held").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    counts = dict(by_salt.groupBy("length").agg(F.sum("held")).collect())  # at most one row per length
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    rows = spark.sparkContext.broadcast(rows[np.lexsort((rows[:, 1], rows[:, 0]))])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_places(rows), f"{schema}, sequence_id long, offset long")


def _places(rows):
    """Each piece's place: the plan's last row of its length that begins at or before its rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rows.value
        begins = table[:, 0] << 40 | table[:, 1]  # lengths below 2**23, ranks below 2**40
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            own = table[np.searchsorted(begins, length << 40 | rank, side="right") - 1]
            sequence = own[:, 3] + (rank - own[:, 1]) * own[:, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(own[:, 5])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def query(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
