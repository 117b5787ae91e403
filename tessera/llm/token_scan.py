"""Token counts from flat, unindexed token files by a separator scan.

A file is nothing but big-endian 16-bit ids, each document closed by a separator id beyond the vocabulary.  Files are
read in byte ranges, each a task's, and blocks of a range are searched for separators with one vector comparison each;
what a document has in earlier blocks is found by a prefix scan over the blocks' last separators, so a document may start
in one block and end many blocks, ranges and tasks later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.tokens import PieceTokenizer
from tessera.llm.workspace import Workspace, table

#: beyond every vocabulary of up to 49,792 ids; its two bytes are U+0080 in UTF-8, so the text writer can end records with it
SEPARATOR, BLOCK, PER_FILE = 0xC280, 1 << 18, 3000
#: bytes of a range; stores whose ranges workers can open by themselves (of others, files are read whole by Spark)
RANGE, STORES = 1 << 24, ("file", "hdfs", "s3", "gs")


def _flat(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer.of(path)
        if len(tokenizer.closes) > SEPARATOR:
            raise ValueError(f"ids of this vocabulary reach the separator {SEPARATOR}")
        for batch in batches:
            for _, ids, offsets in tokenizer.encode(batch.column(0)):
                raw = ids.astype(">u2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[2 * a : 2 * b - 2] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())], names=["ids"])
        K.release()

    return run


def write_flat(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Flat token files below ``path``; null and empty texts are documents of no ids."""
    rows = docs.select("text").mapInArrow(_flat(tokenizer_path), "ids binary").select(F.col("ids").cast("string").alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\u0080").option("maxRecordsPerFile", PER_FILE).text(path)


def _ends(content, at: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position of its first id, positions of separators) of the blocks of some bytes that begin at id ``at``."""
    ids = np.frombuffer(content, ">u2", len(content) // 2)
    for low in range(0, len(ids), size):
        yield at + low, np.flatnonzero(ids[low : low + size] == SEPARATOR) + (at + low)


def _blocks(size: int, ranged: bool):
    def content(batch: pa.RecordBatch, i: int):
        if not ranged:
            return batch.column(3)[i].as_buffer()
        store, path = fs.FileSystem.from_uri(batch.column(0)[i].as_py())
        with store.open_input_file(path) as f:
            return f.read_at(batch.column(2)[i].as_py(), batch.column(1)[i].as_py())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                for block, ends in _ends(content(batch, i), batch.column(1)[i].as_py() // 2, size):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "block", "ends"])
        K.release()

    return run


def scan(ws: Workspace, path: str, block: int = BLOCK, width: int = RANGE) -> DataFrame:
    """Per document: file, doc (its number there, from 0), start (id position), n_tokens (without the separator).

    Ids after a file's last separator belong to no document; empty files and folders have none.
    """
    files = ws.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    ranged = path.split(":", 1)[0] in STORES
    if ranged:
        own = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.explode(F.expr(f"CASE WHEN length > 0 THEN sequence(0L, length - 1, {width}L) END")).alias("at"))
        files = own.select("path", "at", F.lit(width).cast("long").alias("size"))
        files = files.repartition(max(1, files.count()), "path", "at")
    else:
        files = files.select("path", F.lit(0).cast("long").alias("at"), F.col("length").alias("size"), "content")
    found = ws.save(files.mapInArrow(_blocks(block, ranged), "file string, block long, ends array<long>"), "ends")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = found.select("file", "block", F.array_max("ends").alias("last"), F.size("ends").alias("n"))
    carried = narrow.select("file", "block", F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    each = found.where("size(ends) > 0").join(carried, ["file", "block"]).select("file", "before", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.expr("ends[greatest(k - 1, 0)]")) + 1
    return each.select("file", (F.col("before") + F.col("k")).alias("doc"), start.alias("start"), (F.col("end") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, part and start - the write's part and the id position there.

    Null and empty texts have no tokens; repeated rows and null ids count each; an empty table has no rows; other columns
    are ignored.  The files hold no ids: a document is known again by its place, part and number, in the table, which has
    to be read alike each time, as files are.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    write_flat(docs, tokenizer_path, ws.path("flat"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("long")
    counted = scan(ws, ws.path("flat")).withColumn("part", number(r"^part-(\d+)-"))
    placed = counted.select((F.col("part") * (1 << 33) + number(r"-c(\d+)\.") * PER_FILE + F.col("doc")).alias("place"), "n_tokens", F.col("part").cast("int").alias("part"), "start")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("place"))
    return named.join(placed, "place").select("doc_id", "n_tokens", "part", "start")


def query(spark, sf_dir):
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
