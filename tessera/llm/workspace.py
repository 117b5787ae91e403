"""Shared, recoverable intermediates.

Every intermediate is a Parquet table below ``spark.checkpoint.dir`` - the one folder the driver and all executors
share - so a lost executor never takes data with it and lineage is cut at each table.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh temporary one only where the session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: bytes of an Arrow batch; the default of many MB is held by the JVM, off its heap, and by Python, per task and text column
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the session's Python stages by bytes; a longer row makes a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


class Workspace:
    """A folder of named tables that belongs to one call of one operator."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = small_batches(spark)
        self.root = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and read it back: later uses neither recompute nor depend on an executor."""
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Free tables that no result reads any more."""
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit; the folder is then the cluster's to clean
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: a key with more than this share of the rows is hot: at most so many keys are
HOT_KEYS = 256
#: rows of a narrow table that is broadcast; its size is counted first
FEW_ROWS = 50_000


def lookup(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` left-joined to ``found`` (unique by ``key``) without dealing a hot key's rows to one task.

    Keys with more than 1 / HOT_KEYS of the rows, fewer than HOT_KEYS of them by that bound, are counted first; what
    ``found`` says of them is broadcast.  The other rows are joined by key.  Both tables are read more than once: save
    them first.  Null keys find nothing.
    """
    times = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("times"))
    most = rows.count() // HOT_KEYS
    hot = times.where(F.col("times") > most).select(key)
    others = [c for c in found.columns if c != key]
    hit = hot.join(F.broadcast(found.join(F.broadcast(hot), key, "left_semi")), key, "left")
    marked = rows.join(F.broadcast(hit.select(key, F.struct(*others).alias("_found"))), key, "left")
    at_once = marked.where(f"_found is not null or {key} is null").select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in others))
    rest = marked.where(f"_found is null and {key} is not null").select(*rows.columns).join(found, key, "left").select(*rows.columns, *others)
    return at_once.unionByName(rest)


def few(df: DataFrame) -> DataFrame:
    """``df``, narrow and cheap to count, with a broadcast hint where it has at most ``FEW_ROWS`` rows."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
