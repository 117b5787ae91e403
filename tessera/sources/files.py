"""File sources and sinks: Parquet with pushdown; CSV and JSON with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
