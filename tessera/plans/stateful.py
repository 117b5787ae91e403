"""Recursion, table functions, catalog rows and changes."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from tessera.functions import json_functions as J
from tessera.operators.recursion import recursive_union
from tessera.plans.registry import frame
from tessera.store import Store


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ready(spark):
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tessera-"))


@frame("cte_recursive_count", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 60) SELECT n, n * n AS sq FROM t")
def recursive_count(spark, d):
    return spark.sql("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 60) SELECT n, n * n AS sq FROM t")


@frame("cte_recursive_union", "WITH RECURSIVE r(k) AS (SELECT 1::BIGINT UNION SELECT CASE w WHEN 0 THEN (k * 3) % 25 ELSE (k + 5) % 25 END FROM r, (VALUES (0), (1)) v(w)) SELECT k FROM r")
def recursive_distinct(spark, d):
    _ready(spark)
    seed = spark.createDataFrame([(1,)], "k long")
    return recursive_union([seed], [lambda f: f.select(((F.col("k") * 3) % 25).alias("k")), lambda f: f.select(((F.col("k") + 5) % 25).alias("k"))])


@frame("cte_recursive_reach", "WITH RECURSIVE r(n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT e.b FROM r JOIN (SELECT n_nationkey AS a, (n_nationkey * 7 + 2) % 25 AS b FROM nation) e ON e.a = r.n) SELECT n FROM r")
def recursive_reach(spark, d):
    _ready(spark)
    nation = _t(spark, d, "nation")
    edges = nation.select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 2) % 25).alias("b"))
    return recursive_union([nation.where("n_nationkey = 3").select(F.col("n_nationkey").alias("n"))], [lambda f: f.join(edges, f["n"] == edges["a"]).select(F.col("b").alias("n"))])




@frame("json_each", "SELECT event_id, 'k' AS key, props ->> '$.k' AS value, 'integer' AS type FROM events")
def json_each(spark, d):
    _t(spark, d, "events").createOrReplaceTempView("events")
    J.register(spark)
    return spark.sql("SELECT event_id, j.key, j.value, j.type FROM events, LATERAL json_each(props) j")




def _store(spark, d, **constraints) -> Store:
    _ready(spark)
    store = Store(spark)
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))
    store.create("stored_nation", nation, key=("id",), **constraints)
    return store


_N = "(SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation)"


@frame("dml_insert_ignore", f"SELECT * FROM {_N} UNION ALL SELECT 100::BIGINT, 'x', 9::BIGINT")
def dml_insert(spark, d):
    s = _store(spark, d)
    s.insert("stored_nation", spark.createDataFrame([(1, "dup", 0), (100, "x", 9), (100, "y", 8)], "id long, name string, region long").coalesce(1), "IGNORE")
    return s.table("stored_nation")


@frame("dml_insert_replace", f"SELECT * FROM {_N} WHERE id <> 1 UNION ALL SELECT 1::BIGINT, 'new', 7::BIGINT")
def dml_replace(spark, d):
    s = _store(spark, d)
    s.insert("stored_nation", spark.createDataFrame([(1, "new", 7)], "id long, name string, region long"), "REPLACE")
    return s.table("stored_nation")


@frame("dml_update", f"SELECT id, CASE WHEN region = 2 THEN name || '!' ELSE name END AS name, CASE WHEN region = 2 THEN id ELSE region END AS region FROM {_N}")
def dml_update(spark, d):
    s = _store(spark, d)
    s.update("stored_nation", {"name": F.concat("name", F.lit("!")), "region": F.col("id")}, F.col("region") == 2)
    return s.table("stored_nation")


@frame("dml_update_from", f"SELECT id, r_name AS name, region FROM {_N} JOIN region ON r_regionkey = region")
def dml_update_from(spark, d):
    s = _store(spark, d)
    s.update_from("stored_nation", _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("region"), "r_name"), ["region"], {"name": "r_name"})
    return s.table("stored_nation")




@frame("dml_upsert", f"SELECT id, name, CASE WHEN id = 2 THEN region + 30 ELSE region END AS region FROM {_N} UNION ALL SELECT 50::BIGINT, 'n', 12::BIGINT")
def dml_upsert(spark, d):
    s = _store(spark, d)
    rows = spark.createDataFrame([(2, "a", 10, 0), (2, "b", 20, 1), (50, "n", 5, 2), (50, "m", 7, 3)], "id long, name string, region long, at int")
    s.upsert("stored_nation", rows, ["id"], {"region": "t.region + excluded.region"}, "at")
    return s.table("stored_nation")


@frame("txn_rollback", f"SELECT * FROM {_N}")
def txn(spark, d):
    s = _store(spark, d)
    s.begin()
    s.delete("stored_nation", F.col("id") > 3)
    s.rollback()
    return s.table("stored_nation")


@frame("fk_cascade", "SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation WHERE n_regionkey <> 2")
def fk_cascade(spark, d):
    s = _store(spark, d, references=(("region", "stored_region", "id", "CASCADE"),))
    s.create("stored_region", _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"), "r_name"), key=("id",))
    s.foreign_keys = True
    s.delete("stored_region", F.col("id") == 2)
    return s.table("stored_nation")


@frame("trigger_log", f"SELECT id AS gone FROM {_N} WHERE region = 4")
def trigger(spark, d):
    s = _store(spark, d)
    s.create("log", "gone long")
    seen = []
    s.on("stored_nation", "DELETE", lambda store, row: seen.append((row["id"],)))
    s.delete("stored_nation", F.col("region") == 4)
    s.insert("log", spark.createDataFrame(seen, "gone long"))
    return s.table("log")


@frame("catalog_table_info", "SELECT * FROM (VALUES (0, 'id', 'bigint', 0, NULL::VARCHAR, 1), (1, 'name', 'string', 0, NULL, 0), (2, 'region', 'bigint', 0, NULL, 0)) v(cid, name, type, \"notnull\", dflt_value, pk)")
def table_info(spark, d):
    return _store(spark, d).table_info("stored_nation")


