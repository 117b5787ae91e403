"""Window functions: ranking, navigation, and every frame kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.plans.registry import frame, sql


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice"), (F.col("o_orderkey") % 7).alias("g"))


_O = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderkey % 7 AS g FROM orders) o"
sql("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS rn FROM orders")
sql("win_rank", f"SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY g) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY g) AS BIGINT) AS dr FROM {_O}")
sql("win_distribution", f"SELECT o_orderkey, percent_rank() OVER (PARTITION BY o_custkey ORDER BY g) AS p, cume_dist() OVER (PARTITION BY o_custkey ORDER BY g) AS c FROM {_O}")
sql("win_ntile", "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS t FROM orders")
sql("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, 0.0D) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "SELECT o_orderkey, lag(o_totalprice) OVER w AS a, lead(o_totalprice, 2, 0.0) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
sql("win_first_last_nth", "SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER w AS l, nth_value(o_totalprice, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
sql("win_default_frame", f"SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY g) AS BIGINT) AS n, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY g), 2) AS s FROM {_O}")
sql("win_whole_partition", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 7) AS a, min(o_orderkey) OVER (PARTITION BY o_custkey) AS m FROM orders")
sql("win_rows", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m FROM orders")
sql("win_rows_unbounded_following", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m FROM orders")
sql("win_range_offset", f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY g RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM {_O}")
sql("win_string_agg", "SELECT n_nationkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) OVER (PARTITION BY n_regionkey) AS s FROM nation", "SELECT n_nationkey, string_agg(n_name, ',' ORDER BY n_name) OVER (PARTITION BY n_regionkey) AS s FROM nation")
sql("win_over_aggregate", "SELECT o_custkey, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_custkey")




@frame("win_groups", f"SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS m FROM {_O} WINDOW w AS (PARTITION BY o_custkey ORDER BY g GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def win_groups(spark, d):
    out = W.groups_frame(_orders(spark, d), ["o_custkey"], [F.col("g")], -1, 1, n=F.count(F.lit(1)), m=F.max("o_totalprice"))
    return out.select("o_orderkey", "n", "m")


@frame("win_exclude_current", f"SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY g, o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW), 2) AS s FROM {_O}")
def win_exclude_current(spark, d):
    out = W.excluding_sum(_orders(spark, d), ["o_custkey"], [F.col("g"), F.col("o_orderkey")], -2, 2, "o_totalprice", "CURRENT ROW", "s")
    return out.select("o_orderkey", F.round("s", 2).alias("s"))
