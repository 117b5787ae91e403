"""Scans, filters, joins, aggregation, sorting, set operations and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import values as V
from tessera.operators import grouping as G
from tessera.operators import sets
from tessera.plans.registry import frame, sql


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


sql("entry_revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY n_name ORDER BY revenue DESC, n_name LIMIT 10""")

# scans and sources
sql("scan_seq", "SELECT * FROM nation")
sql("scan_point", "SELECT * FROM orders WHERE o_orderkey = 7")
sql("scan_range", "SELECT * FROM orders WHERE o_orderkey BETWEEN 100 AND 200")
sql("scan_prefix_and_range", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_suppkey = 5 AND l_partkey > 50")
sql("scan_min_max", "SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
sql("scan_count", "SELECT count(*) AS n FROM lineitem")
sql("values_rows", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(x, y)")
sql("single_row", "SELECT 1 + 1 AS two, 'x' AS t")

# projection, predicates and expressions
sql("project_star_qualified", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
sql("project_alias", "SELECT o_orderkey AS k, o_totalprice * 2 AS twice FROM orders")
sql("expr_integer_arithmetic", "SELECT o_orderkey, o_orderkey + 3 AS a, o_orderkey - o_custkey AS s, o_orderkey * o_custkey AS m FROM orders")
sql("expr_integer_divide", "SELECT o_orderkey, o_orderkey div nullif(o_custkey % 5, 0) AS q, o_orderkey % nullif(o_custkey % 5, 0) AS r FROM orders",
    "SELECT o_orderkey, o_orderkey // nullif(o_custkey % 5, 0) AS q, o_orderkey % nullif(o_custkey % 5, 0) AS r FROM orders")
sql("expr_real_divide", "SELECT l_orderkey, l_linenumber, try_divide(l_extendedprice, l_discount) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS q FROM lineitem")
sql("expr_bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n, shiftleft(o_orderkey, 2) AS l, shiftright(o_orderkey, 1) AS r FROM orders",
    "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders")
sql("expr_concat", "SELECT n_name || '-' || CAST(n_nationkey AS STRING) AS t FROM nation", "SELECT n_name || '-' || CAST(n_nationkey AS VARCHAR) AS t FROM nation")
sql("expr_unary", "SELECT n_nationkey, -n_nationkey AS m, +n_nationkey AS p, CAST(NOT (n_nationkey > 5) AS INT) AS b FROM nation")
sql("expr_comparisons", "SELECT count_if(o_custkey < 50) AS lt, count_if(o_custkey <= 50) AS le, count_if(o_custkey = 50) AS eq, count_if(o_custkey <> 50) AS ne, count_if(o_custkey >= 50) AS ge FROM orders",
    "SELECT count(*) FILTER (o_custkey < 50) AS lt, count(*) FILTER (o_custkey <= 50) AS le, count(*) FILTER (o_custkey = 50) AS eq, count(*) FILTER (o_custkey <> 50) AS ne, count(*) FILTER (o_custkey >= 50) AS ge FROM orders")
sql("expr_is_distinct", "SELECT doc_id, nullif(lang, 'en') IS NOT DISTINCT FROM 'fr' AS same, nullif(lang, 'en') IS DISTINCT FROM 'fr' AS other FROM documents")
sql("expr_is_null", "SELECT doc_id FROM documents WHERE nullif(lang, 'en') IS NULL")
sql("expr_three_valued", "SELECT doc_id, (nullif(lang, 'en') = 'fr' AND n_chars > 500) AS a, (nullif(lang, 'en') = 'fr' OR n_chars > 500) AS o FROM documents")
sql("expr_between", "SELECT count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04 AND l_quantity NOT BETWEEN 10 AND 20")
sql("expr_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
sql("expr_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
sql("expr_not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region)")
sql("expr_row_value_in", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F')")


@frame("expr_row_value_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < 100 OR (l_partkey = 100 AND l_suppkey < 5)")
def row_compare(spark, d):
    t = _t(spark, d, "lineitem")
    return t.where(V.row_less([F.col("l_partkey"), F.col("l_suppkey")], [F.lit(100), F.lit(5)])).select("l_orderkey", "l_linenumber")


sql("expr_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)")
sql("expr_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
sql("expr_scalar_subquery", "SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) > 0 AS above FROM orders")
sql("expr_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS size, CASE p_size WHEN 1 THEN 'one' END AS one FROM part")
sql("expr_coalesce_nullif", "SELECT doc_id, coalesce(nullif(lang, 'en'), source) AS x, ifnull(nullif(source, 'src0'), 'none') AS y FROM documents")
sql("expr_like", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND p_brand NOT ILIKE '%3_'")






sql("expr_collate_nocase", "SELECT lower(o_orderpriority) AS p, count(*) AS n FROM orders WHERE o_orderpriority COLLATE UTF8_LCASE = '1-urgent' GROUP BY 1", "SELECT lower(o_orderpriority) AS p, count(*) AS n FROM orders WHERE lower(o_orderpriority) = '1-urgent' GROUP BY 1")

# joins
sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
sql("join_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
sql("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
sql("join_full", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a FULL JOIN supplier b ON a.n_nationkey = b.s_suppkey")
sql("join_full_theta", "SELECT r.r_regionkey AS r, n.n_nationkey AS n FROM region r FULL JOIN nation n ON r.r_regionkey > n.n_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql("join_using", "SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)")
sql("join_full_using", "SELECT doc_id, quality, lang FROM (SELECT doc_id * 2 AS doc_id, lang FROM documents) a FULL JOIN labels USING (doc_id)")
sql("join_natural", "SELECT * FROM (SELECT doc_id, lang FROM documents) NATURAL JOIN labels", "SELECT * FROM (SELECT doc_id, lang FROM documents) a NATURAL JOIN labels")
sql("join_parenthesised", "SELECT n_name, c_custkey, o_orderkey FROM nation LEFT JOIN (customer JOIN orders ON c_custkey = o_custkey) ON n_nationkey = c_nationkey")
sql("join_semi", "SELECT s_suppkey FROM supplier LEFT SEMI JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 49", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
sql("join_anti", "SELECT d.doc_id FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
sql("join_self_equi_count", "SELECT count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
sql("join_theta_range", "SELECT p.p_partkey, count(*) AS n FROM part p JOIN nation n ON p.p_size > n.n_nationkey * 2 GROUP BY p.p_partkey")
sql("join_five_way", """SELECT r_name, round(sum(l_extendedprice), 2) AS s FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey
JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY r_name""")

# aggregation
sql("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_empty", "SELECT count(*) AS n, sum(o_custkey) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
sql("agg_null_group", "SELECT nullif(lang, 'en') AS k, count(*) AS n, count(nullif(source, 'src0')) AS m FROM documents GROUP BY 1")
sql("agg_ordinal_alias", "SELECT o_orderstatus AS st, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY st, 2")
sql("agg_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5")
sql("agg_having_alone", "SELECT sum(p_size) AS s FROM part HAVING count(*) > 1", "SELECT CAST(sum(p_size) AS BIGINT) AS s FROM part HAVING count(*) > 1")
sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, sum(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag")
sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (WHERE o_orderstatus <> 'F') AS m FROM orders GROUP BY o_orderpriority")


@frame("agg_total", "SELECT n_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS t, coalesce(sum(CASE WHEN n_nationkey > 100 THEN n_nationkey END), 0)::DOUBLE AS z FROM nation GROUP BY n_regionkey")
def agg_total(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(G.total(F.col("n_nationkey")).alias("t"), G.total(F.when(F.col("n_nationkey") > 100, F.col("n_nationkey"))).alias("z"))




sql("agg_string_agg_desc", "SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")


@frame("agg_json_group_array", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS a FROM nation GROUP BY n_regionkey")
def agg_json_array(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(G.json_group_array(F.col("n_nationkey"), F.col("n_nationkey")).alias("a"))


@frame("agg_json_group_object", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
def agg_json_object(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(G.json_group_object(F.col("n_name"), F.col("n_nationkey")).alias("o"))




@frame("agg_bare_min", "SELECT n_regionkey, min(n_name) AS m, arg_min(n_nationkey, n_name) AS k FROM nation GROUP BY n_regionkey")
def agg_bare_min(spark, d):
    return _t(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("m"), G.bare("n_nationkey", "min", "n_name", "n_nationkey").alias("k"))


sql("agg_over_window", "SELECT k, sum(rn) AS s FROM (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) x GROUP BY k", "SELECT k, CAST(sum(rn) AS BIGINT) AS s FROM (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) x GROUP BY k")

# sorting, limits, distinct
sql("sort_nulls", "SELECT doc_id, nullif(lang, 'en') AS k FROM documents ORDER BY k ASC NULLS FIRST, doc_id DESC LIMIT 50")
sql("sort_nulls_last_desc", "SELECT doc_id, nullif(lang, 'en') AS k FROM documents ORDER BY k DESC NULLS LAST, doc_id LIMIT 50")
sql("sort_expression", "SELECT p_partkey FROM part ORDER BY p_size % 10, p_partkey LIMIT 30")
sql("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")


@frame("limit_negative", "SELECT n_nationkey FROM nation ORDER BY n_nationkey")
def limit_negative(spark, d):
    return G.limit(_t(spark, d, "nation").select("n_nationkey").orderBy("n_nationkey"), -1, -3)


sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
sql("distinct_null", "SELECT DISTINCT nullif(lang, 'en') AS k FROM documents")

# set operations
sql("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
sql("set_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
sql("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
sql("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")


@frame("set_chain_left", "SELECT * FROM ((SELECT c_custkey AS k FROM customer UNION SELECT o_orderkey FROM orders) INTERSECT SELECT s_suppkey FROM supplier) EXCEPT SELECT CAST(n_nationkey AS BIGINT) FROM nation")
def set_chain(spark, d):
    pick = lambda t, c: _t(spark, d, t).select(F.col(c).cast("long").alias("k"))
    return sets.compound(pick("customer", "c_custkey"), ("UNION", pick("orders", "o_orderkey")), ("INTERSECT", pick("supplier", "s_suppkey")), ("EXCEPT", pick("nation", "n_nationkey")))


sql("set_outer_order", "SELECT n_name AS x FROM nation UNION SELECT r_name FROM region ORDER BY x LIMIT 12")

# common table expressions and subqueries
sql("cte_shared", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000) SELECT a.o_custkey, count(*) AS n FROM big a JOIN big b ON a.o_custkey = b.o_custkey GROUP BY a.o_custkey")
sql("derived_table", "SELECT s, count(*) AS n FROM (SELECT o_custkey % 10 AS s FROM orders) x GROUP BY s")
sql("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c")
sql("correlated_group_max", "SELECT count(*) AS n FROM lineitem a WHERE a.l_quantity = (SELECT max(b.l_quantity) FROM lineitem b WHERE b.l_suppkey = a.l_suppkey)")
sql("correlated_two_levels", """SELECT c_custkey FROM customer c JOIN (SELECT o_custkey, max(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) x ON x.o_custkey = c.c_custkey WHERE q > 45""",
    "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 45 AND o.o_custkey = c.c_custkey))")
sql("correlated_in_order_by", "SELECT c_custkey FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) x ORDER BY n DESC, c_custkey LIMIT 15", "SELECT c_custkey FROM customer ORDER BY (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) DESC, c_custkey LIMIT 15")

# the five shapes of the baseline
sql("bench_point", "SELECT o_totalprice FROM orders WHERE o_orderkey = 500")
sql("bench_range_count", "SELECT count(*) AS n FROM lineitem WHERE l_partkey BETWEEN 100 AND 200")
sql("bench_self_join", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey")
sql("bench_group_by", "SELECT l_linenumber, count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY l_linenumber")
