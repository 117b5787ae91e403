"""Queries that go the whole way: the dialect's text through ``Database``, beside the SQL that checks it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tessera.facade import Database
from tessera.plans.registry import register
from tessera.session import views


def _run(script: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, script)
    return Database(spark).query(script)


def dialect(name: str, script: str, oracle: str | None = None) -> None:
    register(name, partial(_run, script), oracle or script)


_W = "PARTITION BY o_custkey ORDER BY o_orderdate"
_O = "(SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 7 AS g FROM orders) o"

# projection, predicates, expressions
dialect("filter_numeric_truth", "SELECT p_partkey FROM part WHERE p_size % 7", "SELECT p_partkey FROM part WHERE p_size % 7 <> 0")
dialect("expr_literals", "SELECT 0x1F AS h, 1_000 AS u, X'6162' AS b, 'it''s' AS s, 1e2 AS e, .5 AS p, NULL AS z, TRUE AS t", "SELECT 31 AS h, 1000 AS u, 'ab'::BLOB AS b, 'it''s' AS s, 100.0::DOUBLE AS e, 0.5::DOUBLE AS p, NULL AS z, 1 AS t")
dialect("expr_iif", "SELECT o_orderkey, iif(o_totalprice > 1000, 'high', 'low') AS a, iif(o_custkey % 3, 1, 0) AS b FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN 'high' ELSE 'low' END AS a, CASE WHEN o_custkey % 3 <> 0 THEN 1 ELSE 0 END AS b FROM orders")
dialect("expr_divide_by_zero", "SELECT o_orderkey, o_orderkey / (o_custkey % 5) AS q, o_orderkey % (o_custkey % 5) AS r, o_totalprice / (o_custkey % 5) AS f FROM orders",
        "SELECT o_orderkey, o_orderkey // nullif(o_custkey % 5, 0) AS q, o_orderkey % nullif(o_custkey % 5, 0) AS r, o_totalprice / nullif(o_custkey % 5, 0) AS f FROM orders")
dialect("expr_bits", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS o, ~o_orderkey AS n, o_orderkey << 2 AS l, o_orderkey >> 1 AS r FROM orders")
dialect("expr_cast_prefix", "SELECT n_nationkey, CAST(n_nationkey || 'abc' AS INTEGER) AS i, CAST(n_nationkey || '.5x' AS REAL) AS r, CAST(n_name AS INTEGER) AS z, CAST(n_nationkey AS TEXT) AS t FROM nation",
        "SELECT n_nationkey, n_nationkey AS i, n_nationkey + 0.5::DOUBLE AS r, 0 AS z, n_nationkey::VARCHAR AS t FROM nation")
dialect("expr_is", "SELECT o_orderkey, o_orderstatus IS 'F' AS a, o_orderstatus IS NOT 'F' AS b, o_orderkey IS NOT NULL AS c, NULL IS NULL AS d FROM orders",
        "SELECT o_orderkey, (o_orderstatus IS NOT DISTINCT FROM 'F')::INT AS a, (o_orderstatus IS DISTINCT FROM 'F')::INT AS b, 1 AS c, 1 AS d FROM orders")
dialect("expr_row_compare", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_custkey) < ('O', 50) AND (o_orderkey, o_custkey) <> (7, 1)", "SELECT o_orderkey FROM orders WHERE (o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_custkey < 50)) AND NOT (o_orderkey = 7 AND o_custkey = 1)")
dialect("expr_glob", "SELECT n_name FROM nation WHERE n_name GLOB 'N*[1-3]' AND n_name NOT GLOB '*_1?'", "SELECT n_name FROM nation WHERE n_name GLOB 'N*[1-3]' AND NOT n_name GLOB '*_1?'")
dialect("expr_like_ascii", "SELECT n_name, n_name LIKE 'nation\\_1%' ESCAPE '\\' AS a, 'É' LIKE 'é' AS b, like('n%', n_name) AS c FROM nation", "SELECT n_name, (n_name ILIKE 'nation\\_1%' ESCAPE '\\')::INT AS a, 0 AS b, (n_name ILIKE 'n%')::INT AS c FROM nation")
dialect("expr_collate", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'f' COLLATE NOCASE", "SELECT o_orderkey FROM orders WHERE lower(o_orderstatus) = 'f'")
dialect("expr_storage_class", "SELECT n_nationkey, 1 = '1' AS a, 1 < 'a' AS b, n_nationkey = '3' AS c FROM nation", "SELECT n_nationkey, 0 AS a, 1 AS b, (n_nationkey = 3)::INT AS c FROM nation")
dialect("expr_in_table_function", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT CAST(value AS INTEGER) FROM json_each('[1, 3, 99]'))", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 3)")
dialect("expr_scalar_first_row", "SELECT r_regionkey, (SELECT n_name FROM nation ORDER BY n_nationkey DESC) AS last FROM region", "SELECT r_regionkey, (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1) AS last FROM region")
dialect("expr_empty_in", "SELECT n_nationkey, n_nationkey IN () AS a, n_nationkey NOT IN () AS b FROM nation", "SELECT n_nationkey, 0 AS a, 1 AS b FROM nation")
dialect("project_output_names", "SELECT count(*), max(n_nationkey) + 1 FROM nation", 'SELECT count(*) AS "count(*)", max(n_nationkey) + 1 AS "max(n_nationkey) + 1" FROM nation')

# joins, aggregates, compounds, recursion
dialect("join_null_keys", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON nullif(c.c_custkey % 50, 7) = nullif(o.o_custkey % 50, 9) AND c.c_custkey = o.o_custkey", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_custkey % 50 NOT IN (7, 9)")
dialect("agg_implicit_order", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
dialect("agg_bare_max", "SELECT o_custkey, max(o_totalprice) AS m, o_orderkey FROM orders GROUP BY o_custkey", "SELECT o_custkey, max(o_totalprice) AS m, arg_max(o_orderkey, o_totalprice) AS o_orderkey FROM orders GROUP BY o_custkey")
dialect("agg_bare_first", "SELECT n_regionkey, count(*) AS n, n_regionkey * 10 AS t, r_name FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey", "SELECT n_regionkey, count(*) AS n, n_regionkey * 10 AS t, any_value(r_name) AS r_name FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey")
dialect("agg_group_concat", "SELECT n_regionkey, group_concat(n_name, '-' ORDER BY n_name DESC) AS a, string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 4) AS b FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '-' ORDER BY n_name DESC) AS a, string_agg(n_name, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey > 4) AS b FROM nation GROUP BY n_regionkey")
dialect("agg_total_nested", "SELECT o_custkey % 10 AS k, total((o_orderkey + (1)) * 2) AS t, total(NULL) AS z FROM orders GROUP BY 1", "SELECT o_custkey % 10 AS k, sum((o_orderkey + 1) * 2)::DOUBLE AS t, 0.0::DOUBLE AS z FROM orders GROUP BY 1")
dialect("agg_json_arrays", "SELECT n_regionkey, json_group_array(n_nationkey ORDER BY n_nationkey) AS a, json_group_object(n_nationkey, n_name ORDER BY n_nationkey) AS o FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS a, '{' || string_agg('\"' || n_nationkey || '\":\"' || n_name || '\"', ',' ORDER BY n_nationkey) || '}' AS o FROM nation GROUP BY n_regionkey")
dialect("set_chain_left_to_right", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 1 EXCEPT SELECT 3", "(SELECT DISTINCT r_regionkey AS k FROM region WHERE r_regionkey > 1 AND r_regionkey <> 3)")
dialect("cte_recursive_union_sql", "WITH RECURSIVE r(n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT (n * 7 + 2) % 25 FROM r) SELECT n FROM r", "WITH RECURSIVE r(n) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 3 UNION SELECT (n * 7 + 2) % 25 FROM r) SELECT n FROM r")
dialect("cte_recursive_arms", "WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT 2 UNION SELECT (k * 3) % 25 FROM r UNION SELECT (k + 5) % 25 FROM r) SELECT k FROM r",
        "WITH RECURSIVE r(k) AS (SELECT w FROM (VALUES (1), (2)) s(w) UNION SELECT CASE w WHEN 0 THEN (k * 3) % 25 ELSE (k + 5) % 25 END FROM r, (VALUES (0), (1)) v(w)) SELECT k FROM r")
dialect("cte_recursive_limit", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t LIMIT 40) SELECT count(*) AS n, max(n) AS m FROM t", "SELECT 40 AS n, 40 AS m")

# windows
dialect("win_rank_no_order", "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) AS r, dense_rank() OVER () AS d FROM nation", "SELECT n_nationkey, rank() OVER (PARTITION BY n_regionkey) AS r, dense_rank() OVER () AS d FROM nation")
dialect("win_row_number_no_order", "SELECT max(r) AS m, count(DISTINCT r) AS n FROM (SELECT row_number() OVER () AS r FROM orders)", "SELECT count(*) AS m, count(*) AS n FROM orders")
dialect("win_named_chained", "SELECT o_orderkey, count(*) OVER w2 AS n, count(*) OVER (w2 ROWS 1 PRECEDING) AS m FROM orders WINDOW w1 AS (PARTITION BY o_custkey), w2 AS (w1 ORDER BY o_orderkey)",
        "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 1 PRECEDING) AS m FROM orders")
dialect("win_partition_nocase", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus COLLATE NOCASE) AS n FROM orders", "SELECT o_orderkey, count(*) OVER (PARTITION BY lower(o_orderstatus)) AS n FROM orders")
dialect("win_lag_default", "SELECT o_orderkey, lag(o_orderkey, 1, -o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders", "SELECT o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -o_custkey) AS a FROM orders")
dialect("win_filter", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, sum(o_orderkey) FILTER (WHERE o_orderkey % 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders",
        "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, sum(o_orderkey) FILTER (WHERE o_orderkey % 2 <> 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders")
dialect("win_total_json", "SELECT n_nationkey, total(n_nationkey) OVER (PARTITION BY n_regionkey) AS t FROM nation", "SELECT n_nationkey, sum(n_nationkey) OVER (PARTITION BY n_regionkey)::DOUBLE AS t FROM nation")
for _name, _frame in {
    "win_groups_sql": "GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING", "win_groups_current": "GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING",
    "win_exclude_group": "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE GROUP", "win_exclude_ties": "GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE TIES",
    "win_exclude_no_others": "RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE NO OTHERS", "win_exclude_current_all": "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW",
    "win_exclude_whole_group": "RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE GROUP", "win_exclude_whole_ties": "GROUPS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES",
    "win_exclude_groups_group": "GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP",
}.items():
    _order = "g, o_orderkey" if _frame.startswith("ROWS") else "g"
    _text = f"SELECT o_orderkey, count(*) OVER w AS n, sum(o_orderkey) OVER w AS s, min(o_orderkey) OVER w AS lo FROM {_O} WINDOW w AS (PARTITION BY o_custkey ORDER BY {_order} {_frame})"
    dialect(_name, _text)
dialect("win_exclude_first_last", f"SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM {_O} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW)")

# scalars
dialect("scalar_strings_sql", "SELECT n_nationkey, upper(n_name || 'éa') AS u, lower('ÀB' || n_name) AS l, substr(n_name, 0, 3) AS a, substr(n_name, -2) AS b, substr(n_name, 3, -2) AS c, length(n_name) AS n, trim('  ' || n_name || ' ') AS t, instr(n_name, '_') AS i, replace(n_name, 'N', 'm') AS r, concat(n_name, NULL, 1) AS k, concat_ws('-', n_name, NULL, 'z') AS w FROM nation",
        "SELECT n_nationkey, upper(n_name) || 'éA' AS u, 'À' || lower('B' || n_name) AS l, n_name[1:2] AS a, n_name[-2:] AS b, n_name[1:2] AS c, length(n_name) AS n, n_name AS t, instr(n_name, '_') AS i, replace(n_name, 'N', 'm') AS r, n_name || '1' AS k, n_name || '-z' AS w FROM nation")
dialect("scalar_types_sql", "SELECT n_nationkey, typeof(n_nationkey) AS a, typeof(n_name) AS b, typeof(NULL) AS c, typeof(n_nationkey * 1.5) AS d, quote(n_name || '''') AS q, quote(n_nationkey) AS r, quote(NULL) AS s, hex('ab') AS h, char(72, 105) AS i, unicode(n_name) AS u FROM nation",
        "SELECT n_nationkey, 'integer' AS a, 'text' AS b, 'null' AS c, 'real' AS d, '''' || n_name || '''''''' AS q, n_nationkey::VARCHAR AS r, 'NULL' AS s, '6162' AS h, 'Hi' AS i, unicode(n_name) AS u FROM nation")
dialect("misc_likely", "SELECT n_nationkey, likely(n_regionkey) AS a, unlikely(n_name) AS b, likelihood(n_nationkey, 0.5) AS c FROM nation", "SELECT n_nationkey, n_regionkey AS a, n_name AS b, n_nationkey AS c FROM nation")
dialect("misc_random", "SELECT n_nationkey, length(randomblob(n_nationkey)) AS n, typeof(randomblob(3)) AS b, typeof(random()) AS t, length(zeroblob(5)) AS z FROM nation", "SELECT n_nationkey, greatest(n_nationkey, 1) AS n, 'blob' AS b, 'integer' AS t, 5 AS z FROM nation")
dialect("scalar_math_sql", "SELECT n_nationkey, max(n_nationkey, 10) AS a, min(n_nationkey, n_regionkey, 3) AS b, max(1, NULL) AS c, round(n_nationkey / 7.0, 2) AS d, log(100) AS e, log(2, 8) AS f, sqrt(-1) AS g, mod(n_nationkey, 3) AS h, sign(n_nationkey - 3) AS i, ceil(n_nationkey / 2.0) AS j, trunc(-1.5) AS k, ln(0) AS m FROM nation",
        "SELECT n_nationkey, greatest(n_nationkey, 10) AS a, least(n_nationkey, n_regionkey, 3) AS b, NULL AS c, round(n_nationkey / 7.0::DOUBLE, 2) AS d, 2.0::DOUBLE AS e, 3.0::DOUBLE AS f, NULL AS g, (n_nationkey % 3)::DOUBLE AS h, sign(n_nationkey - 3) AS i, ceil(n_nationkey / 2.0::DOUBLE) AS j, -1.0::DOUBLE AS k, NULL AS m FROM nation")
dialect("scalar_printf_sql", "SELECT n_nationkey, printf('%05d|%-12s|%.2f|%x|%q|%%|%c', n_nationkey, n_name, n_nationkey / 4.0, n_nationkey + 250, 'a''b', 'xyz') AS p FROM nation",
        "SELECT n_nationkey, lpad(n_nationkey::VARCHAR, 5, '0') || '|' || rpad(n_name, 12, ' ') || '|' || printf('%.2f', n_nationkey / 4.0::DOUBLE) || '|' || lower(hex(n_nationkey + 250)) || '|a''''b|%|x' AS p FROM nation")
dialect("date_values_sql", "SELECT o_orderkey, date(o_orderdate, '+1 month') AS a, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS b, datetime(o_orderdate, '+36 hours') AS c, strftime('%Y/%m/%d %j %w', o_orderdate) AS d, unixepoch(o_orderdate) AS u, julianday(o_orderdate) AS j FROM orders",
        "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days((day(o_orderdate) - 1)::INT), '%Y-%m-%d') AS a, strftime(last_day(o_orderdate), '%Y-%m-%d') AS b, strftime(o_orderdate + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS c, strftime(o_orderdate, '%Y/%m/%d %j %w') AS d, epoch(o_orderdate)::BIGINT AS u, julian(o_orderdate)::DOUBLE - 0.5 AS j FROM orders")
dialect("date_strings_sql", "SELECT n_nationkey, date('2024-01-' || substr('0' || (n_nationkey + 1), -2), '+1 month') AS a, time('10:20:30', '+90 minutes') AS b, datetime('2024-01-01T10:00:00+02:00') AS c, date(2451545) AS d, datetime(86400, 'unixepoch') AS e, date('bogus') AS f, date('2024-02-15', 'weekday 0') AS g FROM nation",
        "SELECT n_nationkey, strftime(DATE '2024-02-01' + n_nationkey::INT, '%Y-%m-%d') AS a, '11:50:30' AS b, '2024-01-01 08:00:00' AS c, '2000-01-01' AS d, '1970-01-02 00:00:00' AS e, NULL AS f, '2024-02-18' AS g FROM nation")
dialect("date_timediff", "SELECT o_orderkey, timediff(o_orderdate, date(o_orderdate, 'start of month')) AS a, timediff('2024-03-31', '2024-02-29') AS b, timediff('2023-02-15', '2023-03-15 01:02:03.5') AS c, timediff(o_orderdate, o_orderdate) AS d FROM orders",
        "SELECT o_orderkey, '+0000-00-' || lpad((day(o_orderdate) - 1)::VARCHAR, 2, '0') || strftime(o_orderdate, ' %H:%M:%S.%g') AS a, '+0000-01-02 00:00:00.000' AS b, '-0000-01-00 01:02:03.500' AS c, '+0000-00-00 00:00:00.000' AS d FROM orders")
dialect("json_scalars_sql", "SELECT event_id, json_extract(props, '$.k') AS a, props ->> '$.k' AS b, props -> 'k' AS c, json_type(props) AS d, json_type(props, '$.k') AS e, json_valid(props) AS f, json_array_length('[1,2,' || event_id || ']') AS g, json_array(event_id, 'x', NULL, json('[1]')) AS h, json_object('k', event_id) AS i, json_set('{}', '$.a', event_id) AS j, json_remove('[1,2,3]', '$[1]') AS m FROM events",
        "SELECT event_id, props ->> '$.k' AS a, props ->> '$.k' AS b, (props -> '$.k')::VARCHAR AS c, 'object' AS d, 'integer' AS e, 1 AS f, 3 AS g, '[' || event_id || ',\"x\",null,[1]]' AS h, '{\"k\":' || event_id || '}' AS i, '{\"a\":' || event_id || '}' AS j, '[1,3]' AS m FROM events")
dialect("json_tree", "SELECT event_id, j.fullkey, j.type FROM events, json_tree(props) j", "SELECT event_id, '$' AS fullkey, 'object' AS type FROM events UNION ALL SELECT event_id, '$.k', 'integer' FROM events")

# statements that change things
_N = "(SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region FROM nation)"
_MADE = "CREATE TABLE st(id INTEGER PRIMARY KEY, name TEXT NOT NULL, region INT DEFAULT 9, CHECK (region < 100)); INSERT INTO st SELECT n_nationkey, n_name, n_regionkey FROM nation; "
dialect("view_inlined", "CREATE VIEW late_nations AS SELECT * FROM nation WHERE n_nationkey > 4; SELECT n_regionkey, count(*) AS n FROM late_nations GROUP BY n_regionkey", "SELECT n_regionkey, count(*) AS n FROM nation WHERE n_nationkey > 4 GROUP BY n_regionkey")
dialect("generated_columns", "CREATE TABLE gen(a INT, b TEXT, c AS (a * 2), d TEXT GENERATED ALWAYS AS (b || '!') STORED); INSERT INTO gen SELECT n_nationkey, n_name FROM nation; SELECT a, c, d FROM gen", "SELECT n_nationkey AS a, n_nationkey * 2 AS c, n_name || '!' AS d FROM nation")
dialect("ctas_and_sink", "CREATE TABLE made AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey; SELECT * FROM made", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
dialect("dml_insert_defaults", _MADE + "INSERT INTO st(name) VALUES ('x'), ('y'); SELECT * FROM st", f"SELECT * FROM {_N} UNION ALL SELECT * FROM (VALUES (25::BIGINT, 'x', 9::BIGINT), (26, 'y', 9))")
dialect("dml_insert_policies", _MADE + "INSERT OR IGNORE INTO st VALUES (1, 'no', 0), (100, NULL, 1), (101, 'in', 1); INSERT OR REPLACE INTO st VALUES (2, 'new', 5); SELECT * FROM st", f"SELECT * FROM {_N} WHERE id <> 2 UNION ALL SELECT * FROM (VALUES (2::BIGINT, 'new', 5::BIGINT), (101, 'in', 1))")
dialect("dml_update_returning", _MADE + "UPDATE st SET region = region + 10, name = name || '!' WHERE region IN (SELECT max(r_regionkey) FROM region) RETURNING id, name || region AS shown", "SELECT n_nationkey AS id, n_name || '!' || (n_regionkey + 10) AS shown FROM nation WHERE n_regionkey = 4")
dialect("dml_update_from_sql", _MADE + "UPDATE st SET name = r_name FROM region WHERE r_regionkey = st.region AND r_regionkey < 3; SELECT * FROM st", "SELECT n_nationkey AS id, coalesce(r_name, n_name) AS name, n_regionkey AS region FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
dialect("dml_delete_returning", _MADE + "DELETE FROM st WHERE region = 1 RETURNING id * 2 AS twice, name || '-gone' AS gone", "SELECT n_nationkey * 2 AS twice, n_name || '-gone' AS gone FROM nation WHERE n_regionkey = 1")
dialect("dml_upsert_clauses", _MADE + "CREATE UNIQUE INDEX st_name ON st(name); INSERT INTO st SELECT n_nationkey, 'n' || n_nationkey, 50 FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 300, n_name, 60 FROM nation WHERE n_nationkey = 5 ON CONFLICT(id) DO UPDATE SET region = region + excluded.region WHERE excluded.id > 0 ON CONFLICT(name) DO UPDATE SET region = 77; SELECT * FROM st",
        f"SELECT id, name, CASE WHEN id IN (1, 2) THEN region + 50 WHEN id = 5 THEN 77 ELSE region END AS region FROM {_N}")
dialect("dml_with_cte", _MADE + "WITH big AS (SELECT id FROM st WHERE region > 2) DELETE FROM st WHERE id IN (SELECT id FROM big); SELECT * FROM st", f"SELECT * FROM {_N} WHERE region <= 2")
dialect("txn_savepoint", _MADE + "BEGIN; DELETE FROM st WHERE region = 0; SAVEPOINT s; DELETE FROM st; ROLLBACK TO s; RELEASE s; COMMIT; SELECT * FROM st", f"SELECT * FROM {_N} WHERE region <> 0")
dialect("alter_table", _MADE + "ALTER TABLE st RENAME COLUMN name TO title; ALTER TABLE st ADD COLUMN extra TEXT DEFAULT 'e'; ALTER TABLE st ADD COLUMN spare INT; ALTER TABLE st DROP COLUMN spare; ALTER TABLE st RENAME TO st2; SELECT * FROM st2", "SELECT n_nationkey AS id, n_name AS title, n_regionkey AS region, 'e' AS extra FROM nation")
dialect("fk_update_cascade", "PRAGMA foreign_keys = ON; CREATE TABLE par(id INTEGER PRIMARY KEY); INSERT INTO par SELECT r_regionkey FROM region; CREATE TABLE kid(id INTEGER PRIMARY KEY, p INT REFERENCES par(id) ON UPDATE CASCADE ON DELETE SET NULL); INSERT INTO kid SELECT n_nationkey, n_regionkey FROM nation; UPDATE par SET id = id + 100 WHERE id < 2; DELETE FROM par WHERE id = 3; SELECT * FROM kid",
        "SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 WHEN n_regionkey <> 3 THEN n_regionkey END AS p FROM nation")
dialect("fk_deferred", "PRAGMA foreign_keys = ON; CREATE TABLE par(id INTEGER PRIMARY KEY); CREATE TABLE kid(p INT REFERENCES par(id) DEFERRABLE INITIALLY DEFERRED); BEGIN; INSERT INTO kid SELECT n_regionkey FROM nation; INSERT INTO par SELECT r_regionkey FROM region; COMMIT; SELECT p, count(*) AS n FROM kid GROUP BY p", "SELECT n_regionkey AS p, count(*) AS n FROM nation GROUP BY 1")
dialect("trigger_sql", _MADE + "CREATE TABLE audit(was INT, now INT); CREATE TRIGGER tr AFTER UPDATE OF region ON st WHEN OLD.region <> NEW.region BEGIN INSERT INTO audit VALUES (OLD.region, NEW.region); END; UPDATE st SET region = region * 2; SELECT was, now, count(*) AS n FROM audit GROUP BY was, now", "SELECT n_regionkey AS was, n_regionkey * 2 AS now, count(*) AS n FROM nation WHERE n_regionkey > 0 GROUP BY 1, 2")
dialect("trigger_instead_of", _MADE + "CREATE VIEW v AS SELECT id, name FROM st WHERE region = 1; CREATE TRIGGER iv INSTEAD OF UPDATE ON v BEGIN UPDATE st SET name = NEW.name || '?' WHERE id = OLD.id; END; UPDATE v SET name = 'z'; SELECT * FROM st", f"SELECT id, CASE WHEN region = 1 THEN 'z?' ELSE name END AS name, region FROM {_N}")
dialect("autoincrement", "CREATE TABLE au(id INTEGER PRIMARY KEY AUTOINCREMENT, x INT); INSERT INTO au(x) SELECT n_nationkey FROM nation; DELETE FROM au; INSERT INTO au(x) VALUES (1); SELECT id, x FROM au", "SELECT 26 AS id, 1 AS x")
dialect("catalog_pragmas", _MADE + "CREATE UNIQUE INDEX ix ON st(name) WHERE region > 90; SELECT 'c' AS kind, name FROM pragma_table_info('st') UNION ALL SELECT 'i', name FROM pragma_index_list('st') UNION ALL SELECT type, name FROM sqlite_schema", "SELECT * FROM (VALUES ('c', 'id'), ('c', 'name'), ('c', 'region'), ('i', 'ix'), ('table', 'st'), ('index', 'ix')) v(kind, name)")
dialect("changes_counts", _MADE + "DELETE FROM st WHERE region < 2; SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS l", "SELECT count(*) FILTER (WHERE n_regionkey < 2) AS c, count(*) + count(*) FILTER (WHERE n_regionkey < 2) AS t, max(n_nationkey) AS l FROM nation")
dialect("recursive_trigger_flag", "PRAGMA recursive_triggers = ON; PRAGMA recursive_triggers", "SELECT 1 AS recursive_triggers")
dialect("integrity_check", _MADE + "PRAGMA integrity_check", "SELECT 'ok' AS integrity_check")
dialect("trigger_raise_ignore", _MADE + "CREATE TRIGGER keep BEFORE INSERT ON st BEGIN SELECT RAISE(IGNORE) WHERE NEW.region > 50; END; INSERT INTO st VALUES (200, 'out', 60), (201, 'in', 5); SELECT * FROM st", f"SELECT * FROM {_N} UNION ALL SELECT 201::BIGINT, 'in', 5::BIGINT")
dialect("index_expression_unique", _MADE + "CREATE UNIQUE INDEX ue ON st(lower(name)); INSERT OR IGNORE INTO st SELECT n_nationkey, n_name, 1 FROM nation; SELECT count(*) AS n FROM st", "SELECT count(*) AS n FROM nation")
dialect("without_rowid", "CREATE TABLE wr(a TEXT, b INT, PRIMARY KEY(a, b)) WITHOUT ROWID; INSERT INTO wr SELECT n_name, n_regionkey FROM nation; INSERT OR REPLACE INTO wr VALUES ('NATION_1', 1); DELETE FROM wr WHERE b = 0; SELECT * FROM wr", "SELECT n_name AS a, n_regionkey AS b FROM nation WHERE n_regionkey <> 0")
dialect("dml_update_policy", _MADE + "CREATE UNIQUE INDEX un ON st(name); UPDATE OR IGNORE st SET name = 'NATION_1' WHERE id = 2; UPDATE OR REPLACE st SET name = 'NATION_3' WHERE id = 4; SELECT * FROM st", f"SELECT id, CASE id WHEN 4 THEN 'NATION_3' ELSE name END AS name, region FROM {_N} WHERE id <> 3")
dialect("dml_column_list_subquery", _MADE + "UPDATE st SET (name, region) = (SELECT r_name, r_regionkey + 20 FROM region WHERE r_regionkey = st.region) WHERE id < 10; SELECT * FROM st", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN r_name ELSE n_name END AS name, CASE WHEN n_nationkey < 10 THEN n_regionkey + 20 ELSE n_regionkey END AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
dialect("fk_list_pragma", "CREATE TABLE par(id INTEGER PRIMARY KEY); CREATE TABLE kid(p INT REFERENCES par(id) ON DELETE CASCADE); PRAGMA foreign_key_list(kid)", "SELECT 0 AS id, 0 AS seq, 'par' AS \"table\", 'p' AS \"from\", 'id' AS \"to\", 'NO ACTION' AS on_update, 'CASCADE' AS on_delete, 'NONE' AS match")
