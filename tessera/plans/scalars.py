"""Scalar functions: strings, numbers, types, dates and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import datetimes as D
from tessera.functions import json_functions as J
from tessera.functions import mathematics as M
from tessera.functions import strings as S
from tessera.functions import values as V
from tessera.plans.registry import frame


def _select(name: str, table: str, oracle: str | None, columns):
    def run(spark, d):
        return spark.read.parquet(f"{d}/{table}.parquet").select(*(x.alias(n) if not isinstance(x, str) else F.col(x) for n, x in columns().items()))

    frame(name, f"SELECT {oracle} FROM {table}" if oracle else None)(run)


c = F.col
_select("str_length", "part", "p_partkey, length(p_name) AS n, strlen(p_name) AS b", lambda: {"p_partkey": "p_partkey", "n": S.length(c("p_name")), "b": S.octet_length(c("p_name"))})
_select("str_substr", "part", "p_partkey, substr(p_name, 2, 3) AS a, substr(p_name, -3) AS b, substr(p_name, 0, 3) AS z, substr(p_name, -4, 2) AS m, substr(p_name, 2, 2) AS l",
        lambda: {"p_partkey": "p_partkey", "a": S.substr(c("p_name"), 2, 3), "b": S.substr(c("p_name"), -3), "z": S.substr(c("p_name"), 0, 3), "m": S.substr(c("p_name"), -4, 2), "l": S.substr(c("p_name"), 4, -2)})
_select("str_case", "documents", "doc_id, translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u, lower(source) AS l", lambda: {"doc_id": "doc_id", "u": S.upper(c("source")), "l": S.lower(c("source"))})
_select("str_trim", "part", "p_partkey, trim(p_brand, 'Bd') AS t, ltrim(p_brand, 'Bra') AS l, rtrim(p_brand, '0123456789') AS r, trim('  ' || p_brand || ' ') AS s",
        lambda: {"p_partkey": "p_partkey", "t": S.trim(c("p_brand"), "Bd"), "l": S.ltrim(c("p_brand"), "Bra"), "r": S.rtrim(c("p_brand"), "0123456789"), "s": S.trim(F.concat(F.lit("  "), c("p_brand"), F.lit(" ")))})
_select("str_replace_instr", "part", "p_partkey, replace(p_type, 'E', 'ee') AS r, instr(p_type, 'S') AS i, replace(p_type, '', 'x') AS e",
        lambda: {"p_partkey": "p_partkey", "r": S.replace(c("p_type"), "E", "ee"), "i": S.instr(c("p_type"), "S"), "e": S.replace(c("p_type"), "", "x")})
_select("str_concat", "documents", "doc_id, concat(nullif(lang, 'en'), source) AS c, concat_ws('-', nullif(lang, 'en'), source, doc_id::VARCHAR) AS w",
        lambda: {"doc_id": "doc_id", "c": S.concat(F.nullif(c("lang"), F.lit("en")), c("source")), "w": S.concat_ws("-", F.nullif(c("lang"), F.lit("en")), c("source"), c("doc_id"))})
_select("str_printf", "part", "p_partkey, printf('%05d|%s|%.2f|%x|%%', p_partkey, p_brand, p_retailprice, p_partkey) AS f", lambda: {"p_partkey": "p_partkey", "f": S.printf("%05d|%s|%.2f|%x|%%", c("p_partkey"), c("p_brand"), c("p_retailprice"), c("p_partkey"))})
_select("str_printf_quote", "documents", "doc_id, 'x=' || coalesce('''' || nullif(lang, 'en') || '''', 'NULL') AS q", lambda: {"doc_id": "doc_id", "q": S.printf("x=%Q", F.nullif(c("lang"), F.lit("en")))})
_select("str_like_escape", "orders", "o_orderkey, o_orderpriority ILIKE '1-u%' AS l, o_orderpriority LIKE '%!_%' ESCAPE '!' AS e", lambda: {"o_orderkey": "o_orderkey", "l": S.like(c("o_orderpriority"), "1-U%"), "e": S.like(c("o_orderpriority"), "%!_%", "!")})
_select("misc_typeof", "documents", "doc_id, CASE WHEN nullif(lang, 'en') IS NULL THEN 'null' ELSE 'text' END AS t, 'integer' AS i", lambda: {"doc_id": "doc_id", "t": V.type_name(F.nullif(c("lang"), F.lit("en")), "string"), "i": V.type_name(c("n_chars"), "bigint")})
_select("misc_quote", "documents", "doc_id, coalesce('''' || replace(nullif(lang, 'en'), '''', '''''') || '''', 'NULL') AS q, n_chars::VARCHAR AS n", lambda: {"doc_id": "doc_id", "q": V.quote(F.nullif(c("lang"), F.lit("en"))), "n": V.quote(c("n_chars"), "bigint")})
_select("misc_hex", "part", "p_partkey, hex(p_brand) AS h, hex(p_partkey::VARCHAR) AS n, decode(unhex(hex(p_brand))) AS u", lambda: {"p_partkey": "p_partkey", "h": V.hex_(c("p_brand")), "n": V.hex_(c("p_partkey")), "u": V.unhex(V.hex_(c("p_brand"))).cast("string")})
_select("misc_char_unicode", "part", "p_partkey, chr(8364) || chr(65) AS c, unicode(p_name)::BIGINT AS u", lambda: {"p_partkey": "p_partkey", "c": V.char(8364, 65), "u": V.unicode_(c("p_name"))})
_select("misc_zeroblob", "nation", "n_nationkey, octet_length(repeat('0', n_nationkey)::BLOB) AS n", lambda: {"n_nationkey": "n_nationkey", "n": F.octet_length(V.zeroblob(c("n_nationkey"))).cast("long")})
_select("math_basic", "customer", "c_custkey, abs(c_acctbal) AS a, CAST(sign(c_acctbal) AS BIGINT) AS s, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, trunc(c_acctbal) AS t, round(c_acctbal, 1) AS r",
        lambda: {"c_custkey": "c_custkey", "a": F.abs("c_acctbal"), "s": M.sign(c("c_acctbal")), "c": M.ceil(c("c_acctbal")), "f": M.floor(c("c_acctbal")), "t": M.trunc(c("c_acctbal")), "r": M.round_(c("c_acctbal"), 1)})
_select("math_min_max", "documents", "doc_id, CASE WHEN nullif(lang, 'en') IS NULL THEN NULL ELSE least(doc_id, n_chars) END AS lo, greatest(doc_id, n_chars) AS hi",
        lambda: {"doc_id": "doc_id", "lo": F.when(F.nullif(c("lang"), F.lit("en")).isNotNull(), M.least(c("doc_id"), c("n_chars"))), "hi": M.greatest(c("doc_id"), c("n_chars"))})
_select("math_log_exp", "part", "p_partkey, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS t, round(log2(p_size), 6) AS b, round(exp(p_size / 10.0::DOUBLE), 4) AS e, CASE WHEN p_size - 25 > 0 THEN round(ln(p_size - 25), 6) END AS g, round(ln(p_size) / ln(3), 6) AS k",
        lambda: {"p_partkey": "p_partkey", "l": F.round(M.ln(c("p_retailprice")), 6), "t": F.round(M.log10(c("p_retailprice")), 6), "b": F.round(M.log2(c("p_size")), 6), "e": F.round(F.exp(c("p_size") / 10.0), 4), "g": F.round(M.ln(c("p_size") - 25), 6), "k": F.round(M.log(3, c("p_size")), 6)})
_select("math_power", "customer", "c_custkey, round(pow(c_acctbal / 1000, 2), 6) AS p, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s, round(c_acctbal % 7.5::DOUBLE, 6) AS m",
        lambda: {"c_custkey": "c_custkey", "p": F.round(M.power(c("c_acctbal") / 1000, 2), 6), "s": F.round(M.sqrt(c("c_acctbal")), 6), "m": F.round(M.mod(c("c_acctbal"), F.lit(7.5)), 6)})
_TRIG = ("sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "asinh", "degrees", "radians")
_select("math_trigonometry", "nation", "n_nationkey, " + ", ".join(f"round({f}(n_nationkey / 10.0::DOUBLE), 6) AS {f}_" for f in _TRIG) + ", round(pi(), 8) AS pi_, round(atan2(n_nationkey, 3), 6) AS at2",
        lambda: {"n_nationkey": "n_nationkey", **{f"{f}_": F.round(getattr(F, f)(c("n_nationkey") / 10.0), 6) for f in _TRIG}, "pi_": F.round(F.pi(), 8), "at2": F.round(F.atan2(c("n_nationkey").cast("double"), F.lit(3.0)), 6)})
_select("math_inverse_domain", "nation", """n_nationkey, CASE WHEN n_nationkey <= 10 THEN round(asin(least(n_nationkey / 10.0::DOUBLE, 1)), 6) END AS s, CASE WHEN n_nationkey <= 10 THEN round(acos(least(n_nationkey / 10.0::DOUBLE, 1)), 6) END AS c,
        CASE WHEN n_nationkey >= 1 THEN round(acosh(greatest(n_nationkey, 1)), 6) END AS h, CASE WHEN n_nationkey < 10 THEN round(atanh(least(n_nationkey / 10.0::DOUBLE, 0.99)), 6) END AS t""",
        lambda: {"n_nationkey": "n_nationkey", "s": F.round(M.asin(c("n_nationkey") / 10.0), 6), "c": F.round(M.acos(c("n_nationkey") / 10.0), 6), "h": F.round(M.acosh(c("n_nationkey")), 6), "t": F.round(F.when(c("n_nationkey") < 10, M.atanh(c("n_nationkey") / 10.0)), 6)})
_select("math_integer_overflow", "nation", "n_nationkey, 9223372036854775807::DOUBLE + n_nationkey + 1 AS s", lambda: {"n_nationkey": "n_nationkey", "s": M.add(F.lit(9223372036854775807), c("n_nationkey").cast("long") + 1)})
_select("math_shift", "nation", "n_nationkey, n_nationkey::BIGINT << 3 AS l, n_nationkey::BIGINT >> 1 AS r, 0::BIGINT AS z", lambda: {"n_nationkey": "n_nationkey", "l": M.shift_left(c("n_nationkey"), 3), "r": M.shift_left(c("n_nationkey"), -1), "z": M.shift_left(c("n_nationkey"), 70)})
_select("date_render", "orders", "o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS dt", lambda: {"o_orderkey": "o_orderkey", "d": D.date(c("o_orderdate")), "t": D.time(c("o_orderdate")), "dt": D.datetime(c("o_orderdate"))})
_select("date_julian_epoch", "events", "event_id, round((epoch_us(ts) // 1000) / 86400000.0::DOUBLE + 2440587.5, 6) AS j, epoch_us(ts) // 1000000 AS e", lambda: {"event_id": "event_id", "j": F.round(D.julianday(c("ts")), 6), "e": D.unixepoch(c("ts"))})
_select("date_modifiers", "orders", """o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS y,
        strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS n""",
        lambda: {"o_orderkey": "o_orderkey", "a": D.date(c("o_orderdate"), "+10 days"), "m": D.date(c("o_orderdate"), "start of month"), "y": D.date(c("o_orderdate"), "start of year"), "n": D.datetime(c("o_orderdate"), "+90 minutes")})
_select("date_month_overflow", "orders", "o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + (day(o_orderdate) - 1) * INTERVAL 1 DAY, '%Y-%m-%d') AS n, strftime(date_trunc('day', o_orderdate) + ((7 - dayofweek(o_orderdate)) % 7) * INTERVAL 1 DAY, '%Y-%m-%d') AS w",
        lambda: {"o_orderkey": "o_orderkey", "n": D.date(c("o_orderdate"), "+1 month"), "w": D.date(c("o_orderdate"), "weekday 0")})
_select("date_strftime", "events", "event_id, strftime(ts, '%j|%d|%m|%Y|%H|%M|%S|%w|%U|%W|%p|%I|%%') AS s, strftime(ts, '%G-%V-%u') AS iso", lambda: {"event_id": "event_id", "s": D.strftime("%j|%d|%m|%Y|%H|%M|%S|%w|%U|%W|%p|%I|%%", c("ts")), "iso": D.strftime("%G-%V-%u", c("ts"))})
_select("json_extract", "events", "event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props ->> '$.k' AS t, CAST(props -> '$.k' AS VARCHAR) AS j", lambda: {"event_id": "event_id", "k": J.json_extract(c("props"), "$.k", "bigint"), "t": J.arrow_text(c("props"), "$.k"), "j": J.arrow(c("props"), "$.k")})
_select("json_valid_type", "events", "event_id, 1::BIGINT AS v, 'integer' AS t, 'object' AS o, 0::BIGINT AS n", lambda: {"event_id": "event_id", "v": J.json_valid(c("props")), "t": J.json_type(c("props"), "$.k"), "o": J.json_type(c("props")), "n": J.json_array_length(c("props"))})
_select("json_minify", "events", "event_id, replace(props, ' ', '') AS j, 0::BIGINT AS e", lambda: {"event_id": "event_id", "j": J.json(c("props")), "e": J.json_error_position(c("props"))})
_select("json_build", "nation", """n_nationkey, '[' || n_nationkey || ',' || n_regionkey || ']' AS a, '{"k":' || n_nationkey || ',"n":"' || n_name || '"}' AS o, '"' || n_name || '"' AS q""",
        lambda: {"n_nationkey": "n_nationkey", "a": J.json_array(c("n_nationkey"), c("n_regionkey")), "o": J.json_object(k=c("n_nationkey"), n=c("n_name")), "q": J.json_quote(c("n_name"))})
_select("json_edit", "events", """event_id, '{"k":' || (props ->> '$.k') || ',"new":1}' AS s, '{}' AS r, '{"k":7}' AS u, '{"k":' || (props ->> '$.k') || ',"z":true}' AS p, '{"k":' || (props ->> '$.k') || '}' AS i""",
        lambda: {"event_id": "event_id", "s": J.json_set(c("props"), "$.new", 1), "r": J.json_remove(c("props"), "$.k"), "u": J.json_replace(c("props"), "$.k", 7), "p": J.json_patch(c("props"), '{"z":true,"q":null}'), "i": J.json_insert(c("props"), "$.k", 9)})
_select("json_pretty", "events", """event_id, '{' || chr(10) || '    "k": ' || (props ->> '$.k') || chr(10) || '}' AS p""", lambda: {"event_id": "event_id", "p": J.json_pretty(c("props"))})
