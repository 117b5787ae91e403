import pytest
from pyspark.sql import functions as F

from tessera.facade import Database, rewrite, split
from tessera.functions import datetimes as D
from tessera.functions import json_functions as J
from tessera.functions import mathematics as M
from tessera.functions import strings as S
from tessera.functions import values as V
from tessera.operators.recursion import recursive_union
from tessera.store import ConstraintError


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_affinity():
    assert [V.affinity(x) for x in ("BIGINT", "VARCHAR(3)", "BLOB", "", "DOUBLE", "DECIMAL")] == ["INTEGER", "TEXT", "BLOB", "BLOB", "REAL", "NUMERIC"]


@pytest.mark.parametrize(("start", "size", "want"), [(0, 3, "he"), (2, 3, "ell"), (-3, None, "llo"), (4, -2, "el"), (-10, 8, "hel"), (9, 2, "")])
def test_substr(spark, start, size, want):
    assert one(spark, S.substr(F.lit("hello"), start, size)) == want


def test_functions(spark):
    lit = F.lit
    assert one(spark, V.cast_integer(lit(" 12abc"))) == 12 and one(spark, V.cast_real(lit("1.5e2x"))) == 150.0
    assert one(spark, V.cast_integer(lit("x"))) == 0
    assert one(spark, M.divide(lit(-7), lit(2))) == -3 and one(spark, M.divide(lit(1), lit(0))) is None
    assert one(spark, M.greatest(lit(1), lit(None).cast("int"))) is None
    assert one(spark, S.upper(lit("éa"))) == "éA" and one(spark, S.glob(lit("a[b"), "a[[]b"))
    assert one(spark, S.printf("%05.1f|%Q|%5s|%-4d|", lit(2.25), lit("it's"), lit("x"), lit(7))) in ("002.3|'it''s'|    x|7   |", "002.2|'it''s'|    x|7   |")
    assert one(spark, D.date(lit("2023-01-31").cast("timestamp"), "+1 month")) == "2023-03-03"
    assert one(spark, D.julianday(lit("2000-01-01 12:00:00").cast("timestamp"))) == 2451545.0
    assert one(spark, D.timediff(lit("2023-02-15 10:00:00").cast("timestamp"), lit("2022-01-10 09:30:00").cast("timestamp"))) == "+0001-01-05 00:30:00.000"


def test_json():
    assert J.render(J.parse("{a:1.50,'b':[+1,.5,],}")) == '{"a":1.50,"b":[1,0.5]}'
    assert J.error_position('{"a":1') == 7 and J.error_position("[1]") == 0
    assert J.edit('{"a":[1,2]}', "$.a[#]", J.Number("3"), True, True) == '{"a":[1,2,3]}'
    assert J.remove('{"a":1,"b":2}', "$.a") == '{"b":2}'
    assert J.render(J.merge_patch(J.parse('{"a":1,"b":{"c":2}}'), J.parse('{"a":null,"b":{"d":3}}'))) == '{"b":{"c":2,"d":3}}'
    assert [r[6] for r in J.each('{"a":[1,{"b":null}]}', deep=True)] == ["$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b"]


def test_rewrite():
    assert rewrite("SELECT a == 'x==y' LIMIT 2, 5") == "SELECT a = 'x==y' LIMIT 5 OFFSET 2"
    assert split("SELECT ';'; SELECT 2;") == ["SELECT ';'", "SELECT 2"]


def test_recursive_union(spark):
    edges = spark.createDataFrame([(i, (i + 1) % 7) for i in range(7)], "a long, b long")
    out = recursive_union([spark.createDataFrame([(0,)], "n long")], [lambda f: f.join(edges, f["n"] == edges["a"]).select(F.col("b").alias("n"))])
    assert sorted(r.n for r in out.collect()) == list(range(7))


def test_database(spark):
    db = Database(spark)
    db.execute("CREATE TABLE word (w TEXT PRIMARY KEY, n INTEGER DEFAULT 1 CHECK (n > 0), up AS (upper(w)))")
    db.execute("INSERT INTO word(w, n) VALUES ('a', 1), ('b', 2); INSERT OR IGNORE INTO word(w, n) VALUES ('a', 9)")
    db.execute("INSERT INTO word(w, n) VALUES ('a', 5) ON CONFLICT (w) DO UPDATE SET n = n + excluded.n")
    assert [tuple(r) for r in db.query("SELECT w, n, up FROM word ORDER BY w").collect()] == [("a", 6, "A"), ("b", 2, "B")]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO word(w, n) VALUES ('c', -1)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO word(w) VALUES ('a')")
    db.execute("BEGIN; DELETE FROM word WHERE w == 'a'; ROLLBACK")
    assert db.query("SELECT total(n) AS t FROM word").first().t == 8.0
    assert [tuple(r) for r in db.query("UPDATE word SET n = n * 10 WHERE w = 'b' RETURNING w, n").collect()] == [("b", 20)]
