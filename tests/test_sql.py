"""The dialect's statements through Database: parsed, bound, spelled as Spark SQL, run."""

import pytest

from tessera.facade import Database, SqlError
from tessera.session import views
from tessera.sql import calls, emit
from tessera.sql.lexer import statements, tokens
from tessera.store import ConstraintError

SF = "/root/testdata/sf0.001"
QUERIES = [
    ("SELECT typeof(1), typeof(1.5), typeof('a'), typeof(NULL), typeof(x'00')", [('integer', 'real', 'text', 'null', 'blob')]),
    ("SELECT quote('a''b'), quote(NULL), quote(3), quote(x'ab')", [("'a''b'", 'NULL', '3', "X'AB'")]),
    ("SELECT upper('éa'), lower('ÉA')", [('éA', 'Éa')]),
    ("SELECT substr('hello',0,3), substr('hello',-3,2), substr('hello',2), substr('hello',3,-2)", [('he', 'll', 'ello', 'he')]),
    ('SELECT 1/0, 5 % 0, 7/2, 7/2.0, -7/2', [(None, None, 3, 3.5, -3)]),
    ("SELECT CAST('12abc' AS INTEGER), CAST('3.7x' AS REAL), CAST(3.9 AS INTEGER), CAST(5 AS TEXT)", [(12, 3.7, 3, '5')]),
    ('SELECT max(1,2), min(3,1,2), max(1,NULL)', [(2, 1, None)]),
    ("SELECT iif(1 < 2, 'a', 'b'), if(0, 1, 2)", [('a', 2)]),
    ("SELECT group_concat(n_name, '-') IS NOT NULL FROM nation", [(1,)]),
    ('SELECT json_extract(\'{"a":[1,2]}\', \'$.a[1]\'), json_extract(\'{"a":1,"b":"x"}\', \'$.a\', \'$.b\')', [('2', '[1,"x"]')]),
    ('SELECT \'{"a":{"b":5}}\' -> \'a\', \'{"a":{"b":5}}\' ->> \'$.a.b\', \'[1,2]\' ->> 1', [('{"b":5}', '5', '2')]),
    ("SELECT 'abc' GLOB 'a*', 'abc' GLOB '[x-z]*', 'É' LIKE 'é', 'ABC' LIKE 'a_c', 'a%' LIKE 'a\\%' ESCAPE '\\'", [(1, 0, 0, 1, 1)]),
    ("SELECT date('2024-01-31', '+1 month'), date('2024-01-31','start of month','-1 day'), datetime('2024-03-01 12:30'), time('10:20:30')", [('2024-03-02', '2023-12-31', '2024-03-01 12:30:00', '10:20:30')]),
    ("SELECT strftime('%Y-%m %H:%M', '2024-05-06 07:08:09'), julianday('2000-01-01 12:00'), unixepoch('1970-01-02')", [('2024-05 07:08', 2451545.0, 86400)]),
    ("SELECT datetime('2024-01-01T10:00:00+02:00'), date(2451545), datetime(86400, 'unixepoch'), date('bogus')", [('2024-01-01 08:00:00', '2000-01-01', '1970-01-02 00:00:00', None)]),
    ("SELECT timediff('2024-03-31','2024-02-29'), timediff('2023-02-15','2023-03-15')", [('+0000-01-02 00:00:00.000', '-0000-01-00 00:00:00.000')]),
    ('SELECT length(randomblob(5)), typeof(random())', [(5, 'integer')]),
    ('WITH RECURSIVE r(k) AS (SELECT 1 UNION SELECT (k * 3) % 7 FROM r) SELECT k FROM r ORDER BY k', [(1,), (2,), (3,), (4,), (5,), (6,)]),
    ('WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 5) SELECT sum(n) FROM t', [(15,)]),
    ('WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t LIMIT 4) SELECT n FROM t ORDER BY n', [(1,), (2,), (3,), (4,)]),
    ('SELECT changes(), total_changes()', [(0, 0)]),
    ('SELECT 1 UNION ALL SELECT 2 INTERSECT SELECT 2', [(2,)]),
    ('SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey', [(0, 5), (1, 5), (2, 5), (3, 5), (4, 5)]),
    ('SELECT n_nationkey, sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS c FROM nation WHERE n_nationkey < 4 ORDER BY 1', [(0, 1), (1, 2), (2, 4), (3, 2)]),
    ('SELECT count(*) FILTER (WHERE n_nationkey > 3) OVER () AS n FROM nation LIMIT 1', [(21,)]),
    ("SELECT 'a' = 'A' COLLATE NOCASE, 'a ' = 'a' COLLATE RTRIM, 1 = '1', 1 < 'a', 'a' IS NULL, 2 IS 2, NULL IS NULL", [(1, 1, 0, 1, 0, 1, 1)]),
    ("SELECT 1 AND 0, NOT 5, 'a' || 1, 5 & 3, 1 << 3, ~0, -9223372036854775808, 0x1F", [(0, 0, 'a1', 1, 8, -1, -9223372036854775808, 31)]),
    ('SELECT (1,2) < (1,3), (1,2) = (1,2), 2 IN (1,2), 3 NOT IN (1,2), 1 IN ()', [(1, 1, 1, 1, 0)]),
    ("SELECT printf('%05d|%-4s|%.2f|%x|%q|%g', 42, 'a', 3.14159, 255, 'it''s', 1.5)", [("00042|a   |3.14|ff|it''s|1.5",)]),
    ('SELECT json_array(1,\'a\',NULL,json(\'[1]\')), json_object(\'k\',1,\'z\',\'y\'), json_quote(\'a"b\'), json_set(\'{"a":1}\',\'$.b\',2)', [('[1,"a",null,[1]]', '{"k":1,"z":"y"}', '"a\\"b"', '{"a":1,"b":2}')]),
    ('SELECT json_group_array(n_nationkey), json_group_object(n_nationkey, n_regionkey) FROM nation WHERE n_nationkey < 2', [('[0,1]', '{"0":0,"1":1}')]),
    ('SELECT total(n_nationkey), total(NULL) FROM nation WHERE n_nationkey < 3', [(3.0, 0.0)]),
    ('SELECT (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS c FROM region r ORDER BY r_regionkey LIMIT 2', [(5,), (5,)]),
    ('SELECT (SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC)', [(24,)]),
    ('SELECT abs(-3), round(2.5), round(2.345, 2), sign(-2.0), ceil(1.2), log(100), log(2, 8), sqrt(-1), mod(7,3), pow(2,3), trunc(-1.5)', [(3, 3.0, 2.35, -1, 2.0, 2.0, 3.0, None, 1.0, 8.0, -1.0)]),
    ("SELECT char(72,105), unicode('A'), hex('ab'), unhex('6162'), zeroblob(2), instr('abc','c'), concat('a',NULL,1), concat_ws('-','a',NULL,'b'), trim('  x '), replace('aXa','X','b'), length('abc')", [('Hi', 65, '6162', b'ab', b'\x00\x00', 3, 'a1', 'a-b', 'x', 'aba', 3)]),
    ('SELECT count(*) FROM nation WHERE n_nationkey', [(24,)]),
    ("SELECT j.key, j.value FROM json_each('[5,6]') j", [('0', '5'), ('1', '6')]),
    ('SELECT lag(n_nationkey, 1, -n_nationkey - 5) OVER (ORDER BY n_nationkey) FROM nation LIMIT 2', [(-5,), (0,)]),
    ('SELECT row_number() OVER () AS r, rank() OVER (PARTITION BY n_regionkey) AS k FROM nation LIMIT 1', [(1, 1)]),
    ('SELECT n_regionkey, count(*) OVER w2 AS c FROM nation WINDOW w1 AS (PARTITION BY n_regionkey), w2 AS (w1 ORDER BY n_nationkey) ORDER BY n_nationkey LIMIT 1', [(0, 1)]),
    ("VALUES (1,'a'),(2,'b')", [(1, 'a'), (2, 'b')]),
    ("SELECT CASE n_nationkey WHEN 0 THEN 'z' ELSE 'o' END FROM nation WHERE n_nationkey BETWEEN 0 AND 1 ORDER BY n_nationkey", [('z',), ('o',)]),
    ('SELECT total((n_nationkey + (1))) FROM nation WHERE n_nationkey < 2', [(3.0,)]),
    ('SELECT likely(1), unlikely(2), likelihood(3, 0.5), coalesce(NULL, 4), ifnull(NULL, 5), nullif(1, 1)', [(1, 2, 3, 4, 5, None)]),
    ('SELECT 1 IS TRUE, 0 IS NOT FALSE, NULL IS NOT TRUE, 5 ISNULL, 5 NOTNULL, 1 IS DISTINCT FROM 2', [(1, 0, 1, 0, 1, 1)]),
]
#: script, then query and its rows - or the error of either; one database throughout
STEPS = [
    ("CREATE TABLE t(id INTEGER PRIMARY KEY, a TEXT NOT NULL, b INT DEFAULT 7, c AS (b * 2), CHECK (b < 100), UNIQUE(a)); INSERT INTO t(a) VALUES ('x'),('y'); INSERT INTO t VALUES (10,'z',3)", 'SELECT * FROM t ORDER BY id', [(1, 'x', 7, 14), (2, 'y', 7, 14), (10, 'z', 3, 6)]),
    ('', 'SELECT last_insert_rowid(), changes(), total_changes()', [(10, 1, 3)]),
    ('INSERT INTO t(a) VALUES (NULL)', None, 'ConstraintError'),
    ("INSERT INTO t(a,b) VALUES ('q',100)", None, 'ConstraintError'),
    ("INSERT INTO t(a) VALUES ('x')", None, 'ConstraintError'),
    ("INSERT OR IGNORE INTO t(a) VALUES ('x'),('w')", 'SELECT id, a FROM t ORDER BY id', [(1, 'x'), (2, 'y'), (10, 'z'), (11, 'w')]),
    ("INSERT OR REPLACE INTO t(id,a,b) VALUES (5,'x',1)", 'SELECT id, a FROM t ORDER BY id', [(2, 'y'), (5, 'x'), (10, 'z'), (11, 'w')]),
    ("INSERT INTO t(id,a,b) VALUES (5,'n',9) ON CONFLICT(id) DO UPDATE SET b = b + excluded.b WHERE excluded.b > 5 ON CONFLICT(a) DO NOTHING", 'SELECT b FROM t WHERE id=5', [(10,)]),
    ("INSERT INTO t(id,a,b) VALUES (77,'x',9) ON CONFLICT(id) DO UPDATE SET b = 0 ON CONFLICT(a) DO UPDATE SET b = 55", "SELECT id, b FROM t WHERE a='x'", [(5, 55)]),
    ("UPDATE t SET b = b + 1, a = a || '!' WHERE id IN (SELECT 2)", 'SELECT a,b FROM t WHERE id=2', [('y!', 8)]),
    ("UPDATE t SET (a,b) = (SELECT 'row', 42) WHERE id = 2", 'SELECT a,b FROM t WHERE id=2', [('row', 42)]),
    ('CREATE TABLE u(k INT, v INT); INSERT INTO u VALUES (10,1),(11,2); UPDATE t SET b = v FROM u WHERE u.k = t.id', 'SELECT id,b FROM t WHERE id>=10 ORDER BY id', [(10, 1), (11, 2)]),
    ('', 'UPDATE t SET b = 0 WHERE id = 10 RETURNING id, b + 1 AS nb', [(10, 1)]),
    ('', "DELETE FROM t WHERE id = 10 RETURNING a || '-gone' AS g", [('z-gone',)]),
    ('', "INSERT INTO t(id,a) VALUES (20,'k') ON CONFLICT(id) DO NOTHING RETURNING id", [(20,)]),
    ("WITH x AS (SELECT 30 AS i) INSERT INTO t(id,a) SELECT i, 'cte' FROM x", 'SELECT a FROM t WHERE id = 30', [('cte',)]),
    ("BEGIN; DELETE FROM t; SAVEPOINT s; INSERT INTO t(id,a) VALUES (1,'in'); ROLLBACK TO s; COMMIT", 'SELECT count(*) FROM t', [(0,)]),
    ('BEGIN; CREATE TABLE tmp1(x INT); ROLLBACK', 'SELECT count(*) FROM tmp1', 'AnalysisException'),
    ('PRAGMA foreign_keys = ON; CREATE TABLE p(id INTEGER PRIMARY KEY); CREATE TABLE c(id INTEGER PRIMARY KEY, p INT REFERENCES p(id) ON DELETE CASCADE ON UPDATE CASCADE); INSERT INTO p VALUES (1),(2); INSERT INTO c VALUES (1,1),(2,2)', 'SELECT count(*) FROM c', [(2,)]),
    ('INSERT INTO c VALUES (3,9)', None, 'ConstraintError'),
    ('', 'SELECT count(*) FROM c', [(2,)]),
    ('UPDATE p SET id = 5 WHERE id = 1', 'SELECT p FROM c ORDER BY id', [(5,), (2,)]),
    ('DELETE FROM p WHERE id = 5', 'SELECT id FROM c', [(2,)]),
    ('CREATE TABLE d(p INT REFERENCES p(id) DEFERRABLE INITIALLY DEFERRED); BEGIN; INSERT INTO d VALUES (99); INSERT INTO p VALUES (99); COMMIT', 'SELECT * FROM d', [(99,)]),
    ('BEGIN; INSERT INTO d VALUES (100); COMMIT', None, 'ConstraintError'),
    ('ROLLBACK', 'SELECT count(*) FROM d', [(1,)]),
    ("CREATE TABLE log(m TEXT); CREATE TRIGGER tr AFTER UPDATE OF v ON u FOR EACH ROW WHEN NEW.v > 1 BEGIN INSERT INTO log VALUES (OLD.v || '->' || NEW.v); END; UPDATE u SET v = v + 1", 'SELECT m FROM log ORDER BY m', [('1->2',), ('2->3',)]),
    ("CREATE TRIGGER tb BEFORE DELETE ON u BEGIN SELECT RAISE(ABORT, 'no') WHERE OLD.k = 11; END; DELETE FROM u WHERE k = 11", None, 'ConstraintError'),
    ('', 'SELECT count(*) FROM u', [(2,)]),
    ('CREATE VIEW vw AS SELECT k, v FROM u; CREATE TRIGGER ti INSTEAD OF INSERT ON vw BEGIN INSERT INTO u VALUES (NEW.k, NEW.v * 10); END; INSERT INTO vw VALUES (50, 5)', 'SELECT v FROM u WHERE k = 50', [(50,)]),
    ('CREATE TRIGGER tu INSTEAD OF UPDATE ON vw BEGIN UPDATE u SET v = NEW.v WHERE k = OLD.k; END; UPDATE vw SET v = 0 WHERE k = 50', 'SELECT v FROM u WHERE k = 50', [(0,)]),
    ('CREATE TABLE au(id INTEGER PRIMARY KEY AUTOINCREMENT, x INT); INSERT INTO au(x) VALUES (1),(2); DELETE FROM au; INSERT INTO au(x) VALUES (3)', 'SELECT id FROM au', [(3,)]),
    ('CREATE UNIQUE INDEX ix ON u(k) WHERE v > 0; CREATE INDEX iy ON u(v)', 'SELECT name, "unique", partial FROM pragma_index_list(\'u\') ORDER BY name', [('ix', 1, 1), ('iy', 0, 0)]),
    ('', "SELECT name FROM pragma_table_info('u')", [('k',), ('v',)]),
    ('', "SELECT type, name FROM sqlite_schema WHERE name IN ('u','vw','tr') ORDER BY name", [('trigger', 'tr'), ('table', 'u'), ('view', 'vw')]),
    ("ALTER TABLE u RENAME COLUMN v TO w; ALTER TABLE u ADD COLUMN z TEXT DEFAULT 'd'", 'SELECT w, z FROM u WHERE k = 50', [(0, 'd')]),
    ('DROP TRIGGER tr; DROP VIEW vw; ALTER TABLE u DROP COLUMN z; ALTER TABLE u RENAME TO uu', 'SELECT count(*) FROM uu', [(3,)]),
    ('DROP TABLE nope', None, 'SqlError'),
    ('PRAGMA nosuch', None, 'SqlError'),
    ('', 'PRAGMA integrity_check', [('ok',)]),
    ('UPDATE OR IGNORE c SET id = 2 WHERE id = 99', 'SELECT count(*) FROM c', [(1,)]),
]


@pytest.fixture(scope="module")
def db(spark):
    views(spark, SF, "nation region orders events customer")
    return Database(spark)


@pytest.mark.parametrize(("sql", "want"), QUERIES)
def test_query(db, sql, want):
    assert [tuple(r) for r in db.query(sql).collect()] == want


def test_steps(spark):
    db = Database(spark)
    for script, query, want in STEPS:
        if isinstance(want, str):
            with pytest.raises(Exception) as e:
                db.execute(script) if script else None
                db.query(query).collect() if query else None
            assert e.type.__name__ == want, (script, query)
            continue
        if script:
            db.execute(script)
        if query:
            assert [tuple(r) for r in db.query(query).collect()] == want, (script, query)


def test_parameters(db):
    assert db.query("SELECT ? + ?2, ?", 1, 2, "x").first()[:2] == (3, "x")
    assert tuple(db.query("SELECT :a, @b, $c", {"a": 1, "b": "it's", "c": None}).first()) == (1, "it's", None)


def test_text():
    assert statements("SELECT ';' -- a;b\n; /* ; */ SELECT 1;;") == ["SELECT ';' -- a;b", "/* ; */ SELECT 1"]
    assert [t.kind for t in tokens("x'0a' 'b''c' \"d\" [e] `f` 0x1 1e3 ?1 :g ->>")][:-1] == ["blob", "string", "name", "name", "name", "number", "number", "param", "param", "sign"]
    assert calls.literal("a'b\\") == "'a\\'b\\\\'"


@pytest.mark.parametrize("sql", [
    "SELECT", "SELECT 1 FROM", "SELECT nosuch(1)", "SELECT 1 +", "SELECT sum(1) OVER (ROWS BETWEEN UNBOUNDED FOLLOWING AND CURRENT ROW)", "SELECT row_number()", "SELECT count(DISTINCT 1) OVER ()",
    "SELECT 1 WHERE", "SELECT count(*) OVER (GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)", "SELECT sum(1) OVER nosuch", "CREATE TRIGGER t AFTER INSERT ON x BEGIN SELECT 1", "SELECT 'a' COLLATE nosuch", "SELECT substr('a')",
])
def test_refused(db, sql):
    with pytest.raises(SqlError):
        db.query(sql)


def test_views_follow_tables(spark):
    db = Database(spark)
    db.execute("CREATE TABLE vt(a INT); CREATE VIEW v1(x) AS SELECT a * 2 FROM vt; CREATE VIEW v2 AS SELECT x + 1 AS y FROM v1; INSERT INTO vt VALUES (1), (5)")
    assert sorted(r.y for r in db.query("SELECT y FROM v2").collect()) == [3, 11]
    assert [r.x for r in db.query("WITH v1 AS (SELECT 7 AS x) SELECT x FROM v1").collect()] == [7]
    db.execute("CREATE VIEW c1 AS SELECT * FROM c2; CREATE VIEW c2 AS SELECT * FROM c1")
    with pytest.raises(SqlError):
        db.query("SELECT * FROM c1")


def test_failed_statement_changes_nothing(spark):
    db = Database(spark)
    db.execute("PRAGMA foreign_keys = ON; CREATE TABLE pp(id INTEGER PRIMARY KEY); CREATE TABLE cc(p INT REFERENCES pp(id)); INSERT INTO pp VALUES (1); INSERT INTO cc VALUES (1)")
    for bad in ("INSERT INTO cc VALUES (9)", "DELETE FROM pp", "UPDATE pp SET id = 2", "INSERT INTO pp VALUES (1)"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
        assert [r[0] for r in db.query("SELECT id FROM pp UNION ALL SELECT p FROM cc").collect()] == [1, 1]
    assert emit.SCALARS


def test_failed_update_keeps_the_transaction(spark):
    db = Database(spark)
    db.execute("PRAGMA foreign_keys = ON; CREATE TABLE pk(id INTEGER PRIMARY KEY); CREATE TABLE ck(p INT REFERENCES pk(id)); INSERT INTO pk VALUES (1); INSERT INTO ck VALUES (1)")
    db.execute("BEGIN; INSERT INTO pk VALUES (3)")
    with pytest.raises(ConstraintError):
        db.execute("UPDATE pk SET id = 2 WHERE id = 1")
    assert sorted(r[0] for r in db.query("SELECT id FROM pk").collect()) == [1, 3]
    db.execute("ROLLBACK")
    assert [r[0] for r in db.query("SELECT id FROM pk").collect()] == [1]
