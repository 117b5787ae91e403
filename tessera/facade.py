"""Database: execute and query statements of the dialect on Spark.

SELECTs are parsed, bound and spelled as Spark SQL; changes are parsed and go to the table store as set-at-a-time plans
over the table's rows, so conditions and assignments may hold subqueries.  A statement changes everything or nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import json_functions
from tessera.functions.values import affinity
from tessera.session import shared_dir
from tessera.sql import emit
from tessera.sql.changes import Change, ChangeParser, Clause, Trigger
from tessera.sql.emit import Emitter, Scope
from tessera.sql.lexer import SqlError, statements, tokens
from tessera.sql.parser import Core, Node, Parser, Select, Source
from tessera.store import ConstraintError, Store

_KIND = {"INTEGER": "bigint", "TEXT": "string", "BLOB": "string", "REAL": "double", "NUMERIC": "double"}
#: fixed values: the names of the schema table
_SCHEMA_TABLES = ("sqlite_schema", "sqlite_master", "sqlite_temp_schema", "sqlite_temp_master")
#: rows that a trigger's body may run for one by one, on the driver
MOST_TRIGGERED = 10_000
_QUOTED = re.compile(r"('(?:[^']|'')*')")
split = statements


def rewrite(sql: str) -> str:
    """Tokens that Spark reads otherwise, outside quotes: ==, NOTNULL / ISNULL, LIMIT off, n, negative limits, LIKE, total, IS.

    A spelling of single tokens for callers with SQL of their own; Database parses what it is given (``translate``).
    """
    out = []
    for i, piece in enumerate(_QUOTED.split(sql)):
        if i % 2 == 0:
            piece = re.sub(r"(?<![<>=!])==(?!=)", "=", piece)
            piece = re.sub(r"\bNOTNULL\b", "IS NOT NULL", piece, flags=re.I)
            piece = re.sub(r"\bISNULL\b(?!\s*\()", "IS NULL", piece, flags=re.I)
            piece = re.sub(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)", r"LIMIT \2 OFFSET \1", piece, flags=re.I)
            piece = re.sub(r"\bLIMIT\s+-\d+", "", piece, flags=re.I)
            piece = re.sub(r"\bOFFSET\s+-\d+", "OFFSET 0", piece, flags=re.I)
            piece = re.sub(r"\bLIKE\b", "ILIKE", piece, flags=re.I)
            piece = re.sub(r"(?<!\bJSON_)\btotal\s*\(([^()]*)\)", r"coalesce(sum(CAST(\1 AS DOUBLE)), 0.0D)", piece, flags=re.I)
            piece = re.sub(r"\bIS\s+NOT\s+(?!NULL\b|DISTINCT\b|TRUE\b|FALSE\b)", "IS DISTINCT FROM ", piece, flags=re.I)
            piece = re.sub(r"\bIS\s+(?!NULL\b|NOT\b|DISTINCT\b|TRUE\b|FALSE\b)", "IS NOT DISTINCT FROM ", piece, flags=re.I)
        out.append(piece)
    return "".join(out)


class Database:
    def __init__(self, spark: SparkSession):
        self.spark, self.store = spark, Store(spark)
        self.views: dict[str, tuple[str, list[str] | None, str]] = {}  # name -> SELECT, columns, statement
        self.triggers: dict[str, tuple[Trigger, str]] = {}
        self.recursive_triggers, self._firing = False, []
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "100000")
        json_functions.register(spark)

    # -- statements
    def query(self, sql: str, *args) -> DataFrame:
        """The rows of the last statement; parameters by position, or by name where ``args`` is one dict."""
        *before, last = statements(sql)
        for s in before:
            self.execute(s)
        return self._run(last, args)

    def execute(self, sql: str, *args) -> int:
        for s in statements(sql):
            found = self._run(s, args)
            if tokens(s)[0].upper in ("SELECT", "VALUES") and found is not None:
                found.count()
        return self.store.changes

    def _run(self, s: str, args=()) -> DataFrame | None:
        words = [t.upper for t in tokens(s)]
        if words[0] in ("SELECT", "VALUES") or words[0] == "WITH" and not self._changes(s):
            return self.spark.sql(self.translate(s, args))
        if words[0] in ("INSERT", "REPLACE", "UPDATE", "DELETE", "WITH"):
            parser = ChangeParser(s)
            with self.store.atomic():
                return self._change(parser.change(), s, args)
        return getattr(self, f"_{words[0].lower()}", self._unknown)(s)

    @staticmethod
    def _changes(s: str) -> bool:
        depth = 0
        for t in tokens(s):
            depth += (t.text == "(") - (t.text == ")") if t.kind == "sign" else 0
            if not depth and t.upper in ("INSERT", "UPDATE", "DELETE", "REPLACE", "SELECT", "VALUES"):
                return t.upper not in ("SELECT", "VALUES")
        return False

    def translate(self, sql: str, args=()) -> str:
        """The Spark SQL of a SELECT, VALUES or WITH."""
        named, given = self._args(args)
        return emit.translate(self.spark, sql, given, named, self._state())

    @staticmethod
    def _args(args) -> tuple[dict, tuple]:
        named = args[0] if len(args) == 1 and isinstance(args[0], dict) else {}
        return named, () if named else tuple(args)

    def _emitter(self, s: str, args=()) -> Emitter:
        named, given = self._args(args)
        return Emitter(self.spark, s, given, named, self._state())

    def _state(self) -> dict:
        counts = {n: (lambda n=n: getattr(self.store, n)) for n in ("changes", "total_changes", "last_insert_rowid")}
        views = {n.lower(): (text, columns) for n, (text, columns, _) in self.views.items()}
        return {"views": views, "values": counts, "pragma": self._pragma_rows, "tables": dict.fromkeys(_SCHEMA_TABLES, self._schema_rows)}

    def _schema_rows(self) -> DataFrame:
        return self.store.schema_rows({n: v[2] for n, v in self.views.items()}, {n: (t.table, text) for n, (t, text) in self.triggers.items()})

    def _pragma_rows(self, name: str, *args) -> DataFrame:
        if name not in ("table_info", "table_xinfo", "index_list", "index_info", "index_xinfo", "foreign_key_list", "database_list"):
            raise SqlError(f"no such table: pragma_{name}")
        return getattr(self.store, name)(*args)

    def _unknown(self, s: str):
        raise SqlError(f"statement not supported: {s[:60]}")

    # -- changes
    def _scope(self, *sources: tuple[str, str]) -> Scope:
        scope = Scope()
        for alias, table in sources:
            scope.sources.append((alias.lower(), {c.lower(): emit._KINDS.get(k) for c, k in self.spark.table(table).dtypes}))
        return scope

    def _columns(self, name: str) -> list[str]:
        if name in self.store.tables:
            return self.store.tables[name].data.columns
        return self.views[name][1] or self.query(f'SELECT * FROM "{name}"').columns

    def _change(self, c: Change, s: str, args) -> DataFrame | None:
        e = self._emitter(s, args)
        for name, columns, inner in c.ctes:
            e.cte(name, columns, inner, c.recursive)
        if c.table in self.views:
            return self._instead(c, e)
        if c.table not in self.store.tables:
            raise SqlError(f"no such table: {c.table}")
        policy = c.policy
        try:
            rows = {"INSERT": self._insert, "UPDATE": self._update, "DELETE": self._delete}[c.kind](c, e, "ABORT" if policy in ("FAIL", "ROLLBACK") else policy)
        except ConstraintError:
            if policy == "ROLLBACK":
                self.store.rollback()
            raise
        if not c.returning or rows is None:
            return None
        rows.createOrReplaceTempView("_returned")
        return self.spark.sql(e.core(Core(items=c.returning, source=Source("table", "_returned", c.alias or c.table)), None, None))

    def _incoming(self, c: Change, e: Emitter) -> DataFrame:
        t = self.store.tables[c.table] if c.table in self.store.tables else None
        own = self._columns(c.table)
        names = c.columns or own
        if c.select is None:
            return self.spark.range(1).select(*(F.lit(t.defaults.get(n)).alias(n) for n in own))
        text = e.select(c.select, None)
        rows = self.spark.sql(e.prefix() + text)
        if len(rows.columns) != len(names):
            raise SqlError(f"{len(rows.columns)} values for {len(names)} columns")
        by_name = {n.lower(): n for n in own}
        unknown = [n for n in names if n.lower() not in by_name]
        if unknown:
            raise SqlError(f"table {c.table} has no column named {unknown[0]}")
        return rows.toDF(*(by_name[n.lower()] for n in names))

    def _insert(self, c: Change, e: Emitter, policy: str) -> DataFrame | None:
        rows = self._incoming(c, e)
        t = self.store.tables[c.table]
        rows = self._fire(c.table, "BEFORE", "INSERT", self.store._shaped(t, rows)) if self._of(c.table, "BEFORE", "INSERT") else rows
        if c.clauses:
            done = self._upsert(c, e, rows)
        else:
            done = self.store.insert(c.table, rows, policy if policy in ("IGNORE", "REPLACE") else "ABORT")
        self._fire(c.table, "AFTER", "INSERT", done)
        return done

    def _target(self, clause: Clause, table: str) -> list[str]:
        if clause.target is None:
            keys = [k for k in (self.store.tables[table].key, *self.store.tables[table].unique) if k]
            return list(keys[0]) if keys else []
        names = [n.parts[1] for n in clause.target if n.kind == "column"]
        keys = [set(k) for k in (self.store.tables[table].key, *self.store.tables[table].unique)]
        if len(names) != len(clause.target) or set(names) not in keys:
            raise SqlError("ON CONFLICT clause does not match any PRIMARY KEY or UNIQUE constraint")
        return names

    def _upsert(self, c: Change, e: Emitter, rows: DataFrame) -> DataFrame:
        """Rows go to the first clause whose key they meet, those that meet none to the first clause of all."""
        store = self.store
        t = store.tables[c.table]
        rows = store._numbered(c.table, store._shaped(t, rows).withColumn("_at", F.monotonically_increasing_id())).transform(self.store.cut)
        before = store.tables[c.table].data
        scope = self._scope((c.alias or c.table, c.table))
        scope.sources.append(("excluded", dict(scope.sources[0][1])))
        changed, left = 0, rows
        for i, clause in enumerate(c.clauses):
            target = self._target(clause, c.table)
            if not target:
                continue
            own = left if i == 0 else left.join(before.select(*target), target, "left_semi")
            if i == 0 and len(c.clauses) > 1:
                for other in c.clauses[1:]:
                    keys = self._target(other, c.table)
                    met = left.join(before.select(*keys), keys, "left_semi").join(before.select(*target), target, "left_anti")
                    own = own.join(met.select("_at"), "_at", "left_anti")
            if i:
                own = own.join(before.select(*self._target(c.clauses[0], c.table)), self._target(c.clauses[0], c.table), "left_anti")
            own = own.transform(self.store.cut)
            if own.isEmpty():
                continue
            spell = lambda n: self._spelled(e, n, scope, c.alias or c.table)
            sets = None if clause.sets is None else {col: spell(x) for cols, expr in clause.sets for col, x in self._paired(cols, expr)}
            store.upsert(c.table, own, target, sets, "_at", spell(Node("truth", [clause.where, True, False])) if clause.where is not None else None)
            changed += store.changes
            left = left.join(own.select("_at"), "_at", "left_anti")
        after = store.tables[c.table].data
        done = after.exceptAll(before)
        store.changes = changed
        return done

    @staticmethod
    def _paired(columns: list[str], expression: Node) -> list[tuple[str, Node]]:
        if len(columns) == 1:
            return [(columns[0], expression)]
        if expression.kind != "row" or len(expression.parts) != len(columns):
            raise SqlError(f"{len(columns)} columns assigned other than {len(columns)} values")
        return list(zip(columns, expression.parts, strict=True))

    @staticmethod
    def _spelled(e: Emitter, n: Node, scope: Scope, table: str) -> str:
        """An upsert's expression: bare columns are the row's."""
        for x in n.walk():
            if x.kind == "column" and (x.parts[0] or table).lower() == table.lower():
                x.parts[0] = "t"
        if scope.sources[0][0] != "t":
            scope.sources.insert(0, ("t", scope.sources[0][1]))
        return e.value(n, scope)[0] if n.kind == "truth" else e.shown(n, scope)

    def _update(self, c: Change, e: Emitter, policy: str) -> DataFrame:
        alias = c.alias or c.table
        scope = Scope()
        before = self.store.tables[c.table].data
        sets = []
        if c.source is None:
            origin = e.source(Source("table", c.table, alias), scope)
        else:
            self.store.table(c.table).withColumn("_rid", F.monotonically_increasing_id()).createOrReplaceTempView("_updated")
            origin = e.source(Source("join", left=Source("table", "_updated", alias), right=c.source, join="INNER", on=c.where or Node("number", [1])), scope)
        subqueries = []
        for columns, x in c.sets:
            if len(columns) > 1 and x.kind == "subquery":  # one row gives all columns
                items = x.parts[0].cores[0].items
                if len(items) != len(columns):
                    raise SqlError(f"{len(columns)} columns assigned {len(items)} values")
                for col, item in zip(columns, items, strict=True):
                    one = Select([Core([item], x.parts[0].cores[0].distinct, x.parts[0].cores[0].source, x.parts[0].cores[0].where, x.parts[0].cores[0].group, x.parts[0].cores[0].having)], [], order=x.parts[0].order, limit=x.parts[0].limit)
                    subqueries.append((col, Node("subquery", [one])))
            else:
                subqueries += self._paired(columns, x)
        for col, x in subqueries:
            own = next((n for n in before.columns if n.lower() == col.lower()), None)
            if own is None:
                raise SqlError(f"no such column: {col}")
            sets.append((own, e.shown(x, scope)))
        new = ", ".join(f"{x} AS `_new_{col}`" for col, x in sets)
        columns = ", ".join(f"`{alias}`.`{n}`" for n in before.columns)
        if c.source is None:
            hit = f"coalesce({emit.C.truth_of(e.value(c.where, scope))}, false)" if c.where is not None else "true"
            marked = self.spark.sql(f"{e.prefix()}SELECT {columns}, {hit} AS _hit, {new} FROM {origin}")
        else:  # each row takes one of the rows it meets
            met = self.spark.sql(f"{e.prefix()}SELECT `{alias}`._rid AS _rid, {new} FROM {origin}")
            one = met.groupBy("_rid").agg(*(F.first(f"_new_{col}").alias(f"_new_{col}") for col, _ in sets)).withColumn("_hit", F.lit(True))
            marked = before.withColumn("_rid", F.monotonically_increasing_id()).join(one, "_rid", "left").drop("_rid").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
        changed = [col for col, _ in sets]
        if self._of(c.table, "BEFORE", "UPDATE"):
            marked = marked.transform(self.store.cut)
            new_rows = marked.where("_hit").select(*(F.col(f"_new_{n}").alias(n) if n in changed else F.col(n) for n in before.columns), *(F.col(n).alias(f"_old_{n}") for n in before.columns))
            self._fire(c.table, "BEFORE", "UPDATE", new_rows, changed)
        done = self.store.changed(c.table, marked, changed, policy)
        if self._of(c.table, "AFTER", "UPDATE"):
            self._fire(c.table, "AFTER", "UPDATE", self.store.last, changed)
        return done

    def _delete(self, c: Change, e: Emitter, policy: str) -> DataFrame:
        scope = Scope()
        alias = c.alias or c.table
        origin = e.source(Source("table", c.table, alias), scope)
        columns = ", ".join(f"`{alias}`.`{n}`" for n in self.store.tables[c.table].data.columns)
        hit = f"coalesce({emit.C.truth_of(e.value(c.where, scope))}, false)" if c.where is not None else "true"
        marked = self.spark.sql(f"{e.prefix()}SELECT {columns}, {hit} AS _hit FROM {origin}").transform(self.store.cut)
        if self._of(c.table, "BEFORE", "DELETE"):
            self._fire(c.table, "BEFORE", "DELETE", marked.where("_hit").drop("_hit"))
        gone = self.store.deleted(c.table, marked)
        self._fire(c.table, "AFTER", "DELETE", gone)
        return gone

    # -- triggers
    def _of(self, table: str, when: str, event: str) -> list[tuple[str, Trigger, str]]:
        return [(n, t, text) for n, (t, text) in self.triggers.items() if (t.table, t.when, t.event) == (table, when, event) and (self.recursive_triggers or n not in self._firing)]

    def _fire(self, table: str, when: str, event: str, rows: DataFrame | None, columns: list[str] | None = None) -> DataFrame | None:
        """Run the bodies of a table's triggers; returns the rows that RAISE(IGNORE) leaves.

        NEW and OLD are the columns of ``rows``, for updates beside _old_ columns.  Bodies that only insert values or
        raise run once over all rows; others run row by row, for at most ``MOST_TRIGGERED`` rows.
        """
        for name, t, text in self._of(table, when, event):
            if t.columns and columns is not None and not {x.lower() for x in t.columns} & {x.lower() for x in columns}:
                continue
            prefixes = {"INSERT": {"new": ""}, "DELETE": {"old": ""}, "UPDATE": {"new": "", "old": "_old_"}}[event]
            rows = rows.transform(self.store.cut)
            view = f"_fired_{len(self._firing)}"
            rows.createOrReplaceTempView(view)
            plain = [n for n in rows.columns if not n.startswith("_old_")]
            kinds = dict(rows.dtypes)
            sources = [(side, {n.lower(): emit._KINDS.get(kinds[n]) for n in plain}) for side in prefixes]
            if len(prefixes) == 1:
                tail = f" AS {next(iter(prefixes))}"
                origin = view + tail
            else:
                tail = ""
                sides = ", ".join(f"struct({', '.join(f'`{p}{n}` AS `{n}`' for n in plain)}) AS {side}" for side, p in prefixes.items())
                origin = f"(SELECT {sides} FROM {view})"
            if t.condition:
                origin = f"(SELECT * FROM {origin} WHERE {self._over_rows(text[slice(*t.condition)], sources)}){tail}"
            self._firing.append(name)
            counts = self.store.changes, self.store.last_insert_rowid
            try:
                for span in t.body:
                    rows = self._body(text[slice(*span)], origin, sources, rows, view, prefixes)
            finally:
                self._firing.pop()
                self.store.changes, self.store.last_insert_rowid = counts
        return rows

    def _over_rows(self, text: str, sources) -> str:
        p = Parser(text)
        tree = p.expression()
        p.finish()
        scope = Scope()
        scope.sources = sources
        return emit.C.truth_of(self._emitter(text).value(tree, scope))

    def _body(self, text: str, origin: str, sources, rows: DataFrame, view: str, prefixes: dict) -> DataFrame:
        first = tokens(text)[0].upper
        if first == "SELECT":
            core = Parser(text).select().cores[0]
            raised = [x for item, _ in core.items for x in item.walk() if x.kind == "call" and x.parts[0] == "raise"]
            if not raised:
                return rows
            conditions = [core.where] if core.where is not None else []
            if core.items[0][0].kind == "case" and core.items[0][0].parts[0] is None:
                conditions += [w for w, result in core.items[0][0].parts[1] if result is raised[0]]
            action = raised[0].parts[1][0].parts[1].upper()
            message = str(raised[0].parts[1][1].parts[0]) if len(raised[0].parts[1]) > 1 else ""
            scope = Scope()
            scope.sources = sources
            e = self._emitter(text)
            where = " AND ".join(emit.C.truth_of(e.value(x, scope)) for x in conditions) or "true"
            if action == "IGNORE":
                refused = f"coalesce({where}, false)"
                sides = ", ".join(f"struct({', '.join(f'`{p}{n}` AS `{n}`' for n in rows.columns if not n.startswith('_old_'))}) AS {side}" for side, p in prefixes.items())
                return self.spark.sql(f"SELECT _row.* FROM (SELECT struct(*) AS _row, {sides} FROM {view}) WHERE NOT {refused}")
            if not self.spark.sql(f"SELECT 1 FROM {origin} WHERE {where}").isEmpty():
                if action == "ROLLBACK":
                    self.store.rollback()
                raise ConstraintError(message)
            return rows
        change = ChangeParser(text).change()
        if change.kind == "INSERT" and change.select is not None and not change.clauses and len(change.select.cores) == 1 and change.select.cores[0].source is None:
            core, e = change.select.cores[0], self._emitter(text)
            scope = Scope()
            scope.sources = sources
            listed = core.values if core.values is not None else [[x for x, _ in core.items]]
            where = f" WHERE {emit.C.truth_of(e.value(core.where, scope))}" if core.where is not None else ""
            names = change.columns or self._columns(change.table)
            for values in listed:
                made = self.spark.sql(f"SELECT {', '.join(f'{e.shown(x, scope)} AS `{n}`' for x, n in zip(values, names, strict=True))} FROM {origin}{where}")
                done = self.store.insert(change.table, made, change.policy if change.policy in ("IGNORE", "REPLACE") else "ABORT")
                self._fire(change.table, "AFTER", "INSERT", done)
            return rows
        found = self.spark.sql(f"SELECT * FROM {origin}").limit(MOST_TRIGGERED + 1).collect()
        if len(found) > MOST_TRIGGERED:
            raise SqlError(f"a trigger's row-by-row body runs for at most {MOST_TRIGGERED} rows")
        for row in found:
            self._run(_substituted(text, {side: (row[side] if len(prefixes) > 1 else row).asDict() for side in prefixes}))
        return rows

    def _instead(self, c: Change, e: Emitter) -> None:
        """Changes of a view run its INSTEAD OF triggers over the rows they would change."""
        if not self._of(c.table, "INSTEAD OF", c.kind):
            raise SqlError(f"cannot modify {c.table} because it is a view")
        columns = self._columns(c.table)
        if c.kind == "INSERT":
            rows = self._incoming(c, e)
            rows = rows.select(*(F.col(n) if n in rows.columns else F.lit(None).cast("string").alias(n) for n in columns))
            self._fire(c.table, "INSTEAD OF", "INSERT", rows)
            return None
        scope = Scope()
        origin = e.source(Source("table", c.table, c.alias or c.table), scope)
        where = f" WHERE {emit.C.truth_of(e.value(c.where, scope))}" if c.where is not None else ""
        sets = {col.lower(): e.shown(x, scope) for cols, expr in c.sets for col, x in self._paired(cols, expr)}
        shown = [f"{sets.get(n.lower(), f'`{n}`')} AS `{n}`" for n in columns]
        old = [f"`{n}` AS `_old_{n}`" for n in columns] if c.kind == "UPDATE" else []
        rows = self.spark.sql(f"{e.prefix()}SELECT {', '.join(shown + old)} FROM {origin}{where}")
        self._fire(c.table, "INSTEAD OF", c.kind, rows, list(sets))
        return None

    # -- schema
    def _create(self, s: str) -> None:
        p = ChangeParser(s)
        p.need("CREATE")
        temp = p.take("TEMP") or p.take("TEMPORARY")
        unique = p.take("UNIQUE")
        kind = p.word().upper()
        lenient = p.take("IF", "NOT", "EXISTS")
        if kind == "TABLE":
            name = p.tokens[p.at].text
            if name in self.store.tables or name in self.views:
                if lenient:
                    return
                raise ConstraintError(f"table {name} already exists")
            if p.tokens[p.at + 1].upper == "AS":
                self.store.create(name, self.spark.sql(self.translate(s[p.tokens[p.at + 2].at :])).transform(self.store.cut), sql=s)
            else:
                self._define(p, s)
        elif kind == "VIEW":
            name = p.word()
            columns = p.names() if p.peek("(") else None
            p.need("AS")
            if name in self.store.tables or name in self.views:
                if lenient:
                    return
                raise ConstraintError(f"table {name} already exists")
            self.views[name] = s[p.next.at :], columns, s
        elif kind == "INDEX":
            self._index(p, s, unique, lenient)
        elif kind == "TRIGGER":
            t = p.trigger()
            if t.name in self.triggers and not lenient:
                raise ConstraintError(f"trigger {t.name} already exists")
            if (t.when == "INSTEAD OF") != (t.table in self.views):
                raise SqlError("INSTEAD OF triggers belong to views, others to tables")
            self.triggers.setdefault(t.name, (t, s))
        else:
            self._unknown(s)
        del temp

    def _index(self, p: ChangeParser, s: str, unique: bool, lenient: bool) -> None:
        name = p.word()
        p.need("ON")
        t = self.store.tables[p.word()]
        if any(name in x.indexes for x in self.store.tables.values()):
            if lenient:
                return
            raise ConstraintError(f"index {name} already exists")
        p.need("(")
        begin = p.next.at
        terms = [e for e, *_ in p.listed(p.ordering)]
        text = s[begin : p.next.at]
        p.need(")")
        where = s[p.tokens[p.at + 1].at :] if p.peek("WHERE") else None
        columns = tuple(e.parts[1] if e.kind == "column" else text for e in terms)
        t.indexes[name] = columns, unique, where
        if unique and where is None and all(e.kind == "column" for e in terms):
            t.unique = (*t.unique, columns)
        elif unique:  # over expressions, or of some rows only
            table = next(n for n, x in self.store.tables.items() if x is t)
            scope = self._scope((table, table))
            e = self._emitter(s)
            t.partial[name] = tuple(e.value(x, scope)[0] for x in terms), emit.C.truth_of(e.value(_parsed(where), scope)) if where else "true"
        self.store._verify(next(n for n, x in self.store.tables.items() if x is t), t)

    def _define(self, p: ChangeParser, s: str) -> None:
        d = p.definition()
        kinds = {c.name.lower(): emit._KINDS[_KIND[affinity(c.kind)]] for c in d.columns}
        scope = Scope()
        scope.sources = [(d.name.lower(), kinds)]
        e = self._emitter(s)
        checks = {s[slice(*span)].strip(): emit.C.truth_of(e.value(x, scope)) for span, x in [*d.checks, *(y for c in d.columns for y in c.checks)]}
        key = tuple(d.key) or tuple(c.name for c in d.columns if c.key)
        whole = key and next((c for c in d.columns if (c.name,) == key and c.kind.upper() == "INTEGER"), None)
        references = [*d.references, *(c.references for c in d.columns if c.references)]
        references = [(c, parent, target or (self.store.tables[parent].key or ("rowid",))[0] if parent in self.store.tables else target, *rest) for c, parent, target, *rest in references]
        defaults = {}
        for c in d.columns:
            if c.default is not None:
                defaults[c.name] = self.spark.sql(f"SELECT {e.shown(c.default, Scope())} AS v").first()[0]
        self.store.create(
            d.name, ", ".join(f"`{c.name}` {_KIND[affinity(c.kind)]}" for c in d.columns if c.generated is None), key=key, unique=tuple(map(tuple, d.unique)) + tuple((c.name,) for c in d.columns if c.unique),
            not_null=tuple(c.name for c in d.columns if c.not_null), checks=checks, references=tuple(references), defaults=defaults, sql=s, rowid=whole.name if whole else None,
            autoincrement=any(c.autoincrement for c in d.columns), generated={c.name: e.shown(c.generated, scope) for c in d.columns if c.generated is not None},
        )

    def _drop(self, s: str) -> None:
        p = ChangeParser(s)
        p.need("DROP")
        kind = p.word().upper()
        lenient, name = p.take("IF", "EXISTS"), p.word()
        held = {"TABLE": self.store.tables, "VIEW": self.views, "TRIGGER": self.triggers, "INDEX": {n: t for t in self.store.tables.values() for n in t.indexes}}.get(kind)
        if held is None:
            self._unknown(s)
        if name not in held:
            if lenient:
                return
            raise SqlError(f"no such {kind.lower()}: {name}")
        if kind == "TABLE":
            if self.store.foreign_keys:  # its rows go first, as references demand
                self.store.delete(name)
            self.store.drop(name)
        elif kind == "VIEW":
            del self.views[name]
        elif kind == "TRIGGER":
            del self.triggers[name]
        else:
            t = held[name]
            columns, unique, _ = t.indexes.pop(name)
            t.partial.pop(name, None)
            if unique:
                t.unique = tuple(u for u in t.unique if u != columns)
        if kind in ("TABLE", "VIEW"):
            self.triggers = {n: x for n, x in self.triggers.items() if x[0].table != name}

    def _alter(self, s: str) -> None:
        p = ChangeParser(s)
        p.need("ALTER", "TABLE")
        name = p.word()
        if name not in self.store.tables:
            raise SqlError(f"no such table: {name}")
        if p.take("RENAME", "TO"):
            to = p.word()
            self.store.rename(name, to)
            for t, _ in self.triggers.values():
                t.table = to if t.table == name else t.table
        elif p.take("RENAME"):
            p.take("COLUMN")
            old = p.word()
            p.need("TO")
            self.store.rename_column(name, old, p.word())
        elif p.take("DROP"):
            p.take("COLUMN")
            self.store.drop_column(name, p.word())
        elif p.take("ADD"):
            p.take("COLUMN")
            c = p.column_definition()
            default = self.spark.sql(f"SELECT {self._emitter(s).shown(c.default, Scope())} AS v").first()[0] if c.default is not None else None
            if c.not_null and default is None:
                raise SqlError("Cannot add a NOT NULL column with default value NULL")
            if c.key or c.unique:
                raise SqlError("Cannot add a PRIMARY KEY or UNIQUE column")
            self.store.add_column(name, c.name, _KIND[affinity(c.kind)], default, c.not_null)
        else:
            self._unknown(s)

    # -- transactions and settings
    def _begin(self, s: str) -> None:
        if self.store._saved:
            raise SqlError("cannot start a transaction within a transaction")
        self.store.begin()

    def _commit(self, s: str) -> None:
        if not self.store._saved:
            raise SqlError("cannot commit - no transaction is active")
        self.store.commit()

    _end = _commit

    def _savepoint(self, s: str) -> None:
        self.store.begin(s.split()[1].rstrip(";"))

    def _release(self, s: str) -> None:
        self.store.release(s.split()[-1].rstrip(";"))

    def _rollback(self, s: str) -> None:
        m = re.match(r"ROLLBACK\s+(?:TRANSACTION\s+)?TO\s+(?:SAVEPOINT\s+)?(\w+)", s, re.I)
        if not self.store._saved:
            raise SqlError("cannot rollback - no transaction is active")
        if m and m[1] not in [n for n, _ in self.store._saved]:
            raise SqlError(f"no such savepoint: {m[1]}")
        self.store.rollback(m[1] if m else None)

    def _pragma(self, s: str) -> DataFrame | None:
        m = re.match(r"PRAGMA\s+(\w+)\s*(?:=\s*(\w+)|\(\s*['\"]?(\w+)['\"]?\s*\))?\s*;?$", s, re.I)
        if not m:
            self._unknown(s)
        name, value = m[1].lower(), m[2] or m[3]
        flags = {"foreign_keys": self.store, "defer_foreign_keys": self.store, "recursive_triggers": self}
        if name in flags:
            if value:
                setattr(flags[name], name, value.lower() in ("1", "on", "true", "yes"))
                return None
            return self.spark.sql(f"SELECT {int(getattr(flags[name], name))}L AS {name}")
        if name in ("integrity_check", "quick_check"):
            for n, t in self.store.tables.items():
                try:
                    self.store._verify(n, t)
                except ConstraintError as e:
                    return self.spark.sql(f"SELECT {emit.C.literal(str(e))} AS {name}")
            return self.spark.sql(f"SELECT 'ok' AS {name}")
        try:
            return self._pragma_rows(name, *([value] if value else []))
        except SqlError:
            raise SqlError(f"PRAGMA {name} is not supported") from None

    def _explain(self, s: str) -> DataFrame:
        """The plan of a SELECT: one row a line, (id, parent, notused, detail)."""
        text = re.sub(r"^EXPLAIN\s+(QUERY\s+PLAN\s+)?", "", s, flags=re.I)
        plan = self.spark.sql(f"EXPLAIN FORMATTED {self.translate(text)}").first()[0]
        rows = [(i, 0, 0, line) for i, line in enumerate(x for x in plan.splitlines() if x.strip())]
        return self.spark.createDataFrame(rows, "id int, parent int, notused int, detail string")

    def _vacuum(self, s: str) -> None:
        if m := re.match(r"VACUUM\s+(?:\w+\s+)?INTO\s+'([^']*)'", s, re.I):
            for name, t in self.store.tables.items():
                t.data.write.mode("errorifexists").parquet(f"{m[1]}/{name}")

    def _reindex(self, s: str) -> None:
        """Nothing is kept that could fall behind the tables."""

    def _analyze(self, s: str) -> None:
        """Spark's adaptive plans count rows as they run: there are no statistics to refresh."""


def _parsed(text: str) -> Node:
    p = Parser(text)
    out = p.expression()
    p.finish()
    return out


def _substituted(text: str, sides: dict[str, dict]) -> str:
    """A trigger's statement with NEW.x and OLD.x as literals."""
    found, out, at = tokens(text), [], 0
    for i, t in enumerate(found[:-2]):
        if t.text.lower() in sides and found[i + 1].text == ".":
            row = {k.lower(): v for k, v in sides[t.text.lower()].items()}
            v = row.get(found[i + 2].text.lower())
            shown = "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"({v!r})"
            out += [text[at : t.at], shown]
            at = found[i + 3].at
            out.append(" ")
    return "".join(out) + text[at:]


__all__ = ["ConstraintError", "Database", "SqlError", "statements"]
