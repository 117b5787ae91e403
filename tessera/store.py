"""A versioned table store: DML, constraints and transactions as copy-on-write DataFrames.

Every statement makes a new version of its table from set-at-a-time plans; a transaction is a snapshot of the map from
names to versions.  Versions are Parquet tables in the shared folder: lineage stays short, a lost executor
loses nothing, and reads take only the columns they need.
"""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import shared_dir


class ConstraintError(Exception):
    pass


@dataclass
class Table:
    data: DataFrame
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    references: tuple[tuple, ...] = ()  # column, parent, parent column, on delete[, on update, deferred]
    generated: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    rowid: str | None = None  # an integer primary key, numbered where it is null
    autoincrement: bool = False
    sql: str = ""
    indexes: dict[str, tuple] = field(default_factory=dict)  # name -> columns, unique, WHERE
    partial: dict[str, tuple] = field(default_factory=dict)  # unique over expressions of the rows that a condition picks


def _reference(r: tuple) -> tuple[str, str, str, str, str, bool]:
    return (*r, *("NO ACTION", "NO ACTION", False)[len(r) - 3 :])


class Store:
    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self._saved = spark, {}, []
        self.changes = self.total_changes = self.last_insert_rowid = 0
        self.foreign_keys = self.defer_foreign_keys = False
        self.sequences: dict[str, int] = {}
        self._folder: str | None = None
        self.triggers: dict[tuple[str, str], list[Callable]] = {}

    def cut(self, df: DataFrame) -> DataFrame:
        """``df`` written once to the shared folder and read back."""
        if self._folder is None:
            self._folder = f"{shared_dir(self.spark)}/tessera-store-{uuid.uuid4().hex[:12]}"
            atexit.register(self.close)
        df = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in df.dtypes))
        path = f"{self._folder}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Free all versions; the session may be gone by then."""
        try:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:
            pass

    # -- catalog
    def create(self, name: str, schema: str | DataFrame, **constraints) -> None:
        if name in self.tables:
            raise ConstraintError(f"table {name} already exists")
        data = schema if isinstance(schema, DataFrame) else self.spark.createDataFrame([], schema)
        self._put(name, Table(data, **constraints))

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.spark.catalog.dropTempView(name)

    def rename(self, name: str, to: str) -> None:
        self._put(to, self.tables.pop(name))
        self.spark.catalog.dropTempView(name)

    def add_column(self, name: str, column: str, kind: str, default=None, not_null: bool = False) -> None:
        t = self.tables[name]
        t = replace(self._with(t, t.data.withColumn(column, F.lit(default).cast(kind))), not_null=(*t.not_null, column) if not_null else t.not_null)
        self._put(name, replace(t, defaults={**t.defaults, column: default}) if default is not None else t)

    def rename_column(self, name: str, old: str, new: str) -> None:
        t = self.tables[name]
        if old not in t.data.columns or new in t.data.columns:
            raise ConstraintError(f"no such column, or one of that name: {old}, {new}")
        moved = lambda names: tuple(new if c == old else c for c in names)
        own = replace(t, data=t.data.withColumnRenamed(old, new), key=moved(t.key), unique=tuple(map(moved, t.unique)), not_null=moved(t.not_null), rowid=new if t.rowid == old else t.rowid,
                      references=tuple((new if r[0] == old else r[0], *r[1:]) for r in t.references), defaults={new if c == old else c: v for c, v in t.defaults.items()},
                      checks={re.sub(rf"\b{old}\b", new, k): e.replace(f"`{old}`", f"`{new}`") for k, e in t.checks.items()}, generated={c: e.replace(f"`{old}`", f"`{new}`") for c, e in t.generated.items()})
        self._put(name, own)

    def drop_column(self, name: str, column: str) -> None:
        t = self.tables[name]
        used = {*t.key, *(c for u in t.unique for c in u), *(r[0] for r in t.references)}
        if column not in t.data.columns or column in used or any(f"`{column}`" in e for e in (*t.checks.values(), *t.generated.values())):
            raise ConstraintError(f"cannot drop column {column!r}")
        self._put(name, replace(t, data=t.data.drop(column), not_null=tuple(c for c in t.not_null if c != column), defaults={c: v for c, v in t.defaults.items() if c != column}))

    def table(self, name: str) -> DataFrame:
        t = self.tables[name]
        return t.data.select("*", *(F.expr(e).alias(c) for c, e in t.generated.items()))

    def table_info(self, name: str) -> DataFrame:
        t = self.tables[name]
        rows = [(i, c, kind, int(c in t.not_null), None if c not in t.defaults else str(t.defaults[c]), t.key.index(c) + 1 if c in t.key else 0) for i, (c, kind) in enumerate(t.data.dtypes)]
        return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")

    def table_xinfo(self, name: str) -> DataFrame:
        t = self.tables[name]
        own = self.table_info(name).selectExpr("*", "0 AS hidden")
        more = [(len(t.data.columns) + i, c, kind, 0, None, 0, 2) for i, (c, kind) in enumerate(x for x in self.table(name).dtypes if x[0] in t.generated)]
        return own.union(self.spark.createDataFrame(more, own.schema)) if more else own

    def foreign_key_list(self, name: str) -> DataFrame:
        rows = [(i, 0, p, c, pc, u, d, "NONE") for i, (c, p, pc, d, u, _) in enumerate(map(_reference, self.tables[name].references))]
        return self.spark.createDataFrame(rows, "id int, seq int, table string, `from` string, `to` string, on_update string, on_delete string, match string")

    def _indexes(self, name: str) -> list[tuple[str, tuple, bool, str, bool]]:
        t = self.tables[name]
        made = [(n, columns, unique, "c", bool(where)) for n, (columns, unique, where) in t.indexes.items()]
        keys = [(t.key, "pk")] if t.key and t.key != (t.rowid,) else []
        keys += [(u, "u") for u in t.unique if u not in {tuple(c) for _, c, unique, *_ in made if unique}]
        return made + [(f"autoindex_{name}_{i + 1}", columns, True, origin, False) for i, (columns, origin) in enumerate(keys)]

    def index_list(self, name: str) -> DataFrame:
        rows = [(i, n, int(unique), origin, int(partial)) for i, (n, _, unique, origin, partial) in enumerate(self._indexes(name))]
        return self.spark.createDataFrame(rows, "seq int, name string, unique int, origin string, partial int")

    def index_info(self, index: str) -> DataFrame:
        rows = [(i, self.tables[t].data.columns.index(c) if c in self.tables[t].data.columns else -2, c if c in self.tables[t].data.columns else None)
                for t in self.tables for n, columns, *_ in self._indexes(t) if n == index for i, c in enumerate(columns)]
        return self.spark.createDataFrame(rows, "seqno int, cid int, name string")

    def index_xinfo(self, index: str) -> DataFrame:
        return self.index_info(index).selectExpr("*", "0 AS `desc`", "'BINARY' AS coll", "1 AS `key`")

    def database_list(self) -> DataFrame:
        return self.spark.createDataFrame([(0, "main", "")], "seq int, name string, file string")

    def schema_rows(self, views: dict[str, str] | None = None, triggers: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """type, name, tbl_name, rootpage, sql of all that was created."""
        rows = [("table", n, n, 0, t.sql or None) for n, t in self.tables.items()]
        rows += [("index", n, t, 0, None) for t in self.tables for n, *_ in self._indexes(t)]
        rows += [("view", n, n, 0, text) for n, text in (views or {}).items()] + [("trigger", n, of, 0, text) for n, (of, text) in (triggers or {}).items()]
        return self.spark.createDataFrame(rows, "type string, name string, tbl_name string, rootpage long, sql string")

    # -- DML
    def insert(self, name: str, rows: DataFrame, on_conflict: str = "ABORT") -> DataFrame:
        """ABORT raises, IGNORE keeps the older row, REPLACE the newer; returns the rows put in."""
        t = self.tables[name]
        rows = self._shaped(t, rows).withColumn("_at", F.monotonically_increasing_id())  # the order they came in
        keys = [k for k in (t.key, *t.unique) if k]
        if on_conflict == "IGNORE":  # rows that stay out take no number
            rows = self._fresh(t, rows, [k for k in keys if t.rowid not in k])
        rows = self._numbered(name, rows)
        if on_conflict == "IGNORE":
            rows = self._fresh(t, rows, keys)
        kept = t.data
        if on_conflict == "REPLACE":
            for k in keys:
                last = Window.partitionBy(*k).orderBy(F.desc("_at"))
                rows = rows.withColumn("_n", F.when(self._full(k), F.row_number().over(last)).otherwise(1)).where("_n = 1").drop("_n")
                kept = kept.join(rows.select(*k), list(k), "left_anti")
        rows = rows.drop("_at").transform(self.cut)
        self._commit(name, kept.unionByName(rows), rows.count())
        self._fire(name, "INSERT", rows)
        return rows

    def _fresh(self, t: Table, rows: DataFrame, keys: list) -> DataFrame:
        """The rows that INSERT OR IGNORE puts in: first of their keys, no older row's, and without nulls where none may be."""
        for k in keys:
            first = Window.partitionBy(*k).orderBy("_at")
            rows = rows.withColumn("_n", F.when(self._full(k), F.row_number().over(first)).otherwise(1)).where("_n = 1").drop("_n").join(t.data.select(*k), list(k), "left_anti")
        for c in t.not_null:
            rows = rows.where(F.col(c).isNotNull())
        return rows

    def update(self, name: str, assignments: dict[str, Column], where: Column | None = None) -> DataFrame:
        """Assignments see the row as it was; a NULL condition changes nothing."""
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        return self.changed(name, self.tables[name].data.select("*", hit.alias("_hit"), *(x.alias(f"_new_{c}") for c, x in assignments.items())), list(assignments))

    def update_from(self, name: str, source: DataFrame, on: list[str], assignments: dict[str, str]) -> DataFrame:
        """UPDATE ... FROM: each row takes one matching source row."""
        one = source.withColumn("_n", F.row_number().over(Window.partitionBy(*on).orderBy(*[c for c in source.columns if c not in on] or on))).where("_n = 1").drop("_n")
        right = one.select(*on, *(F.expr(e).alias(f"_new_{c}") for c, e in assignments.items()), F.lit(True).alias("_hit"))
        return self.changed(name, self.tables[name].data.join(right, on, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))), list(assignments))

    def changed(self, name: str, marked: DataFrame, columns: list[str], on_conflict: str = "ABORT") -> DataFrame:
        """The table's rows beside _hit and a _new_c for each changed column become its next version; returns those hit.

        IGNORE leaves a row as it was where it would break NOT NULL or meet another's key, REPLACE drops the other row.
        """
        t = self.tables[name]
        marked = marked.transform(self.cut)
        value = lambda c, kind: F.when(F.col("_hit"), F.col(f"_new_{c}").cast(kind)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        new = marked.select(*(value(c, kind) for c, kind in t.data.dtypes), "_hit", *(F.col(c).alias(f"_old_{c}") for c in t.data.columns))
        if on_conflict in ("IGNORE", "REPLACE"):
            if on_conflict == "IGNORE" and t.not_null:
                broken = ~self._full(t.not_null)
                new = new.select(*(F.when(broken, F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in t.data.columns), (F.col("_hit") & ~broken).alias("_hit"), *(f"_old_{c}" for c in t.data.columns))
            for k in (k for k in (t.key, *t.unique) if k and set(k) & set(columns)):
                held = new.withColumn("_many", F.count("*").over(Window.partitionBy(*k))).withColumn("_clash", self._full(k) & (F.col("_many") > 1))
                new = held.where("not _clash or _hit") if on_conflict == "REPLACE" else held.select(*(F.when(F.col("_clash") & F.col("_hit"), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in t.data.columns), (F.col("_hit") & ~F.col("_clash")).alias("_hit"), *(f"_old_{c}" for c in t.data.columns))
                new = new.drop("_many", "_clash")
        new = new.transform(self.cut)
        hit = new.where("_hit").drop("_hit")
        with self.atomic():
            late, self.defer_foreign_keys = self.defer_foreign_keys, True
            self._saved.append(("", self.tables))  # references to rows that move are looked at when all have moved
            try:
                self._commit(name, new.select(*t.data.columns), hit.count())
            finally:
                self._saved.pop()
                self.defer_foreign_keys = late
            if self.foreign_keys:
                counts = self.changes, self.total_changes
                self._moved(name, hit)
                self._parents(name, self.tables[name])
                self.changes, self.total_changes = counts
        rows = hit.select(*t.data.columns)
        self._fire(name, "UPDATE", rows)
        self.last = hit
        return rows

    def delete(self, name: str, where: Column | None = None) -> DataFrame:
        """Rows whose condition is NULL stay."""
        hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
        return self.deleted(name, self.tables[name].data.withColumn("_hit", hit).transform(self.cut))

    def deleted(self, name: str, marked: DataFrame) -> DataFrame:
        """The table's rows beside _hit lose those hit; returns them."""
        gone = marked.where("_hit").drop("_hit")
        self._commit(name, marked.where("not _hit").drop("_hit"), gone.count(), cascade=gone)
        self._fire(name, "DELETE", gone)
        return gone

    def upsert(self, name: str, rows: DataFrame, target: list[str], assignments: dict[str, str] | None, order: str, where: str | None = None) -> None:
        """INSERT ... ON CONFLICT (target) DO UPDATE SET ... / DO NOTHING, rows taken in ``order``.

        In assignments and ``where`` ``excluded.c`` is the incoming value, ``t.c`` the row's; rows that ``where`` refuses
        stay as they are.  Rows of one batch that meet at a key fold in order, one
        round for each further row of the most repeated key.
        """
        t = self.tables[name]
        place = Window.partitionBy(*target).orderBy(order)
        numbered = rows.withColumn("_n", F.row_number().over(place)).transform(self.cut)
        current, columns = t.data, t.data.columns
        for n in range(1, (numbered.agg(F.max("_n")).first()[0] or 0) + 1):
            new = self._shaped(t, numbered.where(F.col("_n") == n).drop("_n"))
            if assignments is None:
                current = current.unionByName(new.join(current.select(*target), target, "left_anti"))
                continue
            e, x = current.alias("t"), new.withColumn("_new", F.lit(True)).alias("excluded")
            joined = e.withColumn("_old", F.lit(True)).alias("t").join(x, reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in target)), "full")
            both = F.col("t._old") & F.col("excluded._new")
            if where:
                both = both & F.coalesce(F.expr(where), F.lit(False))
            current = joined.select(*(F.when(both, F.expr(assignments[c]) if c in assignments else F.col(f"t.{c}")).when(F.col("t._old"), F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c) for c in columns)).transform(self.cut)
        self._commit(name, current, numbered.count())

    # -- transactions
    def begin(self, name: str = "") -> None:
        self._saved.append((name, dict(self.tables)))

    def commit(self) -> None:
        if self.foreign_keys:
            for name, t in self.tables.items():
                self._parents(name, t, deferred=True)
        self._saved.clear()
        self.defer_foreign_keys = False

    def release(self, name: str) -> None:
        at = max((i for i, (n, _) in enumerate(self._saved) if n == name), default=None)
        if at is None:
            raise ConstraintError(f"no such savepoint: {name}")
        if at == 0:
            self.commit()
        else:
            del self._saved[at:]

    def rollback(self, to: str | None = None) -> None:
        while self._saved:
            name, tables = self._saved.pop()
            if to is None and self._saved or to is not None and name != to:
                continue
            self._restore(tables)
            if to is not None:
                self._saved.append((name, tables))
            return

    def _restore(self, tables: dict[str, Table]) -> None:
        """The tables of a snapshot, and no views of others."""
        for n in self.tables:
            if n not in tables:
                self.spark.catalog.dropTempView(n)
        self.tables = dict(tables)
        for n in self.tables:
            self.table(n).createOrReplaceTempView(n)

    @contextmanager
    def atomic(self):
        """A statement: all of its changes, or none."""
        tables, counts = dict(self.tables), (self.changes, self.total_changes)
        try:
            yield
        except Exception:
            self._restore(tables)
            self.changes, self.total_changes = counts
            raise

    # -- triggers: row programs on the driver, for small changes
    def on(self, name: str, event: str, program: Callable) -> None:
        self.triggers.setdefault((name, event), []).append(program)

    def _fire(self, name: str, event: str, rows: DataFrame) -> None:
        programs = self.triggers.get((name, event), ())
        if programs:
            for row in rows.toLocalIterator():
                for program in programs:
                    program(self, row)

    # -- checks
    @staticmethod
    def _full(columns) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))

    def _numbered(self, name: str, rows: DataFrame) -> DataFrame:
        """Null integer keys become the next numbers in the order of _at, a partition after the other by their counts;
        AUTOINCREMENT never uses one again."""
        t = self.tables[name]
        if t.rowid is None:
            return rows
        rows = rows.transform(self.cut)
        top = max(t.data.agg(F.max(t.rowid)).first()[0] or 0, rows.agg(F.max(t.rowid)).first()[0] or 0, self.sequences.get(name, 0) if t.autoincrement else 0)
        part = F.shiftright("_at", 33)  # the partition a row came in
        counts = dict(rows.where(F.col(t.rowid).isNull()).groupBy(part).count().collect())  # a row a partition
        if counts:
            before, total = {}, top
            for p in sorted(counts):
                before[p] = total
                total += counts[p]
            start = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), part)
            marked = rows.withColumn("_null", F.col(t.rowid).isNull())
            within = F.row_number().over(Window.partitionBy(part, "_null").orderBy("_at"))
            rows = marked.withColumn(t.rowid, F.when(F.col("_null"), start + within).otherwise(F.col(t.rowid)).cast("long")).drop("_null")
            top = total
        self.sequences[name] = self.last_insert_rowid = top
        return rows

    def _shaped(self, t: Table, rows: DataFrame) -> DataFrame:
        return rows.select(*((F.col(c) if c in rows.columns else F.lit(t.defaults.get(c))).cast(kind).alias(c) for c, kind in t.data.dtypes))

    @staticmethod
    def _with(t: Table, data: DataFrame) -> Table:
        return replace(t, data=data)

    def _put(self, name: str, t: Table) -> None:
        self.tables[name] = t
        self.table(name).createOrReplaceTempView(name)

    def _commit(self, name: str, data: DataFrame, changed: int, cascade: DataFrame | None = None) -> None:
        """Check the new version, its parents and the rows that refer to it; then it is the table."""
        t = self._with(self.tables[name], data.transform(self.cut))
        self._verify(name, t)
        if self.foreign_keys:
            self._parents(name, t)
        with self.atomic():
            self._put(name, t)
            if self.foreign_keys and cascade is not None:
                self._children(name, cascade)
        self.changes = changed
        self.total_changes += changed

    def _verify(self, name: str, t: Table) -> None:
        """NOT NULL and CHECK in one pass; uniqueness by counting keys, NULLs distinct."""
        tests = {f"NOT NULL constraint failed: {name}.{c}": F.col(c).isNull() for c in (*t.not_null,)}
        tests |= {f"CHECK constraint failed: {c}": ~F.coalesce(F.expr(e).cast("boolean"), F.lit(True)) for c, e in t.checks.items()}
        if tests:
            counted = t.data.agg(*(F.count_if(x).alias(str(i)) for i, x in enumerate(tests.values()))).first()
            for message, n in zip(tests, counted, strict=True):
                if n:
                    raise ConstraintError(message)
        for index, (keys, where) in t.partial.items():
            held = t.data.where(where).select(*(F.expr(k).alias(f"k{i}") for i, k in enumerate(keys)))
            if not held.where(self._full(held.columns)).groupBy(*held.columns).count().where("count > 1").isEmpty():
                raise ConstraintError(f"UNIQUE constraint failed: index '{index}'")
        for key in (k for k in (t.key, *t.unique) if k):
            if not t.data.where(self._full(key)).groupBy(*key).count().where("count > 1").isEmpty():
                raise ConstraintError(f"UNIQUE constraint failed: {', '.join(f'{name}.{c}' for c in key)}")

    def _parents(self, name: str, t: Table, deferred: bool = False) -> None:
        """Every key has its parent; deferred references wait for the commit of an open transaction."""
        for column, parent, target, _, _, late in map(_reference, t.references):
            if not deferred and self._saved and (late or self.defer_foreign_keys):
                continue
            child = t.data.where(F.col(column).isNotNull()).select(F.col(column).alias("_k"))
            above = t.data if parent == name else self.tables[parent].data
            if not child.join(above.select(F.col(target).alias("_k")), "_k", "left_anti").isEmpty():
                raise ConstraintError("FOREIGN KEY constraint failed")

    def _moved(self, name: str, moved: DataFrame) -> None:
        """ON UPDATE: ``moved`` holds each changed row as _old_c and c."""
        for child, t in list(self.tables.items()):
            for column, parent, target, _, action, late in map(_reference, t.references):
                if parent != name:
                    continue
                keys = moved.where(~F.col(f"_old_{target}").eqNullSafe(F.col(target))).select(F.col(f"_old_{target}").alias(column), F.col(target).alias("_to")).dropDuplicates([column])
                hit = t.data.join(keys, column, "left_semi")
                if hit.isEmpty():
                    continue
                if action in ("CASCADE", "SET NULL", "SET DEFAULT"):
                    kind = dict(t.data.dtypes)[column]
                    value = F.col("_to") if action == "CASCADE" else F.lit(t.defaults.get(column) if action == "SET DEFAULT" else None)
                    marked = t.data.join(keys.withColumn("_hit", F.lit(True)), column, "left")
                    self._commit(child, marked.select(*(F.when(F.col("_hit"), value.cast(kind)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in t.data.columns)), hit.count())
                elif not (self._saved and (late or self.defer_foreign_keys)):
                    raise ConstraintError("FOREIGN KEY constraint failed")

    def _children(self, name: str, gone: DataFrame) -> None:
        for child, t in list(self.tables.items()):
            for column, parent, target, action, _, late in map(_reference, t.references):
                if parent != name:
                    continue
                keys = gone.select(F.col(target).alias(column)).distinct()
                hit = t.data.join(keys, column, "left_semi")
                if hit.isEmpty():
                    continue
                if action == "CASCADE":
                    self._commit(child, t.data.join(keys, column, "left_anti"), hit.count(), cascade=hit)
                elif action in ("SET NULL", "SET DEFAULT"):
                    value = F.lit(t.defaults.get(column) if action == "SET DEFAULT" else None)
                    marked = t.data.join(keys.withColumn("_hit", F.lit(True)), column, "left")
                    self._commit(child, marked.select(*(F.when(F.col("_hit"), value.cast(k)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c, k in t.data.dtypes)), hit.count())
                elif not (self._saved and (late or self.defer_foreign_keys) and action == "NO ACTION"):
                    raise ConstraintError("FOREIGN KEY constraint failed")
