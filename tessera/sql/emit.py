"""From the tree to Spark SQL.

What Spark lacks is spelled in its own terms: collations and affinities as expressions, GROUPS frames as RANGE frames over
a dense rank, EXCLUDE as filters over the frame's rows, bare columns as max_by, min_by or first, compound selects bound
left to right, recursion by rounds where Spark's own form can't say it.
"""

from __future__ import annotations

import logging
import re
import uuid

from pyspark.errors import PySparkException
from pyspark.logger import PySparkLogger
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.recursion import recursive_union
from tessera.sql import calls as C
from tessera.sql import dates as D
from tessera.sql.calls import Arg
from tessera.sql.lexer import SqlError
from tessera.sql.parser import Core, Node, Over, Parser, Select, Source

SCALARS = C.SCALARS | D.SCALARS
AGGREGATES = {"count", "sum", "total", "avg", "min", "max", "group_concat", "string_agg", "json_group_array", "json_group_object"}
WINDOWED = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead", "first_value", "last_value", "nth_value"}
_KINDS = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "real", "double": "real", "string": "text", "binary": "blob", "boolean": "bool"}
_CLASS = {"integer": 0, "real": 0, "bool": 0, "text": 1, "blob": 2}


def _name(x: str) -> str:
    return "`" + x.replace("`", "``") + "`"


class Scope:
    """Sources in sight: (alias, {column: type} or None where Spark has to know), and the scope around."""

    def __init__(self, outer: Scope | None = None):
        self.sources: list[tuple[str, dict | None]] = []
        self.outer, self.aliases, self.bare, self.wrapped = outer, {}, None, None
        self.windows: dict[str, Over] = {}

    def kind(self, table: str | None, column: str) -> str | None:
        for alias, columns in self.sources:
            if (table is None or table.lower() == alias) and columns and column.lower() in columns:
                return columns[column.lower()]
        return self.outer.kind(table, column) if self.outer else None

    def has(self, column: str) -> bool:
        return any(columns is None or column.lower() in columns for _, columns in self.sources) or bool(self.outer and self.outer.has(column))


class Emitter:
    def __init__(self, spark: SparkSession, sql: str, args: tuple = (), named: dict | None = None, state: dict | None = None):
        self.spark, self.sql, self.args, self.named, self.state = spark, sql, args, named or {}, state or {}
        self.ctes: list[str] = []  # emitted before the select
        self.views: dict[str, str] = {}  # names that stand for temporary views
        self.recursive = False
        self.opened: frozenset[str] = frozenset()  # views being spelled out

    # -- selects
    def prefix(self) -> str:
        return f"WITH {'RECURSIVE ' * self.recursive}{', '.join(self.ctes)} " if self.ctes else ""

    def statement(self, sel: Select) -> str:
        out = self.select(sel, None, top=True)
        return self.prefix() + out

    def _schema(self, text: str) -> dict | None:
        quiet = PySparkLogger.getLogger("SQLQueryContextLogger")  # a text that doesn't stand alone is no error here
        level = quiet.level
        quiet.setLevel(logging.CRITICAL)
        try:
            fields = self.spark.sql(f"{self.prefix()}SELECT * FROM {text}").schema.fields
        except PySparkException:
            return None
        finally:
            quiet.setLevel(level)
        return {f.name.lower(): "real" if f.dataType.simpleString().startswith("decimal") else _KINDS.get(f.dataType.simpleString()) for f in fields}

    def select(self, sel: Select, outer: Scope | None, top: bool = False) -> str:
        for name, columns, inner in sel.ctes:
            self.cte(name, columns, inner, sel.recursive)
        cores = [self.core(c, outer, sel if len(sel.cores) == 1 else None, top) for c in sel.cores]
        out = cores[0]
        if len(cores) > 1:
            for operator, core in zip(sel.operators, cores[1:], strict=True):
                out = f"(({out}) {operator} ({core}))"
            scope = Scope(outer)
            if sel.order:
                out = f"SELECT * FROM {out} ORDER BY {', '.join(self.ordering(o, scope) for o in sel.order)}"
            elif top and sel.operators[-1] != "UNION ALL":
                names = self._schema(out)
                if names and len(names) > 0:
                    out = f"SELECT * FROM {out} ORDER BY {', '.join(str(i + 1) for i in range(len(names)))}"
            elif not out.startswith("SELECT"):
                out = f"SELECT * FROM {out}"
        return out + self.limits(sel)

    def limits(self, sel: Select) -> str:
        number = lambda n: int(re.sub(r"[()L ]", "", self.value(n, Scope())[0]))
        out = ""
        if sel.limit is not None and (n := number(sel.limit)) >= 0:
            out += f" LIMIT {n}"
        if sel.offset is not None and (n := number(sel.offset)) > 0:
            out += f" OFFSET {n}"
        return out

    def _names(self, sel: Select, name: str) -> bool:
        """Whether a select reads ``name``."""
        found = []

        def source(s: Source | None):
            if s is None:
                return
            if s.kind == "table" and s.name.lower() == name.lower():
                found.append(s)
            if s.select:
                visit(s.select)
            source(s.left)
            source(s.right)

        def visit(x: Select):
            for c in x.cores:
                source(c.source)
                for e in [*(i[0] for i in c.items), c.where, c.having, *c.group]:
                    for n in e.walk(True) if e is not None else ():
                        for p in n.parts:
                            if isinstance(p, Select):
                                visit(p)

        visit(sel)
        return bool(found)

    def cte(self, name: str, columns: list[str], inner: Select, recursive: bool) -> None:
        listed = f"({', '.join(map(_name, columns))})" if columns else ""
        own = [self._names(Select([c], []), name) for c in inner.cores]
        if not (recursive and any(own)):
            text = self.select(inner, None)
            if self.views.pop(name.lower(), None):
                pass
            self.ctes.append(f"{_name(name)}{listed} AS ({text})")
            return
        plain = len(own) == 2 and not own[0] and inner.operators == ["UNION ALL"] and not inner.order and inner.limit is None
        if plain:
            self.recursive = True
            seed = self.core(inner.cores[0], None, None)
            kinds = self._schema(f"({seed})")
            scope = list((kinds or {}).values())
            self.known = {name.lower(): dict(zip([c.lower() for c in columns] or list(kinds or {}), scope, strict=False))}
            self.ctes.append(f"{_name(name)}{listed} AS ({seed} UNION ALL {self.core(inner.cores[1], None, None)})")
            return
        seeds = [c for c, o in zip(inner.cores, own, strict=True) if not o]
        steps = [c for c, o in zip(inner.cores, own, strict=True) if o]
        distinct = "UNION" in inner.operators
        first = [self.spark.sql(self.prefix() + self.core(c, None, None)) for c in seeds]
        names = columns or first[0].columns
        first = [d.toDF(*names) for d in first]
        view = f"_rec_{uuid.uuid4().hex[:10]}"
        kinds = first[0].dtypes

        def run(step: Core):
            def make(frontier: DataFrame) -> DataFrame:
                frontier.createOrReplaceTempView(view)
                self.views[name.lower()] = view
                made = self.spark.sql(self.prefix() + self.core(step, None, None)).toDF(*names)
                return made.selectExpr(*(f"CAST({_name(c)} AS {k}) AS {_name(c)}" for c, k in kinds))

            return make

        most = None
        if inner.limit is not None:
            most = int(re.sub(r"\D", "", self.value(inner.limit, Scope())[0]) or 0) + (int(re.sub(r"\D", "", self.value(inner.offset, Scope())[0]) or 0) if inner.offset is not None else 0)
        found = recursive_union(first, [run(s) for s in steps], distinct, enough=most)
        found.createOrReplaceTempView(view + "_all")
        self.views[name.lower()] = view + "_all"
        if inner.limit is not None or inner.order:
            scope = Scope()
            order = f" ORDER BY {', '.join(self.ordering(o, scope) for o in inner.order)}" if inner.order else ""
            self.spark.sql(f"SELECT * FROM {view}_all{order}{self.limits(inner)}").createOrReplaceTempView(view + "_cut")
            self.views[name.lower()] = view + "_cut"

    def _shadowed(self, name: str) -> bool:
        return name.lower() in self.views or any(c.lower().startswith((f"{_name(name).lower()} as", f"{_name(name).lower()}(")) for c in self.ctes)

    def view(self, name: str) -> str:
        """A view's SELECT, spelled anew each time: it reads its tables as they are now."""
        if name in self.opened:
            raise SqlError(f"view {name} is circularly defined")
        text = self.state["views"][name][0]
        own = Emitter(self.spark, text, state=self.state)
        own.opened = self.opened | {name}
        return own.statement(Parser(text).select())

    def source(self, s: Source, scope: Scope) -> str:
        if s.kind == "table" and s.name.lower() in self.state.get("views", {}) and not self._shadowed(s.name):
            text = f"({self.view(s.name.lower())})"
            columns = self.state["views"][s.name.lower()][1]
            alias = s.alias or s.name
            kinds = self._schema(text)
            scope.sources.append((alias.lower(), dict(zip((c.lower() for c in columns), kinds.values(), strict=True)) if columns and kinds else kinds))
            return f"{text} AS {_name(alias)}" + (f"({', '.join(map(_name, columns))})" if columns else "")
        if s.kind == "table":
            real = self.views.get(s.name.lower(), s.name)
            columns = getattr(self, "known", {}).get(s.name.lower()) or self._schema(_name(real))
            if real == s.name and columns is None and (special := self.state.get("tables", {}).get(s.name.lower())):
                special().createOrReplaceTempView(real := f"_{s.name.replace('.', '_')}")
                columns = self._schema(_name(real))
            alias = s.alias or s.name
            scope.sources.append((alias.lower(), columns))
            return f"{_name(real)} AS {_name(alias)}"
        if s.kind == "select":
            text = f"({self.select(s.select, scope.outer)})"
            alias = s.alias or f"_s{len(scope.sources)}"
            scope.sources.append((alias.lower(), self._schema(text)))
            return f"{text} AS {_name(alias)}"
        if s.kind == "function":
            args = [self.value(a, scope) for a in s.args]
            alias = s.alias or s.name
            name = s.name.lower()
            if name.startswith("pragma_") and (special := self.state.get("pragma")):
                special(name[7:], *(str(a.parts[0]) for a in s.args)).createOrReplaceTempView(view := f"_{name}_{uuid.uuid4().hex[:6]}")
                scope.sources.append((alias.lower(), self._schema(view)))
                return f"{view} AS {_name(alias)}"
            scope.sources.append((alias.lower(), {"key": "text", "value": "text", "type": "text", "atom": "text", "id": "integer", "parent": "integer", "fullkey": "text", "path": "text"}))
            lateral = "LATERAL " if scope.sources[:-1] or scope.outer else ""
            return f"{lateral}{name}({', '.join(C.text_of(a) for a in args)}) AS {_name(alias)}"
        left = self.source(s.left, scope)
        right = self.source(s.right, scope)
        if s.right.kind == "join":
            right = f"({right})"
        if s.on is not None:
            tail = f" ON {C.truth_of(self.value(s.on, scope))}"
            kind = "INNER" if s.join == "CROSS" else s.join
        else:
            tail = f" USING ({', '.join(map(_name, s.using))})" if s.using else ""
            kind = "INNER" if tail and s.join == "CROSS" else "NATURAL INNER" if s.join == "NATURAL CROSS" else s.join
            kind = "CROSS" if kind == "INNER" and not tail else kind
        return f"{left} {kind} JOIN {right}{tail}"

    def core(self, c: Core, outer: Scope | None, sel: Select | None, top: bool = False) -> str:
        scope = Scope(outer)
        if c.values is not None:
            rows = [[self.shown(e, scope) for e in row] for row in c.values]
            return f"SELECT * FROM VALUES {', '.join('(' + ', '.join(r) + ')' for r in rows)} AS _v({', '.join(f'column{i + 1}' for i in range(len(rows[0])))})"
        origin = self.source(c.source, scope) if c.source else ""
        scope.windows = c.windows
        order = sel.order if sel else []
        everything = [*(e for e, _ in c.items), *([c.having] if c.having else []), *(o[0] for o in order)]
        called = [n for e in everything for n in e.walk() if n.kind == "call" and "over" not in n.options and n.parts[0] in AGGREGATES and not (n.parts[0] in ("min", "max") and len(n.parts[1]) > 1)]
        where = f" WHERE {C.truth_of(self.value(c.where, scope))}" if c.where is not None else ""
        special = [o for e in everything for n in e.walk() if "over" in n.options and (o := self.window(n.options["over"], scope)) and (o.exclude != "NO OTHERS" or o.frame and o.frame[0] == "GROUPS")]
        if special:
            if called or c.group:
                raise SqlError("GROUPS and EXCLUDE frames over aggregates need a subquery")
            origin, where = self.numbered(special, scope, origin, where), ""
        groups = [self.grouping(g, c, scope) for g in c.group]
        if called or c.group:
            extremes = [n for n in called if n.parts[0] in ("min", "max")]
            scope.bare = (set(groups), extremes[0] if len(extremes) == 1 else None)
        scope.aliases = {a.lower(): e for e, a in c.items if a}
        items = []
        for e, alias in c.items:
            if e.kind == "star":
                if scope.wrapped and e.parts[0] is None:
                    items.append(f"* EXCEPT ({', '.join(scope.wrapped)})")
                else:
                    items.append("*" if e.parts[0] is None else f"{_name(e.parts[0])}.*")
                continue
            begin, end = e.options.get("text", (0, 0))
            items.append(f"{self.shown(e, scope)} AS {_name(alias or (e.parts[1] if e.kind == 'column' else self.sql[begin:end].strip()))}")
        out = f"SELECT {'DISTINCT ' * c.distinct}{', '.join(items)}"
        out += f" FROM {origin}" * bool(origin) + where
        if groups:
            out += f" GROUP BY {', '.join(groups)}"
        if c.having is not None:
            out += f" HAVING {C.truth_of(self.value(c.having, scope))}"
        if order:
            out += f" ORDER BY {', '.join(self.ordering(o, scope) for o in order)}"
        elif top and groups and sel is not None:  # groups come in the order of their keys
            out += f" ORDER BY {', '.join(groups)}"
        elif top and c.distinct and sel is not None and all(e.kind != "star" for e, _ in c.items):
            out += f" ORDER BY {', '.join(str(i + 1) for i in range(len(c.items)))}"
        return out

    def grouping(self, g: Node, c: Core, scope: Scope) -> str:
        if g.kind == "number" and isinstance(g.parts[0], int):
            if not 1 <= g.parts[0] <= len(c.items):
                raise SqlError("a GROUP BY term is out of range")
            return self.value(c.items[g.parts[0] - 1][0], scope)[0]
        if g.kind == "column" and g.parts[0] is None and not scope.has(g.parts[1]):
            for e, alias in c.items:
                if alias and alias.lower() == g.parts[1].lower():
                    return self.value(e, scope)[0]
        return self.value(g, scope)[0]

    def ordering(self, o: tuple, scope: Scope) -> str:
        e, down, nulls = o
        if e.kind == "number" and isinstance(e.parts[0], int):
            out = str(e.parts[0])
        elif e.kind == "column" and e.parts[0] is None and e.parts[1].lower() in scope.aliases:
            out = _name(e.parts[1])
        else:
            out = self.value(e, scope)[0]
        return out + " DESC" * down + ("" if nulls is None else " NULLS FIRST" if nulls else " NULLS LAST")

    # -- windows
    def window(self, o: Over, scope: Scope) -> Over:
        """The window with its base windows merged in."""
        if o.base is None:
            return o
        if o.base not in scope.windows:
            raise SqlError(f"no such window: {o.base}")
        base = self.window(scope.windows[o.base], scope)
        if o.partition or (o.order and base.order) or base.frame and (o.order or o.frame):
            raise SqlError(f"cannot override window {o.base}")
        return Over(None, base.partition, o.order or base.order, o.frame or base.frame, o.exclude if o.frame else base.exclude)

    def numbered(self, special: list[Over], scope: Scope, origin: str, where: str) -> str:
        """The single source with row numbers and dense ranks that special frames count in."""
        if len(scope.sources) != 1:
            raise SqlError("GROUPS and EXCLUDE frames over joins need a subquery")
        added, alias = [], scope.sources[0][0]
        for o in special:
            by = self.partitioned(o, scope)
            key = f"{by}"
            if key not in (marks := getattr(scope, "marks", {})):
                marks[key] = len(marks)
                scope.marks = marks
                added += [f"dense_rank() OVER ({by}) AS _group{marks[key]}" if o.order else f"1 AS _group{marks[key]}", f"row_number() OVER ({by}{'' if o.order else ' ORDER BY 1'}) AS _row{marks[key]}"]
        scope.wrapped = [f"_{x}{i}" for i in range(len(scope.marks)) for x in ("group", "row")]
        return f"(SELECT *, {', '.join(added)} FROM {origin}{where}) AS {_name(alias)}"

    def partitioned(self, o: Over, scope: Scope) -> str:
        parts = []
        if o.partition:
            parts.append(f"PARTITION BY {', '.join(self.value(p, scope)[0] for p in o.partition)}")
        if o.order:
            plain = [(e, d, n) if e.kind != "number" else (Node("paren", [e]), d, n) for e, d, n in o.order]
            parts.append(f"ORDER BY {', '.join(self.ordering(x, Scope(scope)) for x in plain)}")
        return " ".join(parts)

    def over(self, n: Node, scope: Scope) -> Arg:
        o = self.window(n.options["over"], scope)
        name, args = n.parts
        by = self.partitioned(o, scope)
        if n.options.get("distinct"):
            raise SqlError("DISTINCT is not supported for window functions")
        if not o.order and name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"):
            by += " ORDER BY 1" if name in ("row_number", "ntile", "lag", "lead") else " ORDER BY NULL"
        mark = getattr(scope, "marks", {}).get(by if o.order else self.partitioned(o, scope))
        frame = self.framed(o, scope, mark)
        if name in ("row_number", "rank", "dense_rank", "ntile"):
            arg = re.sub(r"[()L]", "", self.value(args[0], scope)[0]) if args else ""
            return f"CAST({name}({arg}) OVER ({by}) AS BIGINT)", "integer"
        if name in ("percent_rank", "cume_dist"):
            return f"{name}() OVER ({by})", "real"
        if name in ("lag", "lead"):
            x = self.value(args[0], scope)
            offset = re.sub(r"[()L]", "", self.value(args[1], scope)[0]) if len(args) > 1 else "1"
            moved = f"{name}({x[0]}, {offset}) OVER ({by})"
            if len(args) > 2:  # any default, told from a null value by whether there is a row
                moved = f"if({name}(1, {offset}) OVER ({by}) IS NULL, {self.value(args[2], scope)[0]}, {moved})"
            return moved, x[1]
        if o.exclude != "NO OTHERS":
            return self.excluded(n, o, scope, mark, frame)
        if mark is not None and o.frame and o.frame[0] == "GROUPS":
            by = f"{by[: by.index('ORDER BY')] if o.order else by} ORDER BY _group{mark}"
        call, kind = self.aggregate(n, scope) if name in AGGREGATES else self.navigation(n, scope)
        if o.order or not frame or "ROWS" in frame:
            wrapped = call
        else:
            wrapped, frame = call, ""
        over = f" OVER ({by}{frame})"
        return wrapped.replace("\x00", over), kind

    def navigation(self, n: Node, scope: Scope) -> Arg:
        name, args = n.parts
        if name not in WINDOWED:
            raise SqlError(f"no such window function: {name}")
        x = self.value(args[0], scope)
        if name == "nth_value":
            return f"nth_value({x[0]}, {re.sub(r'[()L]', '', self.value(args[1], scope)[0])})\x00", x[1]
        return f"{name}({x[0]})\x00", x[1]

    def framed(self, o: Over, scope: Scope, mark) -> str:
        if not o.frame:
            return ""
        unit, low, high = o.frame

        def bound(b):
            kind, offset = b
            if kind in ("-INF", "INF"):
                return "UNBOUNDED " + ("PRECEDING" if kind == "-INF" else "FOLLOWING")
            if kind == "CURRENT":
                return "CURRENT ROW"
            return f"{re.sub(r'[()LD]', '', self.value(offset, scope)[0])} {kind}"

        return f" {'RANGE' if unit == 'GROUPS' else unit} BETWEEN {bound(low)} AND {bound(high)}"

    def excluded(self, n: Node, o: Over, scope: Scope, mark, frame: str) -> Arg:
        """A frame without some rows: its rows as an array, filtered and folded."""
        name, args = n.parts
        by = self.partitioned(o, scope)
        if o.frame and o.frame[0] == "GROUPS":
            by = f"{by[: by.index('ORDER BY')]} ORDER BY _group{mark}"
        xs = [self.value(a, scope) for a in args if a.kind != "star"]
        v = xs[0] if xs else ("1L", "integer")
        if name in ("sum", "total", "avg"):
            v = C.number_of(v)
        whole = not o.order and not o.frame or o.frame and o.frame[1][0] == "-INF" and o.frame[2][0] == "INF"
        if whole and name in ("count", "sum", "total", "avg") and not n.options.get("filter"):
            return self._difference(name, v, bool(xs), o, scope, mark)
        keep = {"CURRENT ROW": f"e.r <> _row{mark}", "GROUP": f"e.g <> _group{mark}", "TIES": f"(e.g <> _group{mark} OR e.r = _row{mark})"}[o.exclude]
        condition = f" FILTER (WHERE {C.truth_of(self.value(n.options['filter'], scope))})" if n.options.get("filter") else ""
        rows = f"array_sort(filter(collect_list(struct(_row{mark} AS r, _group{mark} AS g, {v[0]} AS v)){condition} OVER ({by}{frame}), e -> {keep}))"
        held = f"filter(transform({rows}, e -> e.v), x -> x IS NOT NULL)"
        added = f"aggregate({held}, CAST(0 AS {'BIGINT' if v[1] == 'integer' else 'DOUBLE'}), (a, x) -> a + x)"
        forms = {
            "count": (f"CAST(size({held if xs else rows}) AS BIGINT)", "integer"), "sum": (f"if(size({held}) > 0, {added}, NULL)", v[1]),
            "total": (f"aggregate({held}, 0D, (a, x) -> a + x)", "real"), "avg": (f"if(size({held}) > 0, aggregate({held}, 0D, (a, x) -> a + x) / size({held}), NULL)", "real"),
            "min": (f"array_min({held})", v[1]), "max": (f"array_max({held})", v[1]), "first_value": (f"get({rows}, 0).v", v[1]), "last_value": (f"try_element_at({rows}, -1).v", v[1]),
            "nth_value": (f"get({rows}, CAST({xs[1][0] if len(xs) > 1 else 1} AS INT) - 1).v", v[1]),
            "group_concat": (f"if(size({held}) > 0, array_join(transform({held}, x -> CAST(x AS STRING)), {C.text_of(xs[1]) if len(xs) > 1 else chr(39) + ',' + chr(39)}), NULL)", "text"),
            "json_group_array": (f"to_json(transform({rows}, e -> e.v), map('ignoreNullFields', 'false'))", "json"),
        }
        forms["string_agg"] = forms["group_concat"]
        if name not in forms:
            raise SqlError(f"{name}() doesn't take EXCLUDE")
        return forms[name]

    def _difference(self, name: str, v: Arg, given: bool, o: Over, scope: Scope, mark) -> Arg:
        """EXCLUDE over a whole partition without holding it: its sums less those of the row's peers, or of the row."""
        parts = ", ".join(self.value(p, scope)[0] for p in o.partition)
        every = f"PARTITION BY {parts}" if parts else ""
        peers = f"PARTITION BY {parts + ', ' if parts else ''}_group{mark}"
        x = v[0]
        own_n, own = (f"if(({x}) IS NULL, 0L, 1L)", f"coalesce({x}, 0)") if given else ("1L", "1L")

        def less(aggregate: str, one: str) -> str:
            gone = {"CURRENT ROW": one, "GROUP": f"{aggregate} OVER ({peers})", "TIES": f"({aggregate} OVER ({peers}) - {one})"}[o.exclude]
            return f"({aggregate} OVER ({every}) - {gone})"

        n = less(f"count({x if given else '*'})", own_n)
        if name == "count":
            return n, "integer"
        total = less(f"sum(coalesce({x}, 0))", own)
        if name == "total":
            return f"CAST({total} AS DOUBLE)", "real"
        return f"if({n} > 0, {total}{f' / {n}' if name == 'avg' else ''}, NULL)", "real" if name == "avg" else v[1]

    # -- aggregates; \x00 stands where OVER belongs
    def aggregate(self, n: Node, scope: Scope) -> Arg:
        name, args = n.parts
        if n.options.get("filter") and "over" in n.options:  # Spark has no filtered window aggregates
            only = lambda e: Node("case", [None, [(n.options["filter"], e)], None])
            first = Node("number", [1]) if not args or args[0].kind == "star" else args[0]
            n = Node("call", [name, [only(first), *args[1:]]], {k: v for k, v in n.options.items() if k != "filter"})
            args = n.parts[1]
        inner = Scope(scope.outer)
        inner.sources, inner.windows = scope.sources, scope.windows
        condition = f" FILTER (WHERE {C.truth_of(self.value(n.options['filter'], inner))})" if n.options.get("filter") else ""
        end = condition + "\x00"
        distinct = "DISTINCT " * bool(n.options.get("distinct"))
        if name == "count":
            x = "*" if not args or args[0].kind == "star" else self.value(args[0], inner)[0]
            return f"count({distinct}{x}){end}", "integer"
        xs = [self.value(a, inner) for a in args]
        x = xs[0]
        if name in ("min", "max"):
            return f"{name}({x[0]}){end}", x[1]
        if name == "sum":
            v = C.number_of(x)
            return f"sum({distinct}{v[0]}){end}", v[1]
        if name == "avg":
            return f"avg({distinct}{C.number_of(x)[0]}){end}", "real"
        if name == "total":
            return f"coalesce(sum({distinct}{C.real_of(x)}){end}, 0D)", "real"
        order = n.options.get("order")
        keys = ", ".join(self.ordering(o, Scope(inner)) for o in order) if order else ""
        if name in ("group_concat", "string_agg"):
            separator = C.text_of(xs[1]) if len(xs) > 1 else "','"
            return f"listagg({distinct}{C.text_of(x)}, {separator}){f' WITHIN GROUP (ORDER BY {keys})' if keys else ''}{end}", "text"
        members = C.json_value(x) if name == "json_group_array" else f"concat({C.json_value((C.text_of(x), 'text'))}, ':', {C.json_value(xs[1])})"
        left, right = "[]" if name == "json_group_array" else "{}"
        joined = f"listagg({distinct}{members}, ','){f' WITHIN GROUP (ORDER BY {keys})' if keys else ''}{end}"
        return f"concat('{left}', coalesce({joined}, ''), '{right}')", "json"

    # -- expressions
    def shown(self, n: Node, scope: Scope) -> str:
        sql, kind = self.value(n, scope)
        return f"CAST({sql} AS BIGINT)" if kind == "bool" else sql

    def value(self, n: Node, scope: Scope) -> Arg:
        if scope.bare and n.kind not in ("number", "string") and (own := self._ungrouped(n, scope)) is not None:
            return own
        return getattr(self, f"_{n.kind}")(n, scope)

    def _ungrouped(self, n: Node, scope: Scope) -> Arg | None:
        """A grouping expression as it stands; a bare column from the extremum's row, else from any row of the group."""
        groups, extreme = scope.bare
        plain = Scope(scope.outer)
        plain.sources, plain.windows = scope.sources, scope.windows
        if n.kind in ("call", "subquery", "exists", "in") and any(x.kind == "call" and x.parts[0] in AGGREGATES for x in n.walk()):
            return None
        if n.kind in ("subquery", "exists"):
            return None
        found = self.value(n, plain)
        if found[0] in groups:
            return found
        if n.kind != "column":
            return None
        if n.parts[0] is None and not scope.has(n.parts[1]) and n.parts[1].lower() in scope.aliases:
            return None
        if scope.outer is not None and scope.outer.kind(*n.parts) is not None and all(c is not None and n.parts[1].lower() not in c for _, c in scope.sources):
            return None
        if extreme is None:
            return f"first({found[0]})", found[1]
        of = self.value(extreme.parts[1][0], plain)[0]
        return f"{extreme.parts[0]}_by({found[0]}, {of})", found[1]

    def _number(self, n: Node, scope) -> Arg:
        x = n.parts[0]
        if isinstance(x, int) and x < 1 << 63:
            return f"{x}L", "integer"
        return ("double('Infinity')" if float(x) == float("inf") else f"{float(x)!r}D"), "real"

    def _string(self, n: Node, scope) -> Arg:
        return C.literal(n.parts[0]), "text"

    def _blob(self, n: Node, scope) -> Arg:
        return f"X'{n.parts[0]}'", "blob"

    def _null(self, n: Node, scope) -> Arg:
        return "NULL", None

    def _param(self, n: Node, scope: Scope) -> Arg:
        key = n.parts[0]
        if isinstance(key, int):
            x = self.args[key - 1] if key <= len(self.args) else None
        else:
            x = self.named.get(key)
        if x is None:
            return "NULL", None
        if isinstance(x, bool | int):
            return (f"{int(x)}L", "integer") if x >= 0 else (f"(-{-x}L)", "integer")
        if isinstance(x, float):
            return f"double('{x}')", "real"
        if isinstance(x, bytes):
            return f"X'{x.hex()}'", "blob"
        return C.literal(str(x)), "text"

    def _paren(self, n: Node, scope: Scope) -> Arg:
        sql, kind = self.value(n.parts[0], scope)
        return f"({sql})", kind

    def _column(self, n: Node, scope: Scope) -> Arg:
        table, column = n.parts
        kind = scope.kind(table, column)
        if table is None and kind is None and not scope.has(column) and column.lower() in scope.aliases:
            return _name(column), self.value(scope.aliases[column.lower()], scope)[1] if not scope.bare else None
        return (f"{_name(table)}." if table else "") + _name(column), kind

    def _row(self, n: Node, scope: Scope) -> Arg:
        return f"struct({', '.join(self.value(x, scope)[0] for x in n.parts)})", None

    def _unary(self, n: Node, scope: Scope) -> Arg:
        op, inner = n.parts
        x = self.value(inner, scope)
        if op == "NOT":
            return f"(NOT {C.truth_of(x)})", "bool"
        if op == "~":
            return f"(~{C.integer_of(x)})", "integer"
        if op == "+":
            return x
        if inner.kind == "number" and inner.parts[0] == 1 << 63:
            return "(-9223372036854775807L - 1L)", "integer"
        v = C.number_of(x)
        return f"(-{v[0]})", v[1]

    def _collated(self, n: Node, scope: Scope) -> str | None:
        for x in n.walk():
            if x.kind == "collate":
                return x.parts[1]
        return None

    def _collate(self, n: Node, scope: Scope) -> Arg:
        x = self.value(n.parts[0], scope)
        name = n.parts[1]
        if name not in ("BINARY", "NOCASE", "RTRIM"):
            raise SqlError(f"no such collation sequence: {name}")
        if x[1] in ("integer", "real", "bool", "blob") or name == "BINARY":
            return x
        return (C.lower(C.text_of(x)) if name == "NOCASE" else f"rtrim({C.text_of(x)})"), "text"

    def _compare(self, op: str, a: Node, b: Node, scope: Scope) -> str:
        if a.kind == "row" or b.kind == "row":
            return self._rows(op, a, b, scope)
        name = next((x.parts[1] for x in (a, b) if x.kind == "collate"), None)
        if name:
            a, b = (x if x.kind == "collate" else Node("collate", [x, name]) for x in (a, b))
        x, y = self.value(a, scope), self.value(b, scope)
        x, y = ((f"CAST({v[0]} AS BIGINT)", "integer") if v[1] == "bool" else v for v in (x, y))
        ranks = [_CLASS.get(v[1]) for v in (x, y)]
        if None not in ranks and ranks[0] != ranks[1]:
            columns = [n.kind in ("column", "cast") or n.kind == "paren" and n.parts[0].kind == "column" for n in (a, b)]
            for i, (v, w) in enumerate(((x, y), (y, x))):
                if ranks[i] == 0 and ranks[1 - i] == 1 and columns[i]:  # a numeric column pulls the text along
                    w = (f"try_cast({w[0]} AS DOUBLE)", "real")
                    x, y = (v, w) if i == 0 else (w, v)
                    break
                if ranks[i] == 1 and ranks[1 - i] == 0 and columns[i]:
                    w = (C.text_of(w), "text")
                    x, y = (v, w) if i == 0 else (w, v)
                    break
            else:  # storage classes differ: numbers before text before blobs
                known = {"=": False, "<>": True, "<": ranks[0] < ranks[1], "<=": ranks[0] < ranks[1], ">": ranks[0] > ranks[1], ">=": ranks[0] > ranks[1]}[op]
                return f"if(({x[0]}) IS NULL OR ({y[0]}) IS NULL, NULL, {str(known).lower()})"
        return f"({x[0]} {op} {y[0]})"

    def _rows(self, op: str, a: Node, b: Node, scope: Scope) -> str:
        if a.kind == "subquery" or b.kind == "subquery":
            return f"({self.value(a, scope)[0]} {op} {self.value(b, scope)[0]})"
        if len(a.parts) != len(b.parts):
            raise SqlError("row value misused")
        pairs = list(zip(a.parts, b.parts, strict=True))
        if op in ("=", "<>"):
            out = " AND ".join(self._compare("=", x, y, scope) for x, y in pairs)
            return f"({out})" if op == "=" else f"(NOT ({out}))"
        out = self._compare(op, *pairs[-1], scope)
        for x, y in pairs[-2::-1]:
            out = f"({self._compare(op[0], x, y, scope)} OR ({self._compare('=', x, y, scope)} AND {out}))"
        return out

    def _binary(self, n: Node, scope: Scope) -> Arg:
        op, a, b = n.parts
        if op in ("AND", "OR"):
            return f"({C.truth_of(self.value(a, scope))} {op} {C.truth_of(self.value(b, scope))})", "bool"
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self._compare(op, a, b, scope), "bool"
        x, y = self.value(a, scope), self.value(b, scope)
        if op == "||":
            return f"concat({C.text_of(x)}, {C.text_of(y)})", "text"
        if op in ("->", "->>"):
            path = C.text_of(y) if y[1] != "integer" else f"concat('$[', if({y[0]} < 0, '#', ''), {y[0]}, ']')"
            path = f"tessera_json_path({path})" if y[1] != "integer" and not (b.kind == "string" and b.parts[0].startswith("$")) else path
            return (f"tessera_json_node({C.text_of(x)}, {path})", "json") if op == "->" else (f"tessera_json_text({C.text_of(x)}, {path})", "text")
        if op in ("&", "|"):
            return f"({C.integer_of(x)} {op} {C.integer_of(y)})", "integer"
        if op in ("<<", ">>"):
            v, k = C.integer_of(x), C.integer_of(y)
            left = lambda n: f"if({n} < 64, shiftleft({v}, CAST({n} AS INT)), 0L)"
            right = lambda n: f"shiftright({v}, CAST(least({n}, 63L) AS INT))"
            one, other = (left, right) if op == "<<" else (right, left)
            return f"if({v} IS NULL OR {k} IS NULL, NULL, if({k} >= 0, {one(k)}, {other(f'(-{k})')}))", "integer"
        x, y = C.number_of(x), C.number_of(y)
        whole = x[1] == y[1] == "integer"
        if op == "%":
            return f"try_mod({C.integer_of(x)}, {C.integer_of(y)})", "integer"
        if op == "/":
            return (f"({x[0]} div nullif({y[0]}, 0L))", "integer") if whole else (f"try_divide(CAST({x[0]} AS DOUBLE), CAST({y[0]} AS DOUBLE))", "real") if "real" in (x[1], y[1]) else (f"try_divide({x[0]}, {y[0]})", None)
        return f"({x[0]} {op} {y[0]})", "integer" if whole else "real" if "real" in (x[1], y[1]) else None

    def _is(self, n: Node, scope: Scope) -> Arg:
        a, b, no = n.parts
        if b.kind == "null":
            return f"({self.value(a, scope)[0]} IS {'NOT ' * no}NULL)", "bool"
        same = self._compare("=", a, b, scope)
        x, y = self.value(a, scope)[0], self.value(b, scope)[0]
        return f"({'NOT ' * no}coalesce({same}, ({x}) IS NULL AND ({y}) IS NULL))", "bool"

    def _truth(self, n: Node, scope: Scope) -> Arg:
        a, wanted, no = n.parts
        t = C.truth_of(self.value(a, scope))
        return f"({'NOT ' * no}coalesce({t if wanted else f'(NOT {t})'}, false))", "bool"

    def _between(self, n: Node, scope: Scope) -> Arg:
        x, low, high, no = n.parts
        return f"({'NOT ' * no}({self._compare('>=', x, low, scope)} AND {self._compare('<=', x, high, scope)}))", "bool"

    def _like(self, n: Node, scope: Scope) -> Arg:
        op, x, pattern, escape, no = n.parts
        return f"({'NOT ' * no}{C.like(op, self.value(x, scope), self.value(pattern, scope), self.value(escape, scope) if escape else None)})", "bool"

    def _in(self, n: Node, scope: Scope) -> Arg:
        x, members, no = n.parts
        if isinstance(members, Select):
            left = f"({', '.join(self.value(p, scope)[0] for p in x.parts)})" if x.kind == "row" else self.value(x, scope)[0]
            return f"({left} {'NOT ' * no}IN ({self.select(members, scope)}))", "bool"
        if not members:
            return ("true" if no else "false"), "bool"
        return f"({'NOT ' * no}({' OR '.join(self._compare('=', x, m, scope) for m in members)}))", "bool"

    def _exists(self, n: Node, scope: Scope) -> Arg:
        return f"EXISTS ({self.select(n.parts[0], scope)})", "bool"

    def _subquery(self, n: Node, scope: Scope) -> Arg:
        inner = n.parts[0]
        text = self.select(inner, scope)
        kinds = self._schema(f"({text})")
        if kinds is not None and inner.limit is None:  # it stands alone: its first row counts
            text += " LIMIT 1"
        kind = next(iter(kinds.values())) if kinds and len(kinds) == 1 else None
        if kinds is None and len(inner.cores) == 1 and inner.cores[0].items:
            e = inner.cores[0].items[0][0]
            kind = "integer" if e.kind == "call" and e.parts[0] == "count" else None
        return f"({text})", kind

    def _case(self, n: Node, scope: Scope) -> Arg:
        base, whens, otherwise = n.parts
        kinds, out = set(), "CASE"
        for condition, result in whens:
            test = self._compare("=", base, condition, scope) if base is not None else C.truth_of(self.value(condition, scope))
            x = self.value(result, scope)
            kinds |= {x[1]} if result.kind != "null" else set()
            out += f" WHEN {test} THEN {x[0]}"
        if otherwise is not None:
            x = self.value(otherwise, scope)
            kinds |= {x[1]} if otherwise.kind != "null" else set()
            out += f" ELSE {x[0]}"
        return out + " END", next(iter(kinds)) if len(kinds) == 1 else "real" if kinds == {"integer", "real"} else None

    def _cast(self, n: Node, scope: Scope) -> Arg:
        return C.cast(self.value(n.parts[0], scope), n.parts[1])

    def _call(self, n: Node, scope: Scope) -> Arg:
        name, args = n.parts
        if "over" in n.options:
            if name not in AGGREGATES | WINDOWED:
                raise SqlError(f"{name}() may not be used as a window function")
            return self.over(n, scope)
        if name in AGGREGATES and not (name in ("min", "max") and len(args) > 1):
            sql, kind = self.aggregate(n, scope)
            return sql.replace("\x00", ""), kind
        if name in WINDOWED:
            raise SqlError(f"misuse of window function {name}()")
        if name in self.state.get("values", {}):
            return f"{int(self.state['values'][name]())}L", "integer"
        if name not in SCALARS:
            raise SqlError(f"no such function: {name}")
        try:
            return SCALARS[name]([self.value(a, scope) for a in args])
        except IndexError:
            raise SqlError(f"wrong number of arguments to function {name}()") from None


def translate(spark: SparkSession, sql: str, args: tuple = (), named: dict | None = None, state: dict | None = None) -> str:
    """The Spark SQL of one SELECT, VALUES or WITH statement."""
    p = Parser(sql)
    tree = p.select()
    p.finish()
    return Emitter(spark, sql, args, named, state).statement(tree)


def expression(spark: SparkSession, sql: str, sources: list[tuple[str, dict]], args: tuple = (), state: dict | None = None) -> str:
    """The Spark SQL of one expression over named sources."""
    p = Parser(sql)
    tree = p.expression()
    p.finish()
    scope = Scope()
    scope.sources = sources
    return Emitter(spark, sql, args, None, state).shown(tree, scope)
