"""A recursive-descent parser for SELECT, VALUES and WITH; expressions by precedence climbing."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.sql.lexer import SqlError, Token, tokens


@dataclass
class Node:
    """An expression: its kind, operands and options."""

    kind: str
    parts: list = field(default_factory=list)
    options: dict = field(default_factory=dict)

    def walk(self, into_selects: bool = False):
        yield self
        for x in [*self.parts, *self.options.values()]:
            yield from _walk(x, into_selects)


def _walk(x, into_selects: bool):
    if isinstance(x, Node):
        yield from x.walk(into_selects)
    elif isinstance(x, list | tuple):
        for y in x:
            yield from _walk(y, into_selects)
    elif isinstance(x, Over):
        yield from _walk([x.partition, [o[0] for o in x.order]], into_selects)


@dataclass
class Over:
    base: str | None = None
    partition: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expression, descending, nulls first or None)
    frame: tuple | None = None  # unit, (bound, offset), (bound, offset)
    exclude: str = "NO OTHERS"


@dataclass
class Source:
    kind: str  # table, select, function, join
    name: str = ""
    alias: str | None = None
    select: Select | None = None
    args: list = field(default_factory=list)
    left: Source | None = None
    right: Source | None = None
    join: str = ""
    on: Node | None = None
    using: list[str] = field(default_factory=list)


@dataclass
class Core:
    items: list = field(default_factory=list)  # (expression, alias)
    distinct: bool = False
    source: Source | None = None
    where: Node | None = None
    group: list = field(default_factory=list)
    having: Node | None = None
    windows: dict = field(default_factory=dict)
    values: list | None = None


@dataclass
class Select:
    cores: list[Core]
    operators: list[str]
    ctes: list = field(default_factory=list)  # (name, columns, Select)
    recursive: bool = False
    order: list = field(default_factory=list)
    limit: Node | None = None
    offset: Node | None = None


_BINARY = {"OR": 1, "AND": 2, "=": 4, "==": 4, "!=": 4, "<>": 4, "<": 5, "<=": 5, ">": 5, ">=": 5, "&": 6, "|": 6, "<<": 6, ">>": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "||": 9, "->": 9, "->>": 9}
_CLOSING = {"FROM", "WHERE", "GROUP", "HAVING", "WINDOW", "ORDER", "LIMIT", "UNION", "INTERSECT", "EXCEPT", "ON", "USING", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "OUTER", "AS", "SET", "RETURNING", "OFFSET", "INDEXED", "NOT", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "COLLATE", "DO"}


class Parser:
    def __init__(self, sql: str):
        self.tokens, self.at, self.params = tokens(sql), 0, 0

    # -- tokens
    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def peek(self, *words: str) -> bool:
        return all(self.tokens[min(self.at + i, len(self.tokens) - 1)].upper == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"near {self.next.text or 'the end'!r}: syntax error, {' '.join(words)} is missing")

    def word(self) -> str:
        t = self.next
        if t.kind not in ("word", "name", "string"):
            raise SqlError(f"near {t.text or 'the end'!r}: syntax error, a name is missing")
        self.at += 1
        return t.text

    def listed(self, item) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def names(self) -> list[str]:
        self.need("(")
        out = self.listed(self.word)
        self.need(")")
        return out

    def finish(self) -> None:
        if self.next.kind != "end":
            raise SqlError(f"near {self.next.text!r}: syntax error")

    # -- selects
    def select(self) -> Select:
        ctes, recursive = [], False
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            ctes = self.listed(self.cte)
        cores, operators = [self.core()], []
        while self.peek("UNION") or self.peek("INTERSECT") or self.peek("EXCEPT"):
            word = self.word().upper()
            operators.append(word + " ALL" * (word == "UNION" and self.take("ALL")))
            cores.append(self.core())
        out = Select(cores, operators, ctes, recursive)
        if self.take("ORDER", "BY"):
            out.order = self.listed(self.ordering)
        if self.take("LIMIT"):
            out.limit = self.expression()
            if self.take("OFFSET"):
                out.offset = self.expression()
            elif self.take(","):
                out.offset, out.limit = out.limit, self.expression()
        return out

    def cte(self):
        name = self.word()
        columns = self.names() if self.peek("(") else []
        self.need("AS")
        self.take("NOT", "MATERIALIZED") or self.take("MATERIALIZED")
        self.need("(")
        inner = self.select()
        self.need(")")
        return name, columns, inner

    def core(self) -> Core:
        if self.take("VALUES"):
            return Core(values=self.listed(self.value_row))
        self.need("SELECT")
        out = Core(distinct=self.take("DISTINCT"))
        self.take("ALL")
        out.items = self.listed(self.item)
        if self.take("FROM"):
            out.source = self.sources()
        if self.take("WHERE"):
            out.where = self.expression()
        if self.take("GROUP", "BY"):
            out.group = self.listed(self.expression)
        if self.take("HAVING"):
            out.having = self.expression()
        if self.take("WINDOW"):
            for name, over in self.listed(self.named_window):
                out.windows[name.lower()] = over
        return out

    def value_row(self) -> list[Node]:
        self.need("(")
        out = self.listed(self.expression)
        self.need(")")
        return out

    def named_window(self):
        name = self.word()
        self.need("AS")
        return name, self.over()

    def item(self):
        if self.take("*"):
            return Node("star", [None]), None
        t, dot, star = (self.tokens[min(self.at + i, len(self.tokens) - 1)] for i in range(3))
        if t.kind in ("word", "name") and dot.text == "." and star.text == "*" and star.kind == "sign":
            self.at += 3
            return Node("star", [t.text]), None
        begin = self.next.at
        e = self.expression()
        e.options.setdefault("text", (begin, self.next.at))
        return e, self.alias()

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.word()
        t = self.next
        if t.kind in ("name", "string") or t.kind == "word" and t.upper not in _CLOSING:
            self.at += 1
            return t.text
        return None

    def sources(self) -> Source:
        left = self.source()
        while True:
            natural = self.take("NATURAL")
            kind = None
            if self.take(","):
                kind = "CROSS"
            elif self.peek("JOIN") or self.peek("INNER"):
                self.take("INNER")
                kind = "INNER"
            elif self.peek("CROSS", "JOIN"):
                self.take("CROSS")
                kind = "CROSS"
            elif self.next.upper in ("LEFT", "RIGHT", "FULL"):
                kind = self.word().upper()
                self.take("OUTER")
            if kind is None:
                return left
            if self.tokens[self.at - 1].text != ",":
                self.need("JOIN")
            out = Source("join", left=left, right=self.source(), join=("NATURAL " if natural else "") + kind)
            if self.take("ON"):
                out.on = self.expression()
            elif self.peek("USING"):
                self.need("USING")
                out.using = self.names()
            left = out

    def source(self) -> Source:
        if self.take("("):
            if self.peek("SELECT") or self.peek("VALUES") or self.peek("WITH"):
                out = Source("select", select=self.select())
                self.need(")")
                out.alias = self.alias()
                return out
            out = self.sources()
            self.need(")")
            return out
        name = self.word()
        if self.take("."):
            name = f"{name}.{self.word()}"
        if self.take("("):
            args = [] if self.peek(")") else self.listed(self.expression)
            self.need(")")
            return Source("function", name, self.alias(), args=args)
        out = Source("table", name, self.alias())
        self.take("NOT", "INDEXED") or self.take("INDEXED", "BY") and self.word()
        return out

    def ordering(self):
        e = self.expression()
        down = not self.take("ASC") and self.take("DESC")
        nulls = True if self.take("NULLS", "FIRST") else False if self.take("NULLS", "LAST") else None
        return e, down, nulls

    def over(self) -> Over:
        self.need("(")
        out = Over()
        if self.next.kind in ("word", "name") and self.next.upper not in ("PARTITION", "ORDER", "ROWS", "RANGE", "GROUPS"):
            out.base = self.word().lower()
        if self.take("PARTITION", "BY"):
            out.partition = self.listed(self.expression)
        if self.take("ORDER", "BY"):
            out.order = self.listed(self.ordering)
        if self.next.upper in ("ROWS", "RANGE", "GROUPS"):
            unit = self.word().upper()
            if self.take("BETWEEN"):
                low = self.bound()
                self.need("AND")
                high = self.bound()
            else:
                low, high = self.bound(), ("CURRENT", None)
            rank = {"-INF": 0, "PRECEDING": 1, "CURRENT": 2, "FOLLOWING": 3, "INF": 4}
            if low[0] == "INF" or high[0] == "-INF" or rank[low[0]] > rank[high[0]]:
                raise SqlError("unsupported frame specification")
            if (unit == "GROUPS" or unit == "RANGE" and (low[1] or high[1])) and len(out.order) != 1 and not (unit == "GROUPS" and out.order or out.base):
                raise SqlError(f"{unit} frames with offsets need an ORDER BY")
            out.frame = unit, low, high
            if self.take("EXCLUDE"):
                out.exclude = next((x for x in ("NO OTHERS", "CURRENT ROW", "GROUP", "TIES") if self.take(*x.split())), "")
                if not out.exclude:
                    raise SqlError("unsupported frame exclusion")
        self.need(")")
        return out

    def bound(self):
        if self.take("UNBOUNDED"):
            return ("-INF" if self.take("PRECEDING") else "INF" if self.take("FOLLOWING") else self.need("PRECEDING"), None)
        if self.take("CURRENT", "ROW"):
            return "CURRENT", None
        offset = self.expression()
        if offset.kind == "unary" or offset.kind == "number" and not isinstance(offset.parts[0], int | float):
            raise SqlError("frame offsets must be non-negative numbers")
        return ("PRECEDING" if self.take("PRECEDING") else "FOLLOWING" if self.take("FOLLOWING") else self.need("FOLLOWING"), offset)

    # -- expressions
    def expression(self, least: int = 0) -> Node:
        left = self.prefix()
        while True:
            t = self.next
            word = t.upper
            if word in _BINARY:
                level = _BINARY[word]
                if level < least:
                    return left
                self.at += 1
                left = Node("binary", [{"==": "=", "!=": "<>"}.get(word, word), left, self.expression(level + 1)])
                continue
            if word == "COLLATE":
                self.at += 1
                left = Node("collate", [left, self.word().upper()])
                continue
            if least > 4:
                return left
            negated = word == "NOT" and self.tokens[self.at + 1].upper in ("IN", "BETWEEN", "LIKE", "GLOB", "NULL", "REGEXP", "MATCH")
            if negated:
                self.at += 1
                word = self.next.upper
            if word == "IS":
                self.at += 1
                no = self.take("NOT")
                if self.take("DISTINCT", "FROM"):
                    left = Node("is", [left, self.expression(5), not no])
                elif self.next.upper in ("TRUE", "FALSE"):
                    left = Node("truth", [left, self.word().upper() == "TRUE", no])
                else:
                    left = Node("is", [left, self.expression(5), no])
            elif word == "ISNULL" or word == "NOTNULL":
                self.at += 1
                left = Node("is", [left, Node("null"), word == "NOTNULL"])
            elif word == "NULL" and negated:
                self.at += 1
                left = Node("is", [left, Node("null"), True])
            elif word == "BETWEEN":
                self.at += 1
                low = self.expression(5)
                self.need("AND")
                left = Node("between", [left, low, self.expression(5), negated])
            elif word in ("LIKE", "GLOB"):
                self.at += 1
                pattern = self.expression(5)
                left = Node("like", [word, left, pattern, self.expression(5) if self.take("ESCAPE") else None, negated])
            elif word == "IN":
                self.at += 1
                left = Node("in", [left, self.members(), negated])
            else:
                return left

    def members(self):
        if not self.take("("):
            name = self.word()
            if self.peek("("):
                self.at -= 1
                return Select([Core(items=[(Node("star", [None]), None)], source=self.source())], [])
            return Select([Core(items=[(Node("star", [None]), None)], source=Source("table", name))], [])
        if self.peek("SELECT") or self.peek("VALUES") or self.peek("WITH"):
            out = self.select()
        else:
            out = [] if self.peek(")") else self.listed(self.expression)
        self.need(")")
        return out

    def prefix(self) -> Node:
        t = self.next
        word = t.upper
        if t.kind == "number":
            self.at += 1
            text = t.text.replace("_", "")
            return Node("number", [int(text, 16) if text[:2] in ("0x", "0X") else float(text) if any(c in text for c in ".eE") else int(text)])
        if t.kind in ("string", "blob"):
            self.at += 1
            return Node(t.kind, [t.text])
        if t.kind == "param":
            self.at += 1
            if t.text == "?":
                self.params += 1
            elif t.text[0] == "?":
                self.params = max(self.params, int(t.text[1:]))
            return Node("param", [self.params if t.text == "?" else int(t.text[1:]) if t.text[0] == "?" else t.text[1:]])
        if word in ("-", "+", "~"):
            self.at += 1
            return Node("unary", [word, self.expression(10)])
        if word == "(":
            self.at += 1
            if self.peek("SELECT") or self.peek("VALUES") or self.peek("WITH"):
                out = Node("subquery", [self.select()])
            else:
                inside = self.listed(self.expression)
                out = inside[0] if len(inside) == 1 else Node("row", inside)
                out = Node("paren", [out]) if len(inside) == 1 else out
            self.need(")")
            return out
        if t.kind == "name":
            return self.column()
        if t.kind != "word":
            raise SqlError(f"near {t.text or 'the end'!r}: syntax error")
        if word == "NOT":
            self.at += 1
            if self.peek("EXISTS"):
                out = self.prefix()
                return Node("unary", ["NOT", out])
            return Node("unary", ["NOT", self.expression(3)])
        if word == "EXISTS":
            self.need("EXISTS", "(")
            inner = self.select()
            self.need(")")
            return Node("exists", [inner])
        if word == "CASE":
            return self.case()
        if word == "CAST":
            self.need("CAST", "(")
            inner = self.expression()
            self.need("AS")
            kind = []
            while not self.peek(")"):
                if self.take("("):
                    while not self.take(")"):
                        self.at += 1
                    continue
                kind.append(self.word())
            self.need(")")
            return Node("cast", [inner, " ".join(kind)])
        if self.tokens[self.at + 1].text == "(" and self.tokens[self.at + 1].kind == "sign":
            return self.call()
        simple = {"NULL": Node("null"), "TRUE": Node("number", [1]), "FALSE": Node("number", [0])}
        if word in simple:
            self.at += 1
            return simple[word]
        if word in ("CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP"):
            self.at += 1
            return Node("call", [{"CURRENT_DATE": "date", "CURRENT_TIME": "time", "CURRENT_TIMESTAMP": "datetime"}[word], [Node("string", ["now"])]])
        return self.column()

    def column(self) -> Node:
        names = [self.word()]
        while self.take("."):
            names.append(self.word())
        return Node("column", [names[-2] if len(names) > 1 else None, names[-1]])

    def case(self) -> Node:
        self.need("CASE")
        base = None if self.peek("WHEN") else self.expression()
        whens = []
        while self.take("WHEN"):
            condition = self.expression()
            self.need("THEN")
            whens.append((condition, self.expression()))
        otherwise = self.expression() if self.take("ELSE") else None
        self.need("END")
        return Node("case", [base, whens, otherwise])

    def call(self) -> Node:
        name = self.word().lower()
        self.need("(")
        out = Node("call", [name, []])
        out.options["distinct"] = self.take("DISTINCT")
        if self.take("*"):
            out.parts[1] = [Node("star", [None])]
        elif not self.peek(")"):
            out.parts[1] = self.listed(self.expression)
            if self.take("ORDER", "BY"):
                out.options["order"] = self.listed(self.ordering)
        self.need(")")
        if self.take("FILTER", "("):
            self.need("WHERE")
            out.options["filter"] = self.expression()
            self.need(")")
        if self.take("OVER"):
            out.options["over"] = self.over() if self.peek("(") else Over(base=self.word().lower())
        return out


def parse_select(sql: str) -> Select:
    p = Parser(sql)
    out = p.select()
    p.take(";")
    p.finish()
    return out


def parse_expression(sql: str) -> Node:
    p = Parser(sql)
    out = p.expression()
    p.finish()
    return out
