"""The grammar of statements that change tables or the schema; expressions stay trees, bodies keep their text."""

from __future__ import annotations

from dataclasses import dataclass, field

from tessera.sql.lexer import SqlError
from tessera.sql.parser import Node, Parser, Select, Source

_POLICIES = ("ABORT", "FAIL", "IGNORE", "REPLACE", "ROLLBACK")


@dataclass
class Clause:
    """ON CONFLICT: target expressions (None for any), and the assignments of DO UPDATE (None for DO NOTHING)."""

    target: list[Node] | None
    partial: Node | None
    sets: list | None
    where: Node | None


@dataclass
class Change:
    kind: str
    table: str
    alias: str | None = None
    policy: str = "ABORT"
    columns: list[str] = field(default_factory=list)
    select: Select | None = None
    sets: list = field(default_factory=list)  # (columns, expression)
    source: Source | None = None
    where: Node | None = None
    clauses: list[Clause] = field(default_factory=list)
    returning: list = field(default_factory=list)
    ctes: list = field(default_factory=list)
    recursive: bool = False


@dataclass
class Column:
    name: str
    kind: str = ""
    key: bool = False
    autoincrement: bool = False
    unique: bool = False
    not_null: bool = False
    default: Node | None = None
    checks: list = field(default_factory=list)  # (text, expression)
    references: tuple | None = None
    generated: Node | None = None
    stored: bool = False


@dataclass
class Definition:
    name: str
    columns: list[Column]
    key: list[str] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)
    checks: list = field(default_factory=list)
    references: list = field(default_factory=list)


@dataclass
class Trigger:
    name: str
    when: str  # BEFORE, AFTER, INSTEAD OF
    event: str
    columns: list[str]
    table: str
    condition: tuple[int, int] | None  # in the statement's text
    body: list[tuple[int, int]] = field(default_factory=list)


class ChangeParser(Parser):
    def policy(self) -> str:
        if not self.take("OR"):
            return "ABORT"
        word = self.word().upper()
        if word not in _POLICIES:
            raise SqlError(f"near {word!r}: syntax error")
        return word

    def change(self) -> Change:
        ctes, recursive = [], False
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            ctes = self.listed(self.cte)
        if self.peek("INSERT") or self.peek("REPLACE"):
            out = self.insert()
        elif self.take("UPDATE"):
            out = self.update()
        elif self.take("DELETE", "FROM"):
            out = Change("DELETE", self.word())
            out.alias = self.alias() if self.peek("AS") else None
            out.where = self.expression() if self.take("WHERE") else None
        else:
            raise SqlError(f"near {self.next.text!r}: syntax error")
        out.ctes, out.recursive = ctes, recursive
        if self.take("RETURNING"):
            out.returning = self.listed(self.item)
        self.finish()
        return out

    def insert(self) -> Change:
        policy = "REPLACE" if self.take("REPLACE") else ""
        if not policy:
            self.need("INSERT")
            policy = self.policy()
        self.need("INTO")
        out = Change("INSERT", self.word(), policy=policy)
        if self.take("AS"):
            out.alias = self.word()
        if self.peek("("):
            out.columns = self.names()
        if not self.take("DEFAULT", "VALUES"):
            out.select = self.select()
        while self.take("ON", "CONFLICT"):
            clause = Clause(None, None, None, None)
            if self.take("("):
                clause.target = [e for e, *_ in self.listed(self.ordering)]
                self.need(")")
                clause.partial = self.expression() if self.take("WHERE") else None
            self.need("DO")
            if not self.take("NOTHING"):
                self.need("UPDATE", "SET")
                clause.sets = self.listed(self.assignment)
                clause.where = self.expression() if self.take("WHERE") else None
            out.clauses.append(clause)
        return out

    def assignment(self):
        columns = self.names() if self.peek("(") else [self.word()]
        self.need("=")
        return columns, self.expression()

    def update(self) -> Change:
        policy = self.policy()
        out = Change("UPDATE", self.word(), policy=policy)
        if self.take("AS"):
            out.alias = self.word()
        self.need("SET")
        out.sets = self.listed(self.assignment)
        out.source = self.sources() if self.take("FROM") else None
        out.where = self.expression() if self.take("WHERE") else None
        return out

    def spanned(self) -> tuple[str, Node]:
        """An expression in brackets, with its text's place."""
        self.need("(")
        begin = self.next.at
        e = self.expression()
        end = self.next.at
        self.need(")")
        return (begin, end), e

    def reference(self, columns: list[str]) -> list[tuple]:
        parent = self.word()
        targets = self.names() if self.peek("(") else [None] * len(columns)
        actions, late = {"DELETE": "NO ACTION", "UPDATE": "NO ACTION"}, False
        while True:
            if self.take("ON"):
                event = self.word().upper()
                actions[event] = next(a for a in ("CASCADE", "SET NULL", "SET DEFAULT", "RESTRICT", "NO ACTION") if self.take(*a.split()))
            elif self.take("MATCH"):
                self.word()
            elif self.take("NOT", "DEFERRABLE") or self.take("DEFERRABLE"):
                if self.take("INITIALLY"):
                    late = self.word().upper() == "DEFERRED"
            else:
                return [(c, parent, t, actions["DELETE"], actions["UPDATE"], late) for c, t in zip(columns, targets, strict=True)]

    def conflict(self) -> None:
        if self.take("ON", "CONFLICT"):
            self.word()

    def definition(self) -> Definition:
        """After CREATE TABLE [IF NOT EXISTS]: the name and what stands in brackets."""
        out = Definition(self.word(), [])
        self.need("(")
        while True:
            if self.take("CONSTRAINT"):
                self.word()
            if self.take("PRIMARY", "KEY"):
                out.key = self.keys()
                self.conflict()
            elif self.peek("UNIQUE", "("):
                self.need("UNIQUE")
                out.unique.append(self.keys())
                self.conflict()
            elif self.peek("CHECK", "("):
                self.need("CHECK")
                out.checks.append(self.spanned())
            elif self.take("FOREIGN", "KEY"):
                columns = self.names()
                self.need("REFERENCES")
                out.references += self.reference(columns)
            else:
                out.columns.append(self.column_definition())
            if not self.take(","):
                break
        self.need(")")
        while self.take("WITHOUT", "ROWID") or self.take("STRICT") or self.take(","):
            pass
        self.finish()
        return out

    def keys(self) -> list[str]:
        self.need("(")
        out = [e.parts[1] if e.kind == "column" else e.parts[0].parts[1] for e, *_ in self.listed(self.ordering)]
        self.need(")")
        return out

    def column_definition(self) -> Column:
        out, kind = Column(self.word()), []
        while self.next.kind in ("word", "name") and self.next.upper not in ("CONSTRAINT", "PRIMARY", "UNIQUE", "NOT", "NULL", "CHECK", "DEFAULT", "COLLATE", "REFERENCES", "GENERATED", "AS"):
            kind.append(self.word())
        if kind and self.take("("):
            while not self.take(")"):
                self.at += 1
        out.kind = " ".join(kind)
        while True:
            if self.take("CONSTRAINT"):
                self.word()
            if self.take("PRIMARY", "KEY"):
                out.key = True
                self.take("ASC") or self.take("DESC")
                self.conflict()
                out.autoincrement = self.take("AUTOINCREMENT")
            elif self.take("UNIQUE"):
                out.unique = True
                self.conflict()
            elif self.take("NOT", "NULL"):
                out.not_null = True
                self.conflict()
            elif self.take("NULL"):
                pass
            elif self.peek("CHECK"):
                self.need("CHECK")
                out.checks.append(self.spanned())
            elif self.take("DEFAULT"):
                out.default = self.expression(7)
            elif self.take("COLLATE"):
                self.word()
            elif self.take("REFERENCES"):
                out.references = self.reference([out.name])[0]
            elif self.take("GENERATED", "ALWAYS", "AS") or self.take("AS"):
                _, out.generated = self.spanned()
                out.stored = self.take("STORED") or self.take("VIRTUAL") and False
            else:
                return out

    def trigger(self) -> Trigger:
        """After CREATE [TEMP] TRIGGER [IF NOT EXISTS]."""
        name = self.word()
        when = "BEFORE" if self.take("BEFORE") else "INSTEAD OF" if self.take("INSTEAD", "OF") else "AFTER"
        self.take("AFTER")
        event = self.word().upper()
        columns = self.listed(self.word) if event == "UPDATE" and self.take("OF") else []
        self.need("ON")
        out = Trigger(name, when, event, columns, self.word(), None)
        self.take("FOR", "EACH", "ROW")
        if self.take("WHEN"):
            begin = self.next.at
            self.expression()
            out.condition = begin, self.next.at
        self.need("BEGIN")
        while not self.take("END"):
            begin, depth = self.next.at, 0
            while self.next.text != ";" or depth:
                depth += (self.next.upper == "CASE") - (self.next.upper == "END")
                if self.next.kind == "end":
                    raise SqlError("a trigger's body isn't closed")
                self.at += 1
            out.body.append((begin, self.next.at))
            self.need(";")
        self.finish()
        return out
