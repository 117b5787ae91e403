"""JSON as text.

Extraction stays in the JVM (variant paths).  Editing, pretty-printing, JSON5 reading and error positions need number
tokens and member order as written, so they run in Arrow-batched Python over one parser that keeps both.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Number:
    """A number token as written."""

    token: str


class JsonError(ValueError):
    def __init__(self, at: int):
        super().__init__(f"malformed JSON at character {at + 1}")
        self.at = at


_WORD = {"null": None, "true": True, "false": False}
_STRICT_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_LOOSE_NUMBER = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


class _Parser:
    def __init__(self, text: str, loose: bool):
        self.text, self.loose, self.at = text, loose, 0

    def fail(self):
        raise JsonError(self.at)

    def space(self):
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in " \t\n\r" or self.loose and c.isspace():
                self.at += 1
            elif self.loose and self.text.startswith("//", self.at):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif self.loose and self.text.startswith("/*", self.at) and (end := self.text.find("*/", self.at)) > 0:
                self.at = end + 2
            else:
                return

    def peek(self) -> str:
        self.space()
        return self.text[self.at] if self.at < len(self.text) else ""

    def value(self):
        c = self.peek()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c == '"' or self.loose and c == "'":
            return self.string()
        for word, found in _WORD.items():
            if self.text.startswith(word, self.at):
                self.at += len(word)
                return found
        m = (_LOOSE_NUMBER if self.loose else _STRICT_NUMBER).match(self.text, self.at)
        if not m:
            self.fail()
        self.at = m.end()
        return Number(_plain(m[0]) if self.loose else m[0])

    def string(self) -> str:
        quote, out = self.text[self.at], []
        self.at += 1
        while True:
            if self.at >= len(self.text):
                self.fail()
            c = self.text[self.at]
            if c == quote:
                self.at += 1
                return "".join(out)
            if c == "\\":
                e = self.text[self.at + 1 : self.at + 2]
                if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", self.text[self.at + 2 : self.at + 6]):
                    out.append(chr(int(self.text[self.at + 2 : self.at + 6], 16)))
                    self.at += 6
                    continue
                if e in _ESCAPES and e:
                    out.append(_ESCAPES[e])
                elif self.loose and e in ("'", "v", "0", "\n"):
                    out.append({"'": "'", "v": "\v", "0": "\0", "\n": ""}[e])
                else:
                    self.fail()
                self.at += 2
                continue
            if c < " " and not self.loose:
                self.fail()
            out.append(c)
            self.at += 1

    def array(self) -> list:
        out: list = []
        self.at += 1
        while True:
            if self.peek() == "]" and (not out or self.loose):
                self.at += 1
                return out
            out.append(self.value())
            c = self.peek()
            if c not in (",", "]"):
                self.fail()
            self.at += 1
            if c == "]":
                return out

    def object(self) -> list[tuple[str, object]]:
        out: list[tuple[str, object]] = []
        self.at += 1
        while True:
            c = self.peek()
            if c == "}" and (not out or self.loose):
                self.at += 1
                return Members(out)
            if c == '"' or self.loose and c == "'":
                key = self.string()
            elif self.loose and (m := _NAME.match(self.text, self.at)):
                key = m[0]
                self.at = m.end()
            else:
                self.fail()
            if self.peek() != ":":
                self.fail()
            self.at += 1
            out.append((key, self.value()))
            c = self.peek()
            if c not in (",", "}"):
                self.fail()
            self.at += 1
            if c == "}":
                return Members(out)


class Members(list):
    """An object's (key, value) pairs in order."""


def _plain(token: str) -> str:
    token = token.lstrip("+")
    if re.match("-?0[xX]", token):
        return str(int(token, 16))
    if token.lstrip("-") in ("Infinity", "NaN"):
        return "null" if "NaN" in token else token.replace("Infinity", "9e999")
    token = re.sub(r"^(-?)\.", r"\g<1>0.", token)
    return re.sub(r"\.(?=$|[eE])", ".0", token)


def parse(text: str, loose: bool = True):
    p = _Parser(text, loose)
    out = p.value()
    p.space()
    if p.at != len(text):
        p.fail()
    return out


def _string(s: str) -> str:
    import json

    return json.dumps(s, ensure_ascii=False)


def render(v, indent: str | None = None, level: int = 0) -> str:
    if isinstance(v, Number):
        return v.token
    if v is None or isinstance(v, bool):
        return {None: "null", True: "true", False: "false"}[v]
    if isinstance(v, str):
        return _string(v)
    pieces = [f"{_string(k)}:{' ' * (indent is not None)}{render(x, indent, level + 1)}" for k, x in v] if isinstance(v, Members) else [render(x, indent, level + 1) for x in v]
    left, right = "{}" if isinstance(v, Members) else "[]"
    if indent is None or not pieces:
        return left + ",".join(pieces) + right
    pad = "\n" + indent * (level + 1)
    return left + pad + ("," + pad).join(pieces) + "\n" + indent * level + right


def path_steps(path: str) -> list:
    """``$.a[0]."b c"[#-1]`` as keys and indexes; ('#', n) counts from the end."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path!r}")
    steps, at = [], 1
    for m in re.finditer(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\[]+))|\[(?:(\d+)|#(?:-(\d+))?)\]', path):
        if m.start() != at:
            break
        at = m.end()
        steps.append(m[1] if m[1] is not None else m[2] if m[2] is not None else int(m[3]) if m[3] is not None else ("#", int(m[4] or 0)))
    if at != len(path):
        raise ValueError(f"bad JSON path: {path!r}")
    return steps


def _edit(node, steps: list, new, create: bool, overwrite: bool, remove: bool = False):
    step, last = steps[0], len(steps) == 1
    if isinstance(step, str):
        if not isinstance(node, Members):
            return
        at = next((i for i, (k, _) in enumerate(node) if k == step), None)
        put = lambda v: node.append((step, v)) if at is None else node.__setitem__(at, (step, v))
        size = at is not None
        inner = node[at][1] if size else None
    else:
        if not isinstance(node, list) or isinstance(node, Members):
            return
        at = len(node) - step[1] if isinstance(step, tuple) else step
        size = 0 <= at < len(node)
        if at < 0 or at > len(node):
            return
        put = lambda v: node.append(v) if at == len(node) else node.__setitem__(at, v)
        inner = node[at] if size else None
    if last:
        if remove:
            if size:
                del node[at]
        elif (overwrite if size else create):
            put(new)
        return
    if not size:
        if not create or remove:
            return
        inner = Members() if isinstance(steps[1], str) else []
        _edit(inner, steps[1:], new, create, overwrite)
        put(inner)
        return
    _edit(inner, steps[1:], new, create, overwrite, remove)


def edit(text: str, path: str, new, create: bool, overwrite: bool) -> str:
    root, steps = parse(text), path_steps(path)
    if not steps:
        return render(new) if overwrite else render(root)
    _edit(root, steps, new, create, overwrite)
    return render(root)


def remove(text: str, *paths: str) -> str | None:
    root = parse(text)
    for path in paths:
        steps = path_steps(path)
        if not steps:
            return None
        _edit(root, steps, None, False, False, remove=True)
    return render(root)


def merge_patch(target, patch):
    """RFC 7396."""
    if not isinstance(patch, Members):
        return patch
    out = Members(target) if isinstance(target, Members) else Members()
    for key, value in patch:
        at = next((i for i, (k, _) in enumerate(out) if k == key), None)
        if value is None:
            if at is not None:
                del out[at]
        else:
            merged = merge_patch(out[at][1] if at is not None else None, value)
            out.append((key, merged)) if at is None else out.__setitem__(at, (key, merged))
    return out


def error_position(text: str) -> int:
    try:
        parse(text)
        return 0
    except JsonError as e:
        return e.at + 1


def _from_sql(v):
    if v is None or isinstance(v, bool):
        return v
    return Number(str(v)) if isinstance(v, int | float) else str(v)


def _udf(f: Callable, kind: str = "string"):
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in x], dtype=object)

    return F.pandas_udf(run, kind)


def json(x: Column) -> Column:
    """Validate and minify; number tokens stay as written."""
    return _udf(lambda v: render(parse(v)))(x)


def json_pretty(x: Column, indent: str = "    ") -> Column:
    return _udf(lambda v: render(parse(v), indent))(x)


def json_error_position(x: Column) -> Column:
    return _udf(error_position, "long")(x)


def json_insert(x: Column, path: str, value) -> Column:
    return _udf(lambda v: edit(v, path, _from_sql(value), True, False))(x)


def json_replace(x: Column, path: str, value) -> Column:
    return _udf(lambda v: edit(v, path, _from_sql(value), False, True))(x)


def json_set(x: Column, path: str, value) -> Column:
    return _udf(lambda v: edit(v, path, _from_sql(value), True, True))(x)


def json_remove(x: Column, *paths: str) -> Column:
    return _udf(lambda v: remove(v, *paths))(x)


def json_patch(x: Column, patch: str) -> Column:
    return _udf(lambda v: render(merge_patch(parse(v), parse(patch))))(x)


def json_valid(x: Column, json5: bool = False) -> Column:
    if json5:
        return _udf(lambda v: int(error_position(v) == 0), "long")(x)
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull().cast("long"))


def json_extract(x: Column, path: str, kind: str = "string") -> Column:
    return F.variant_get(F.parse_json(x), path, kind)


def arrow(x: Column, path: str) -> Column:
    """->: the node as JSON text."""
    return F.to_json(F.variant_get(F.parse_json(x), path, "variant"))


def arrow_text(x: Column, path: str) -> Column:
    """->>: the node as a value."""
    return F.get_json_object(x, path)


def json_type(x: Column, path: str = "$") -> Column:
    node = F.variant_get(F.parse_json(x), path, "variant")
    kind = F.schema_of_variant(node)
    value = F.to_json(node)
    return (
        F.when(node.isNull() & F.get_json_object(x, path).isNull() & (kind.isNull() | (kind == "VOID")), F.when(kind == "VOID", "null"))
        .when(kind == "VOID", "null").when(kind == "BOOLEAN", value).when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "real")
        .when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    )


def json_array_length(x: Column) -> Column:
    return F.when(x.isNotNull(), F.coalesce(F.json_array_length(x), F.lit(0)).cast("long"))


def json_array(*xs: Column) -> Column:
    """Arguments of one type; NULL becomes null."""
    return F.to_json(F.array(*xs), {"ignoreNullFields": "false"})


def json_object(**members: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())), {"ignoreNullFields": "false"})


def json_quote(x: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r"(?s)^\{\"v\":(.*)\}$", 1)


def each(text: str | None, path: str = "$", deep: bool = False):
    """Rows of json_each / json_tree: key, value, type, atom, id, parent, fullkey, path."""
    if text is None:
        return
    counter = [0]

    def kind(v):
        if isinstance(v, Number):
            return "real" if re.search("[.eE]", v.token) else "integer"
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else "text" if isinstance(v, str) else "object" if isinstance(v, Members) else "array"

    def row(key, v, parent, full, base):
        own = counter[0]
        counter[0] += 1
        leaf = not isinstance(v, list)
        shown = None if v is None else v if isinstance(v, str) else str(int(v)) if isinstance(v, bool) else render(v)
        return own, (None if key is None else str(key), shown, kind(v), shown if leaf else None, own, parent, full, base)

    def full(base, k):
        return f"{base}[{k}]" if isinstance(k, int) else f"{base}.{k}" if re.fullmatch(r"[A-Za-z_]\w*", k) else f'{base}."{k}"'

    def walk(v, key, parent, at, base):
        own, out = row(key, v, parent, at, base)
        yield out
        if isinstance(v, list):
            for k, x in v if isinstance(v, Members) else enumerate(v):
                yield from walk(x, k, own, full(at, k), at)

    node = parse(text)
    for step in path_steps(path):
        if isinstance(node, Members) and isinstance(step, str):
            node = next((x for k, x in node if k == step), _MISSING)
        elif isinstance(node, list) and not isinstance(node, Members) and not isinstance(step, str):
            i = len(node) - step[1] if isinstance(step, tuple) else step
            node = node[i] if 0 <= i < len(node) else _MISSING
        else:
            node = _MISSING
        if node is _MISSING:
            return
    if deep:
        yield from walk(node, None, None, path, path)
    elif isinstance(node, list):
        counter[0] = 1
        for k, x in node if isinstance(node, Members) else enumerate(node):
            yield row(k, x, None, full(path, k), path)[1]
    else:
        yield row(None, node, None, path, path)[1]


_MISSING = object()
TVF_SCHEMA = "key string, value string, type string, atom string, id long, parent long, fullkey string, path string"


def register(spark) -> None:
    """json_each and json_tree as table functions, usable with LATERAL."""
    from pyspark.sql.functions import udtf

    class Each:
        def eval(self, text, path="$"):
            yield from each(text, path or "$")

    class Tree:
        def eval(self, text, path="$"):
            yield from each(text, path or "$", deep=True)

    spark.udtf.register("json_each", udtf(Each, returnType=TVF_SCHEMA))
    spark.udtf.register("json_tree", udtf(Tree, returnType=TVF_SCHEMA))

    for name, f, kind in (
        ("minify", lambda x: render(parse(x)), "string"), ("pretty", lambda x, indent: render(parse(x), indent), "string"), ("error", error_position, "long"),
        ("patch", lambda x, y: render(merge_patch(parse(x), parse(y))), "string"), ("edit", _edited, "string"), ("remove", remove, "string"),
        ("node", lambda x, path: _rendered(_at(x, path)), "string"), ("text", _text_at, "string"), ("type", lambda x, path: _type_at(x, path), "string"),
        ("size", _size_at, "long"), ("valid", _valid, "long"), ("path", _short_path, "string"),
    ):
        spark.udf.register(f"tessera_json_{name}", F.udf(_strict(f), kind, useArrow=True))


_MISSING = object()


def _strict(f: Callable) -> Callable:
    """NULL for any NULL argument."""
    return lambda *xs: None if any(x is None for x in xs) else f(*xs)


def _at(text: str, path: str):
    node = parse(text)
    for step in path_steps(path):
        if isinstance(step, str):
            node = next((v for k, v in node if k == step), _MISSING) if isinstance(node, Members) else _MISSING
        else:
            at = (len(node) - step[1] if isinstance(step, tuple) else step) if isinstance(node, list) and not isinstance(node, Members) else -1
            node = node[at] if 0 <= at < len(node) else _MISSING
        if node is _MISSING:
            break
    return node


def _rendered(node) -> str | None:
    return None if node is _MISSING else render(node)


def _text_at(text: str, path: str) -> str | None:
    """The node as a value: text as it is, true and false as 1 and 0, null as NULL, containers as JSON."""
    node = _at(text, path)
    if node is _MISSING or node is None:
        return None
    return str(int(node)) if isinstance(node, bool) else node if isinstance(node, str) else render(node)


def _type_at(text: str, path: str) -> str | None:
    node = _at(text, path)
    if node is _MISSING:
        return None
    if isinstance(node, Number):
        return "real" if any(c in node.token for c in ".eE") else "integer"
    return "null" if node is None else str(node).lower() if isinstance(node, bool) else "text" if isinstance(node, str) else "object" if isinstance(node, Members) else "array"


def _size_at(text: str, path: str) -> int | None:
    node = _at(text, path)
    return None if node is _MISSING else len(node) if isinstance(node, list) and not isinstance(node, Members) else 0


def _edited(text: str, path: str, value: str, mode: str) -> str:
    return edit(text, path, parse(value), mode != "replace", mode != "insert")


def _valid(text: str, flags: int) -> int:
    """Flag 1 asks for strict JSON, flag 2 allows JSON5."""
    if not 1 <= flags <= 15:
        raise ValueError("json_valid() takes flags from 1 to 15")
    if flags & 2 and not error_position(text):
        return 1
    try:
        parse(text, loose=False)
    except JsonError:
        return 0
    return int(bool(flags & 1))


def _short_path(name: str) -> str:
    """The path that an operand of -> stands for: a whole path, an index, or a label."""
    return name if name.startswith("$") else f"${name}" if name.startswith("[") else f'$."{name}"'
