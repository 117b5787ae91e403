"""The dialect's scalar functions as Spark SQL: each takes (text, type) arguments and gives (text, type).

Types are integer, real, text, blob, bool, or None where a type isn't known before Spark analyses the query.
"""

from __future__ import annotations

import re

from tessera.functions import strings as S
from tessera.functions.strings import LOWER, UPPER
from tessera.sql.lexer import SqlError

Arg = tuple[str, str | None]
_INTEGER = r"^\\s*([+-]?\\d+)"
_REAL = r"^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)"


def literal(text: str) -> str:
    out = "".join({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\0": "\\0"}.get(c, c) for c in text)
    return f"'{out}'"


def text_of(x: Arg) -> str:
    return x[0] if x[1] == "text" else f"CAST({x[0]} AS BIGINT)::STRING" if x[1] == "bool" else f"CAST({x[0]} AS STRING)"


def number_of(x: Arg) -> Arg:
    """The value in a numeric context: text by its longest numeric prefix."""
    sql, kind = x
    if kind in ("integer", "real"):
        return x
    if kind == "bool":
        return f"CAST({sql} AS BIGINT)", "integer"
    if kind in ("text", "blob"):
        return real_of(x), "real"
    return x


def integer_of(x: Arg) -> str:
    sql, kind = x
    if kind in ("integer", "real", "bool"):
        return f"CAST({sql} AS BIGINT)"
    s = f"CAST({sql} AS STRING)"
    return f"if({sql} IS NULL, CAST(NULL AS BIGINT), coalesce(try_cast(nullif(regexp_extract({s}, '{_INTEGER}', 1), '') AS BIGINT), 0L))"


def real_of(x: Arg) -> str:
    sql, kind = x
    if kind in ("integer", "real"):
        return f"CAST({sql} AS DOUBLE)"
    if kind == "bool":
        return f"CAST(CAST({sql} AS BIGINT) AS DOUBLE)"
    s = f"CAST({sql} AS STRING)"
    return f"if({sql} IS NULL, CAST(NULL AS DOUBLE), coalesce(try_cast(nullif(regexp_extract({s}, '{_REAL}', 1), '') AS DOUBLE), 0D))"


def truth_of(x: Arg) -> str:
    sql, kind = x
    return f"({sql})" if kind == "bool" else f"(CAST({sql} AS BOOLEAN))" if kind is None else f"({number_of(x)[0]} <> 0)"


def lower(sql: str) -> str:
    return f"translate({sql}, '{UPPER}', '{LOWER}')"


def upper(sql: str) -> str:
    return f"translate({sql}, '{LOWER}', '{UPPER}')"


def cast(x: Arg, declared: str) -> Arg:
    from tessera.functions.values import affinity

    kind = affinity(declared)
    if kind == "INTEGER":
        return integer_of(x), "integer"
    if kind == "REAL":
        return real_of(x), "real"
    if kind == "TEXT":
        return text_of(x), "text"
    if kind == "BLOB":
        return f"CAST({text_of(x)} AS BINARY)", "blob"
    return x if x[1] in ("integer", "real") else (real_of(x), "real")


def substr(xs: list[Arg]) -> Arg:
    x, blob = (xs[0][0], True) if xs[0][1] == "blob" else (text_of(xs[0]), False)
    n, y = f"CAST(length({x}) AS BIGINT)", integer_of(xs[1])
    first = f"(CASE WHEN {y} > 0 THEN {y} WHEN {y} < 0 THEN {n} + {y} + 1 WHEN {y} = 0 THEN 0L END)"
    if len(xs) == 2:
        low, high = first, f"{n} + 1"
    else:
        z = integer_of(xs[2])
        low, high = f"if({z} >= 0, {first}, {first} + {z})", f"if({z} >= 0, {first} + {z}, {first})"
        if re.fullmatch(r"\d+L", xs[2][0]):
            low, high = first, f"{first} + {xs[2][0]}"
    low = f"greatest({low}, 1L)"
    size = f"greatest(least({high}, {n} + 1) - {low}, 0L)"
    known = " AND ".join(f"{a[0]} IS NOT NULL" for a in xs[1:])
    return f"if({known}, substring({x}, CAST({low} AS INT), CAST({size} AS INT)), NULL)", "blob" if blob else "text"


def length(xs: list[Arg]) -> Arg:
    x = xs[0]
    if x[1] == "blob":
        return f"CAST(octet_length({x[0]}) AS BIGINT)", "integer"
    return f"CAST(length(substring_index({text_of(x)}, '\\0', 1)) AS BIGINT)", "integer"


def type_name(xs: list[Arg]) -> Arg:
    x = xs[0][0]
    if xs[0][1] == "bool":
        return f"if(({x}) IS NULL, 'null', 'integer')", "text"
    t = f"typeof({x})"
    return f"CASE WHEN ({x}) IS NULL THEN 'null' WHEN {t} IN ('bigint', 'int', 'smallint', 'tinyint', 'boolean') THEN 'integer' WHEN {t} IN ('double', 'float') OR {t} LIKE 'decimal%' THEN 'real' WHEN {t} = 'binary' THEN 'blob' ELSE 'text' END", "text"


def quote(xs: list[Arg]) -> Arg:
    x, kind = xs[0]
    if kind == "blob":
        shown = f"concat('X\\'', hex({x}), '\\'')"
    elif kind in ("integer", "real", "bool"):
        shown = text_of(xs[0])
    else:
        s = f"CAST({x} AS STRING)"
        shown = f"if(typeof({x}) = 'string' OR typeof({x}) LIKE 'timestamp%' OR typeof({x}) = 'date', concat('\\'', replace({s}, '\\'', '\\'\\''), '\\''), {s})"
    return f"coalesce({shown}, 'NULL')", "text"


def extremum(name: str):
    def make(xs: list[Arg]) -> Arg:
        known = " AND ".join(f"({x[0]}) IS NOT NULL" for x in xs)
        kinds = {x[1] for x in xs}
        values = [x[0] for x in xs]
        if kinds <= {"integer", "real", "bool"}:
            values = [number_of(x)[0] for x in xs]
        return f"if({known}, {name}({', '.join(values)}), NULL)", next(iter(kinds)) if len(kinds) == 1 else "real" if kinds <= {"integer", "real"} else None

    return make


def _real(form: str, condition: str = ""):
    def make(xs: list[Arg]) -> Arg:
        out = form.format(*(real_of(x) for x in xs))
        return (f"if({condition.format(*(real_of(x) for x in xs))}, {out}, NULL)" if condition else out), "real"

    return make


def _finite(form: str):
    def make(xs: list[Arg]) -> Arg:
        out = form.format(*(real_of(x) for x in xs))
        return f"if(isnan({out}), NULL, {out})", "real"

    return make


def logarithm(xs: list[Arg]) -> Arg:
    if len(xs) == 1:
        return _real("log10({0})", "{0} > 0")(xs)
    return _real("(ln({1}) / ln({0}))", "{0} > 0 AND {0} <> 1 AND {1} > 0")(xs)


def _rounding(name: str):
    def make(xs: list[Arg]) -> Arg:
        x, kind = number_of(xs[0])
        if kind == "integer":
            return x, kind
        v = real_of(xs[0])
        form = f"if({v} < 0, ceil({v}), floor({v}))" if name == "trunc" else f"{name}({v})"
        return f"CAST({form} AS DOUBLE)", "real"

    return make


def round_(xs: list[Arg]) -> Arg:
    digits = xs[1][0] if len(xs) > 1 else "0"
    if not re.fullmatch(r"-?\(?-?\d+L?\)?", digits):
        raise SqlError("round() takes a constant number of digits")
    n = max(0, min(30, int(re.sub(r"[()L]", "", digits))))
    return f"CAST(round({real_of(xs[0])}, {n}) AS DOUBLE)", "real"


def char(xs: list[Arg]) -> Arg:
    codes = [re.fullmatch(r"(\d+)L", x[0]) for x in xs]
    if not all(codes):
        raise SqlError("char() takes constant code points")
    return literal("".join(chr(int(m[1])) for m in codes)), "text"


def hex_(xs: list[Arg]) -> Arg:
    x = xs[0][0] if xs[0][1] == "blob" else f"CAST({text_of(xs[0])} AS BINARY)"
    return f"coalesce(hex({x}), '')", "text"


def unhex(xs: list[Arg]) -> Arg:
    x = text_of(xs[0]) if len(xs) == 1 else f"translate({text_of(xs[0])}, {text_of(xs[1])}, '')"
    return f"if({x} RLIKE '^([0-9A-Fa-f]{{2}})*$', unhex({x}), NULL)", "blob"


def randomblob(xs: list[Arg]) -> Arg:
    n = f"greatest({integer_of(xs[0])}, 1L)"
    parts = f"flatten(transform(array(uuid()), u -> transform(sequence(1L, ({n} + 15) div 16), i -> md5(concat(u, CAST(i AS STRING))))))"
    return f"unhex(substring(array_join({parts}, ''), 1, CAST(2 * {n} AS INT)))", "blob"


def unicode_(xs: list[Arg]) -> Arg:
    return f"CAST(nullif(ascii({text_of(xs[0])}), 0) AS BIGINT)", "integer"


def same(xs: list[Arg]) -> Arg:
    return xs[0]


def condition(xs: list[Arg]) -> Arg:
    """iif(c, a[, c2, b ...][, otherwise])."""
    pairs, rest = list(zip(xs[::2], xs[1::2], strict=False)), xs[-1:] if len(xs) % 2 else []
    kinds = {x[1] for _, x in pairs} | {x[1] for x in rest}
    whens = " ".join(f"WHEN {truth_of(c)} THEN {x[0]}" for c, x in pairs)
    return f"CASE {whens} ELSE {rest[0][0] if rest else 'NULL'} END", next(iter(kinds)) if len(kinds) == 1 else None


def coalesced(xs: list[Arg]) -> Arg:
    kinds = {x[1] for x in xs if x[0] != "NULL"}
    return f"coalesce({', '.join(x[0] for x in xs)})", next(iter(kinds)) if len(kinds) == 1 else "real" if kinds == {"integer", "real"} else None


def printf(xs: list[Arg]) -> Arg:
    m = re.fullmatch(r"'(.*)'", xs[0][0], re.S)
    if not m or xs[0][1] != "text":
        raise SqlError("format() takes a constant template")
    template, left, pieces, at = re.sub(r"\\(.)", lambda k: {"n": "\n", "r": "\r", "0": "\0"}.get(k[1], k[1]), m[1]), xs[1:], [], 0
    for m in re.finditer(r"%([-+ 0,#!]*)(\d*|\*)(?:\.(\d+))?(?:ll?)?([diufeEgGxXoszcqQwpn%])", template):
        pieces.append(literal(template[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind in "%n":
            pieces.append("'%'" if kind == "%" else "''")
            continue
        x = left.pop(0) if left else ("NULL", None)
        spec = "%" + re.sub(r"[!#]", "", flags) + width
        if kind in "diu":
            shown = f"format_string('{spec}d', coalesce({integer_of(x)}, 0L))"
        elif kind in "xXop":
            shown = f"format_string('{spec}{'X' if kind == 'p' else kind}', coalesce({integer_of(x)}, 0L))"
        elif kind in "feE":
            shown = f"format_string('{spec}.{precision or 6}{kind}', coalesce({real_of(x)}, 0D))"
        elif kind in "gG":
            p = max(1, int(precision or 6))
            v = f"coalesce({real_of(x)}, 0D)"
            shown = f"format_string('%.{p}{kind}', {v})"  # with all its zeros, which are cut then
            plain = f"regexp_replace(regexp_replace({shown}, '(\\\\.[0-9]*?)0+($|[eE])', '$1$2'), '\\\\.($|[eE])', '$1')"
            shown = f"lpad({plain}, greatest({width or 0}, length({plain})), ' ')"
        else:
            s = text_of(x)
            if kind in "qQ":
                s = f"replace({s}, '\\'', '\\'\\'')"
            if kind == "w":
                s = f"replace({s}, '\"', '\"\"')"
            if kind == "Q":
                s = f"coalesce(concat('\\'', {s}, '\\''), 'NULL')"
            s = f"coalesce({s}, '{'(NULL)' if kind == 'q' else ''}')"
            if kind == "c":
                s = f"substring({s}, 1, 1)"
            elif precision:
                s = f"substring({s}, 1, {precision})"
            shown = f"format_string('%{'-' if '-' in flags else ''}{width}s', {s})" if width else s
        if "," in flags and kind in "diu":
            shown = f"format_string('%,{width}d', coalesce({integer_of(x)}, 0L))"
        pieces.append(shown)
    pieces.append(literal(template[at:]))
    return f"concat({', '.join(pieces)})", "text"


# -- JSON: text in, text out; arguments become JSON by type, JSON results embed as they are
def json_value(x: Arg) -> str:
    sql, kind = x
    if kind == "json":
        return f"coalesce({sql}, 'null')"
    if kind == "bool":
        sql = f"CAST({sql} AS BIGINT)"
    if sql == "NULL":
        return "'null'"
    shown = f"to_json(array({sql}), map('ignoreNullFields', 'false'))"
    return f"substring({shown}, 2, length({shown}) - 2)"


def json_array(xs: list[Arg]) -> Arg:
    return f"concat('[', concat_ws(',', {', '.join(map(json_value, xs))}), ']')" if xs else "'[]'", "json"


def json_object(xs: list[Arg]) -> Arg:
    if len(xs) % 2:
        raise SqlError("json_object() takes an even number of arguments")
    members = [f"concat({json_value((text_of(k), 'text'))}, ':', {json_value(v)})" for k, v in zip(xs[::2], xs[1::2], strict=True)]
    return f"concat('{{', concat_ws(',', {', '.join(members)}), '}}')" if xs else "'{}'", "json"


def _json_edit(mode: str):
    def make(xs: list[Arg]) -> Arg:
        out = text_of(xs[0])
        if len(xs) % 2 == 0:
            raise SqlError(f"json_{mode}() takes an odd number of arguments")
        for path, value in zip(xs[1::2], xs[2::2], strict=True):
            out = f"tessera_json_edit({out}, {text_of(path)}, {json_value(value)}, '{mode}')"
        return out, "json"

    return make


def _json(name: str, kind: str, rest: str = ""):
    def make(xs: list[Arg]) -> Arg:
        return f"{name}({', '.join(text_of(x) for x in xs)}{rest if len(xs) == 1 else ''})", kind

    return make


def json_extract(xs: list[Arg]) -> Arg:
    x = text_of(xs[0])
    if len(xs) == 2:
        return f"tessera_json_text({x}, {text_of(xs[1])})", "text"
    parts = ", ".join(f"coalesce(tessera_json_node({x}, {text_of(p)}), 'null')" for p in xs[1:])
    return f"if({x} IS NULL, NULL, concat('[', concat_ws(',', {parts}), ']'))", "json"


def json_remove(xs: list[Arg]) -> Arg:
    out = text_of(xs[0])
    for p in xs[1:]:
        out = f"tessera_json_remove({out}, {text_of(p)})"
    return out, "json"


def _text(form: str, kind: str = "text"):
    return lambda xs: (form.format(*map(text_of, xs)), kind)


def _trim(name: str):
    return lambda xs: (f"{name}({text_of(xs[0])}, ' ')" if name == "btrim" and len(xs) == 1 else f"trim({ {'btrim': 'BOTH', 'ltrim': 'LEADING', 'rtrim': 'TRAILING'}[name]} {text_of(xs[1]) if len(xs) > 1 else chr(39) + ' ' + chr(39)} FROM {text_of(xs[0])})", "text")


def like(op: str, x: Arg, pattern: Arg, escape: Arg | None) -> str:
    if op == "GLOB":
        m = re.fullmatch(r"'(.*)'", pattern[0], re.S)
        if not m:
            raise SqlError("GLOB takes a constant pattern")
        return f"({text_of(x)} RLIKE {literal(S.glob_pattern(re.sub(r'\\\\(.)', lambda k: k[1], m[1])))})"
    sign = escape[0] if escape else "'\\u0001'"
    return f"({lower(text_of(x))} LIKE {lower(text_of(pattern))} ESCAPE {sign})"


SCALARS = {
    "length": length, "octet_length": lambda xs: (f"CAST(octet_length({xs[0][0] if xs[0][1] == 'blob' else text_of(xs[0])}) AS BIGINT)", "integer"),
    "substr": substr, "substring": substr, "upper": lambda xs: (upper(text_of(xs[0])), "text"), "lower": lambda xs: (lower(text_of(xs[0])), "text"),
    "trim": _trim("btrim"), "ltrim": _trim("ltrim"), "rtrim": _trim("rtrim"), "replace": _text("replace({0}, {1}, {2})"),
    "instr": _text("CAST(instr({0}, {1}) AS BIGINT)", "integer"),
    "concat": lambda xs: (f"concat_ws('', {', '.join(map(text_of, xs))})", "text"),
    "concat_ws": lambda xs: (f"if({xs[0][0]} IS NULL, NULL, concat_ws({', '.join(map(text_of, xs))}))", "text"),
    "format": printf, "printf": printf, "typeof": type_name, "quote": quote, "hex": hex_, "unhex": unhex, "char": char, "unicode": unicode_,
    "random": lambda xs: ("xxhash64(uuid())", "integer"), "randomblob": randomblob,
    "zeroblob": lambda xs: (f"unhex(repeat('00', CAST(greatest({integer_of(xs[0])}, 0L) AS INT)))", "blob"),
    "likely": same, "unlikely": same, "likelihood": same,
    "coalesce": coalesced, "ifnull": coalesced, "nullif": lambda xs: (f"nullif({xs[0][0]}, {xs[1][0]})", xs[0][1]), "iif": condition, "if": condition,
    "abs": lambda xs: (f"abs({number_of(xs[0])[0]})", number_of(xs[0])[1]), "round": round_,
    "sign": lambda xs: (f"CAST(signum({real_of(xs[0])}) AS BIGINT)", "integer"), "min": extremum("least"), "max": extremum("greatest"),
    "ceil": _rounding("ceil"), "ceiling": _rounding("ceil"), "floor": _rounding("floor"), "trunc": _rounding("trunc"),
    "exp": _real("exp({0})"), "ln": _real("ln({0})", "{0} > 0"), "log": logarithm, "log10": _real("log10({0})", "{0} > 0"), "log2": _real("log2({0})", "{0} > 0"),
    "pow": _finite("power({0}, {1})"), "power": _finite("power({0}, {1})"), "sqrt": _real("sqrt({0})", "{0} >= 0"), "mod": _real("try_mod({0}, {1})"),
    "pi": lambda xs: ("pi()", "real"), "degrees": _real("degrees({0})"), "radians": _real("radians({0})"),
    **{n: _finite(f"{n}({{0}})") for n in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")}, "atan2": _real("atan2({0}, {1})"),
    "json": _json("tessera_json_minify", "json"), "json_array": json_array, "json_object": json_object, "json_quote": lambda xs: (json_value(xs[0]), "json"),
    "json_insert": _json_edit("insert"), "json_replace": _json_edit("replace"), "json_set": _json_edit("set"), "json_remove": json_remove,
    "json_patch": _json("tessera_json_patch", "json"), "json_pretty": _json("tessera_json_pretty", "text", ", '    '"), "json_error_position": _json("tessera_json_error", "integer"),
    "json_extract": json_extract, "json_type": _json("tessera_json_type", "text", ", '$'"), "json_array_length": _json("tessera_json_size", "integer", ", '$'"),
    "json_valid": lambda xs: (f"tessera_json_valid({text_of(xs[0])}, {integer_of(xs[1]) if len(xs) > 1 else '1L'})", "integer"),
    "glob": lambda xs: (like("GLOB", xs[1], xs[0], None), "bool"), "like": lambda xs: (like("LIKE", xs[1], xs[0], xs[2] if len(xs) > 2 else None), "bool"),
}
