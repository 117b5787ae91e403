"""Time values and modifiers as Spark SQL over UTC milliseconds."""

from __future__ import annotations

import re

from tessera.sql.calls import Arg, literal, text_of
from tessera.sql.lexer import SqlError

_DAY = 86_400_000
_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": _DAY}


def _constant(x: Arg) -> str:
    m = re.fullmatch(r"'(.*)'", x[0], re.S)
    if not m or x[1] != "text":
        raise SqlError("date modifiers are constant strings")
    return m[1].strip().lower()


def _julian(sql: str) -> str:
    return f"CAST(round(({sql} - 2440587.5D) * {_DAY}) AS BIGINT)"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that it uses many times: spelled out, nested values would grow without end."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _base(x: Arg, first: str | None) -> str:
    """Milliseconds of a time value: text in the usual forms, a day number, or a Spark date or timestamp."""
    sql, kind = x
    if sql.lower() == "'now'":
        return "unix_millis(current_timestamp())"
    if kind in ("integer", "real"):
        v = f"CAST({sql} AS DOUBLE)"
        if first == "unixepoch":
            return f"CAST(round({v} * 1000) AS BIGINT)"
        if first == "auto":
            return f"if({v} BETWEEN 0 AND 5373484.499999, {_julian(v)}, CAST(round({v} * 1000) AS BIGINT))"
        return f"if({v} BETWEEN 0 AND 5373484.499999, {_julian(v)}, NULL)"
    s = "s"
    # the zone is read as an offset that is taken off; a time alone is of 2000-01-01
    shape = r"'^(?:\\d{4}-\\d\\d-\\d\\d(?:[ T]+\\d\\d:\\d\\d(?::\\d\\d(?:\\.\\d+)?)?)?|\\d\\d:\\d\\d(?::\\d\\d(?:\\.\\d+)?)?) *(?:Z|z|[+-]\\d\\d:\\d\\d)?$'"
    zone = lambda i: rf"regexp_extract({s}, '([+-])(\\d\\d):(\\d\\d)$', {i})"
    at_zone = rf"{s} RLIKE ':.*[+-]\\d\\d:\\d\\d$'"
    bare = rf"regexp_replace(regexp_replace({s}, '(:.*?) *(?:Z|z|[+-]\\d\\d:\\d\\d)$', '$1'), '[ T]+', ' ')"
    dated = rf"if({bare} RLIKE '^\\d\\d:', concat('2000-01-01 ', {bare}), {bare})"
    timed = rf"if({dated} RLIKE ' \\d\\d:\\d\\d$', concat({dated}, ':00'), {dated})"
    offset = f"if({at_zone}, if({zone(1)} = '-', 1, -1) * (try_cast({zone(2)} AS INT) * 60 + try_cast({zone(3)} AS INT)) * 60000L, 0L)"
    number = f"try_cast({s} AS DOUBLE)"
    numeric = f"CAST(round({number} * 1000) AS BIGINT)" if first == "unixepoch" else _julian(number)
    text = f"CASE WHEN {s} RLIKE {shape} THEN unix_millis(try_cast({timed} AS TIMESTAMP)) + {offset} ELSE {numeric} END"
    if kind is None:
        return f"CASE WHEN typeof({sql}) IN ('timestamp', 'date', 'timestamp_ntz') THEN unix_millis(try_cast({sql} AS TIMESTAMP)) ELSE {_let('s', f'trim({text_of(x)})', text)} END"
    return _let("s", f"trim({text_of(x)})", text)


def _ts(ms: str) -> str:
    return f"timestamp_millis({ms})"


def _shift_months(ms: str, n: int | str, clamp: bool = False) -> str:
    t = "timestamp_millis(m)"
    total = f"(year({t}) * 12 + month({t}) - 1 + ({n}))"
    first = f"make_date(CAST(floor({total} / 12) AS INT), CAST(pmod({total}, 12) + 1 AS INT), 1)"
    day = f"(day({t}) - 1)"
    if clamp:
        day = f"least({day}, day(last_day({first})) - 1)"
    return _let("m", ms, f"unix_millis(CAST(date_add({first}, {day}) AS TIMESTAMP)) + pmod(m, {_DAY}L)")


def _modified(ms: str, modifiers: list[str]) -> str | None:
    """The milliseconds after all modifiers; None for one that isn't known."""
    for i, m in enumerate(modifiers):
        clamp = i + 1 < len(modifiers) and modifiers[i + 1] == "floor"
        if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) *(second|minute|hour|day)s?", m):
            ms = f"({ms} + {round(float(found[1]) * _UNITS[found[2]])}L)"
        elif found := re.fullmatch(r"([+-]?\d+)(?:\.0*)? *(month|year)s?", m):
            ms = _shift_months(ms, int(found[1]) * (12 if found[2] == "year" else 1), clamp)
        elif found := re.fullmatch(r"start of (day|month|year)", m):
            ms = f"unix_millis(date_trunc('{found[1]}', {_ts(ms)}))"
        elif found := re.fullmatch(r"weekday ([0-6])", m):
            ms = _let("m", ms, f"m + pmod({found[1]} - (dayofweek(timestamp_millis(m)) - 1), 7) * {_DAY}L")
        elif found := re.fullmatch(r"([+-])(\d{4})-(\d\d)-(\d\d)(?: +(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?)?", m):
            sign = -1 if found[1] == "-" else 1
            ms = _shift_months(ms, sign * (int(found[2]) * 12 + int(found[3])))
            rest = int(found[4]) * _DAY + int(found[5] or 0) * 3_600_000 + int(found[6] or 0) * 60_000 + round(float(found[7] or 0) * 1000)
            ms = f"({ms} + {sign * rest}L)"
        elif found := re.fullmatch(r"([+-])?(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?", m):
            part = int(found[2]) * 3_600_000 + int(found[3]) * 60_000 + round(float(found[4] or 0) * 1000)
            ms = f"({ms} + {-part if found[1] == '-' else part}L)"
        elif m not in ("utc", "localtime", "auto", "unixepoch", "julianday", "subsec", "subsecond", "floor", "ceiling"):
            return None
    return ms


def _instant(xs: list[Arg]) -> tuple[str, bool]:
    """Milliseconds of (time value, modifiers...), and whether fractions are asked for."""
    xs = xs or [("'now'", "text")]
    modifiers = [_constant(x) for x in xs[1:]]
    ms = _modified(_base(xs[0], modifiers[0] if modifiers else None), modifiers)
    return (ms if ms is not None else "CAST(NULL AS BIGINT)"), bool({"subsec", "subsecond"} & set(modifiers))


def _shown(form: str, fine: str):
    def make(xs: list[Arg]) -> Arg:
        ms, sub = _instant(xs)
        return f"date_format({_ts(ms)}, '{fine if sub else form}')", "text"

    return make


def julianday(xs: list[Arg]) -> Arg:
    return f"({_instant(xs)[0]} / {_DAY}D + 2440587.5D)", "real"


def unixepoch(xs: list[Arg]) -> Arg:
    ms, sub = _instant(xs)
    return (f"({ms} / 1000D)", "real") if sub else (f"CAST(floor({ms} / 1000D) AS BIGINT)", "integer")


def strftime(xs: list[Arg]) -> Arg:
    m = re.fullmatch(r"'(.*)'", xs[0][0], re.S)
    if not m:
        raise SqlError("strftime() takes a constant format")
    at_ms, _ = _instant(xs[1:])
    ms, t = "ms", "timestamp_millis(ms)"
    form = lambda f: f"date_format({t}, '{f}')"
    pad = lambda x, n, c="0": f"lpad(CAST({x} AS STRING), {n}, '{c}')"
    twelve = f"(pmod(hour({t}) + 11, 12) + 1)"
    codes = {
        "d": form("dd"), "e": pad(f"day({t})", 2, " "), "F": form("yyyy-MM-dd"), "H": form("HH"), "k": pad(f"hour({t})", 2, " "), "I": pad(twelve, 2), "l": pad(twelve, 2, " "), "j": pad(f"dayofyear({t})", 3),
        "m": form("MM"), "M": form("mm"), "p": f"if(hour({t}) < 12, 'AM', 'PM')", "P": f"if(hour({t}) < 12, 'am', 'pm')", "R": form("HH:mm"), "s": f"CAST(CAST(floor({ms} / 1000D) AS BIGINT) AS STRING)", "S": form("ss"), "f": form("ss.SSS"),
        "T": form("HH:mm:ss"), "u": f"CAST(weekday({t}) + 1 AS STRING)", "w": f"CAST(dayofweek({t}) - 1 AS STRING)", "Y": form("yyyy"), "J": f"CAST({ms} / {_DAY}D + 2440587.5D AS STRING)",
        "U": pad(f"CAST(floor((dayofyear({t}) + 7 - dayofweek({t})) / 7) AS INT)", 2), "W": pad(f"CAST(floor((dayofyear({t}) + 6 - weekday({t})) / 7) AS INT)", 2), "V": pad(f"weekofyear({t})", 2),
        "G": f"CAST(extract(YEAROFWEEK FROM {t}) AS STRING)", "g": f"substring(CAST(extract(YEAROFWEEK FROM {t}) AS STRING), 3, 2)", "%": "'%'",
    }
    pieces, at = [], 0
    for k in re.finditer("%(.?)", m[1]):
        if k[1] not in codes:
            return "CAST(NULL AS STRING)", "text"
        pieces += [f"'{m[1][at : k.start()]}'", codes[k[1]]]
        at = k.end()
    return _let("ms", at_ms, f"concat({', '.join([*pieces, chr(39) + m[1][at:] + chr(39)])})"), "text"


def timediff(xs: list[Arg]) -> Arg:
    """How far the first time lies after the second: whole months first, overflowing forward as '+N months' does."""
    a, b = _instant(xs[:1])[0], _instant(xs[1:])[0]
    apart = "((year(timestamp_millis(e.high)) - year(timestamp_millis(e.low))) * 12 + month(timestamp_millis(e.high)) - month(timestamp_millis(e.low)))"
    months = f"struct(e.a AS a, e.b AS b, e.low AS low, e.high AS high, {apart} AS n)"
    whole = f"struct(f.a AS a, f.b AS b, f.low AS low, f.high AS high, f.n - if({_shift_months('f.low', 'f.n')} > f.high, 1, 0) AS n)"
    rest = f"struct(g.a >= g.b AS later, g.n AS n, g.high - {_shift_months('g.low', 'g.n')} AS rest)"
    pad = lambda x, n: f"lpad(CAST(CAST({x} AS BIGINT) AS STRING), {n}, '0')"
    left = f"pmod(h.rest, {_DAY}L)"
    shown = (f"concat(if(h.later, '+', '-'), {pad('floor(h.n / 12)', 4)}, '-', {pad('pmod(h.n, 12)', 2)}, '-', {pad(f'floor(h.rest / {_DAY})', 2)}, ' ', "
             f"{pad(f'floor({left} / 3600000)', 2)}, ':', {pad(f'pmod(floor({left} / 60000), 60)', 2)}, ':', {pad(f'pmod(floor({left} / 1000), 60)', 2)}, '.', {pad(f'pmod({left}, 1000)', 3)})")
    ends = "struct(d.a AS a, d.b AS b, least(d.a, d.b) AS low, greatest(d.a, d.b) AS high)"
    out = _let("h", rest, shown)
    for name, value in (("g", whole), ("f", months), ("e", ends), ("d", f"struct({a} AS a, {b} AS b)")):
        out = _let(name, value, out)
    return out, "text"


SCALARS = {
    "date": _shown("yyyy-MM-dd", "yyyy-MM-dd"), "time": _shown("HH:mm:ss", "HH:mm:ss.SSS"), "datetime": _shown("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS"),
    "julianday": julianday, "unixepoch": unixepoch, "strftime": strftime, "timediff": timediff,
}
__all__ = ["SCALARS", "literal"]
