"""Date and time functions over UTC timestamps: constant modifiers become column arithmetic on milliseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def _months(ts: Column, n: int) -> Column:
    """Month arithmetic that overflows forward: 31 January + 1 month is in March."""
    total = F.year(ts) * 12 + F.month(ts) - 1 + n
    first = F.make_date(F.floor(total / 12).cast("int"), (F.pmod(total, F.lit(12)) + 1).cast("int"), F.lit(1))
    day = F.unix_millis(F.date_add(first, F.dayofmonth(ts) - 1).cast("timestamp"))
    return _ts(day + F.pmod(millis(ts), F.lit(86_400_000)))


def modify(ts: Column, *modifiers: str) -> Column:
    for m in (x.strip().lower() for x in modifiers):
        if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?) (second|minute|hour|day)s?", m):
            ts = _ts(millis(ts) + int(round(float(found[1]) * _UNIT[found[2]])))
        elif found := re.fullmatch(r"([+-]?\d+) (month|year)s?", m):
            ts = _months(ts, int(found[1]) * (12 if found[2] == "year" else 1))
        elif found := re.fullmatch(r"start of (day|month|year)", m):
            ts = F.date_trunc(found[1], ts)
        elif found := re.fullmatch(r"weekday ([0-6])", m):
            ts = _ts(millis(ts) + F.pmod(F.lit(int(found[1])) - (F.dayofweek(ts) - 1), F.lit(7)).cast("long") * _UNIT["day"])
        elif found := re.fullmatch(r"([+-])(\d\d):(\d\d)(?::(\d\d))?", m):
            part = (int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4] or 0)) * 1000
            ts = _ts(millis(ts) + (part if found[1] == "+" else -part))
        elif m not in ("utc", "localtime", "auto", "subsec"):
            return F.lit(None).cast("timestamp")
    return ts


def date(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "yyyy-MM-dd")


def time(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "HH:mm:ss")


def datetime(ts: Column, *modifiers: str) -> Column:
    return F.date_format(modify(ts, *modifiers), "yyyy-MM-dd HH:mm:ss")


def julianday(ts: Column, *modifiers: str) -> Column:
    return millis(modify(ts, *modifiers)) / 86_400_000.0 + 2440587.5


def unixepoch(ts: Column, *modifiers: str) -> Column:
    return F.floor(millis(modify(ts, *modifiers)) / 1000).cast("long")


def strftime(template: str, ts: Column, *modifiers: str) -> Column:
    """A constant template; an unknown code gives NULL."""
    t = modify(ts, *modifiers)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    fmt = lambda f: F.date_format(t, f)
    twelve = F.pmod(F.hour(t) + 11, F.lit(12)) + 1
    codes = {
        "d": fmt("dd"), "e": F.lpad(F.dayofmonth(t).cast("string"), 2, " "), "F": fmt("yyyy-MM-dd"), "H": fmt("HH"), "k": F.lpad(F.hour(t).cast("string"), 2, " "), "I": pad(twelve, 2), "l": F.lpad(twelve.cast("string"), 2, " "),
        "j": pad(F.dayofyear(t), 3), "m": fmt("MM"), "M": fmt("mm"), "p": F.when(F.hour(t) < 12, "AM").otherwise("PM"), "P": F.when(F.hour(t) < 12, "am").otherwise("pm"), "R": fmt("HH:mm"), "s": unixepoch(t).cast("string"), "S": fmt("ss"),
        "f": fmt("ss.SSS"), "T": fmt("HH:mm:ss"), "u": (F.weekday(t) + 1).cast("string"), "w": (F.dayofweek(t) - 1).cast("string"), "Y": fmt("yyyy"), "J": julianday(t).cast("string"),
        "U": pad(F.floor((F.dayofyear(t) + 7 - F.dayofweek(t) + 0) / 7), 2), "W": pad(F.floor((F.dayofyear(t) + 6 - F.weekday(t)) / 7), 2),
        "V": pad(F.weekofyear(t), 2), "G": F.extract(F.lit("YEAROFWEEK"), t).cast("string"), "g": F.substring(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), 3, 2), "%": F.lit("%"),
    }
    pieces, at = [], 0
    for m in re.finditer("%(.)", template):
        if m[1] not in codes:
            return F.lit(None).cast("string")
        pieces += [F.lit(template[at : m.start()]), codes[m[1]]]
        at = m.end()
    return F.concat(*pieces, F.lit(template[at:]))


def timediff(a: Column, b: Column) -> Column:
    """±YYYY-MM-DD HH:MM:SS.SSS, whole months first."""
    low, high = F.least(a, b), F.greatest(a, b)
    months = F.floor(F.months_between(high, low)).cast("int")
    rest = millis(high) - millis(_add_months(low, months))
    text = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    day, left = F.floor(rest / 86_400_000), F.pmod(rest, F.lit(86_400_000))
    return F.concat(
        F.when(a >= b, "+").otherwise("-"), text(F.floor(months / 12), 4), F.lit("-"), text(F.pmod(months, F.lit(12)), 2), F.lit("-"), text(day, 2), F.lit(" "),
        text(F.floor(left / 3_600_000), 2), F.lit(":"), text(F.floor(left / 60_000) % 60, 2), F.lit(":"), text(F.floor(left / 1000) % 60, 2), F.lit("."), text(left % 1000, 3))


def _add_months(ts: Column, n: Column) -> Column:
    return _ts(F.unix_millis(F.add_months(ts.cast("date"), n).cast("timestamp")) + F.pmod(millis(ts), F.lit(86_400_000)))
