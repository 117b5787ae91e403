"""String functions with the dialect's semantics, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def length(x: Column) -> Column:
    """Characters before the first NUL."""
    return F.length(F.substring_index(x, "\0", 1)).cast("long")


def octet_length(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def substr(x: Column, start, size=None) -> Column:
    """1-based; a negative start counts from the right, zero stands before the first character, and a negative size
    takes the characters to the left of the start."""
    n, y = F.length(x).cast("long"), _lit(start).cast("long")
    first = F.when(y > 0, y).when(y < 0, n + y + 1).otherwise(F.lit(0))
    if size is None:
        low, high = first, n + 1
    else:
        z = _lit(size).cast("long")
        low = F.when(z >= 0, first).otherwise(first + z)
        high = F.when(z >= 0, first + z).otherwise(first)
    low = F.greatest(low, F.lit(1))
    return F.substr(x, low.cast("int"), F.greatest(F.least(high, n + 1) - low, F.lit(0)).cast("int"))


def upper(x: Column) -> Column:
    """ASCII letters only."""
    return F.translate(x, LOWER, UPPER)


def lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def trim(x: Column, chars: str = " ") -> Column:
    return F.btrim(x, F.lit(chars))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def replace(x: Column, old, new) -> Column:
    return F.replace(x, _lit(old), _lit(new))


def instr(x: Column, y) -> Column:
    return F.instr(x, _lit(y)).cast("long")


def concat(*xs: Column) -> Column:
    """NULL arguments are skipped."""
    return F.concat_ws("", *[x.cast("string") for x in xs])


def concat_ws(separator: str | None, *xs: Column) -> Column:
    return F.lit(None).cast("string") if separator is None else F.concat_ws(separator, *[x.cast("string") for x in xs])


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """Case-insensitive for ASCII letters."""
    return F.like(lower(x), F.lit("".join(c.lower() if c in UPPER else c for c in pattern)), F.lit(escape) if escape else None)


def glob_pattern(pattern: str) -> str:
    """An anchored regular expression for ``* ? [..] [^..]``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = pattern[i + 1 : end]
            negated = inner.startswith("^")
            body = inner[negated:].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out.append(f"[{'^' * negated}{body}]")
            i = end
        else:
            out.append({"*": ".*", "?": "."}.get(c, "\\" + c if not c.isalnum() and c.isascii() and c != " " else c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_pattern(pattern))


def printf(template: str, *xs: Column) -> Column:
    """Constant templates of %d %i %u %s %f %e %g %x %X %o %c %q %Q %w %% with flags; NULL numbers print as 0, NULL text as nothing."""
    import re

    pieces, at, left = [], 0, list(xs)
    for m in re.finditer(r"%([-+ 0,#!]*)(\d*)(?:\.(\d+))?([diufeEgGxXoszcqQw%])", template):
        pieces.append(F.lit(template[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind == "%":
            pieces.append(F.lit("%"))
            continue
        x = left.pop(0) if left else F.lit(None)
        spec = "%" + flags.replace("!", "").replace("#", "" if kind in "diu" else "#") + width
        if kind in "diu":
            shown = F.format_string(spec + "d", F.coalesce(x.cast("long"), F.lit(0).cast("long")))
        elif kind in "xXo":
            shown = F.format_string(spec + kind, F.coalesce(x.cast("long"), F.lit(0).cast("long")))
        elif kind in "feEgG":
            shown = F.format_string(f"{spec}.{precision or 6}{kind}", F.coalesce(x.cast("double"), F.lit(0.0)))
        else:
            text = x.cast("string")
            if kind in "qQ":
                text = F.replace(text, F.lit("'"), F.lit("''"))
            if kind == "w":
                text = F.replace(text, F.lit('"'), F.lit('""'))
            if kind == "Q":
                text = F.coalesce(F.concat(F.lit("'"), text, F.lit("'")), F.lit("NULL"))
            if kind == "c":
                text = F.substring(text, 1, 1)
            text = F.coalesce(text, F.lit("(NULL)" if kind in "q" else ""))
            if precision and kind != "c":
                text = F.substring(text, 1, int(precision))
            shown = F.format_string(f"%{'-' if '-' in flags else ''}{width}s", text) if width else text
        pieces.append(shown)
    pieces.append(F.lit(template[at:]))
    return F.concat(*pieces)
