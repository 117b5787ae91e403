"""Storage classes, affinity, casts and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER_PREFIX = r"^\s*([+-]?\d+)"
_REAL_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def affinity(declared: str | None) -> str:
    """The affinity of a declared type, by the first rule that fits."""
    name = (declared or "").upper()
    for parts, found in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT"), (("BLOB",), "BLOB"), (("REAL", "FLOA", "DOUB"), "REAL")):
        if any(p in name for p in parts):
            return found
    return "NUMERIC" if name else "BLOB"


def cast_integer(x: Column) -> Column:
    """The longest integer prefix; 0 where there is none."""
    return F.when(x.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(x, _INTEGER_PREFIX, 1), F.lit("")).try_cast("long"), F.lit(0).cast("long")))


def cast_real(x: Column) -> Column:
    """The longest numeric prefix; 0.0 where there is none."""
    return F.when(x.isNotNull(), F.coalesce(F.nullif(F.regexp_extract(x, _REAL_PREFIX, 1), F.lit("")).cast("double"), F.lit(0.0)))


def truth(x: Column) -> Column:
    """Any number but zero is true; NULL stays unknown."""
    return x != 0


def flag(x: Column) -> Column:
    """A truth value as 1 or 0."""
    return x.cast("int").cast("long")


def type_name(x: Column, kind: str) -> Column:
    """null, integer, real, text or blob, from the column's Spark type."""
    name = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "double": "real", "float": "real", "string": "text", "binary": "blob"}.get(kind, "text")
    return F.when(x.isNull(), "null").otherwise(name)


def quote(x: Column, kind: str = "string") -> Column:
    if kind == "string":
        shown = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    elif kind == "binary":
        shown = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    else:
        shown = x.cast("string")
    return F.coalesce(shown, F.lit("NULL"))


def hex_(x: Column) -> Column:
    return F.hex(x.cast("string"))


def unhex(x: Column, ignored: str = "") -> Column:
    clean = F.translate(x, ignored, "") if ignored else x
    return F.when(clean.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(clean))


def char(*codes: int) -> Column:
    return F.lit("".join(map(chr, codes)))


def unicode_(x: Column) -> Column:
    return F.nullif(F.ascii(x), F.lit(0)).cast("long")


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), n.cast("int")))


def row_less(left: list[Column], right: list[Column]) -> Column:
    """Lexicographic < of row values with three-valued logic."""
    out = left[-1] < right[-1]
    for a, b in zip(left[-2::-1], right[-2::-1], strict=True):
        out = (a < b) | ((a == b) & out)
    return out


def row_equal(left: list[Column], right: list[Column]) -> Column:
    out = left[0] == right[0]
    for a, b in zip(left[1:], right[1:], strict=True):
        out = out & (a == b)
    return out


#: collation names -> Spark collations; NOCASE columns with letters beyond ASCII use ``strings.lower`` keys instead
COLLATIONS = {"BINARY": "UTF8_BINARY", "NOCASE": "UTF8_LCASE", "RTRIM": "UTF8_BINARY_RTRIM"}


def collate(x: Column, name: str) -> Column:
    return F.collate(x, COLLATIONS[name.upper()])
