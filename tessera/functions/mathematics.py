"""Numeric functions: NaN is NULL, infinities stay, integers keep to 64 bits."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _d(x: Column) -> Column:
    return x.cast("double")


def add(a: Column, b: Column) -> Column:
    """Integers that overflow become reals."""
    return F.coalesce(F.try_add(a, b).cast("double"), _d(a) + _d(b))


def subtract(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b).cast("double"), _d(a) - _d(b))


def multiply(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b).cast("double"), _d(a) * _d(b))


def divide(a: Column, b: Column) -> Column:
    """Integer division truncates; by zero gives NULL."""
    x, y = a.cast("long"), b.cast("long")
    return F.when(y != 0, F.call_function("div", x, F.when(y != 0, y)))


def divide_real(a: Column, b: Column) -> Column:
    return F.try_divide(_d(a), _d(b))


def remainder(a: Column, b: Column) -> Column:
    return F.try_mod(a.cast("long"), b.cast("long"))


def shift_left(x: Column, n: int) -> Column:
    if n < 0:
        return shift_right(x, -n)
    return F.shiftleft(x.cast("long"), n) if n < 64 else F.when(x.isNotNull(), F.lit(0).cast("long"))


def shift_right(x: Column, n: int) -> Column:
    if n < 0:
        return shift_left(x, -n)
    return F.shiftright(x.cast("long"), min(n, 63))


def sign(x: Column) -> Column:
    return F.signum(x).cast("long")


def least(*xs: Column) -> Column:
    """NULL if any argument is."""
    return F.when(_all(xs), F.least(*xs))


def greatest(*xs: Column) -> Column:
    return F.when(_all(xs), F.greatest(*xs))


def _all(xs) -> Column:
    found = xs[0].isNotNull()
    for x in xs[1:]:
        found = found & x.isNotNull()
    return found


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def round_(x: Column, digits: int = 0) -> Column:
    return F.round(_d(x), max(digits, 0))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(_d(x)))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(_d(x)))


def log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(_d(x)))


def log(base: float, x: Column) -> Column:
    return F.when(x > 0, F.log(_d(x)) / math.log(base))


def power(x: Column, y) -> Column:
    return no_nan(F.pow(_d(x), y if isinstance(y, Column) else F.lit(float(y))))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(_d(x)))


def mod(x: Column, y: Column) -> Column:
    return F.when(y != 0, F.try_mod(_d(x), _d(y)))


def asin(x: Column) -> Column:
    return no_nan(F.asin(_d(x)))


def acos(x: Column) -> Column:
    return no_nan(F.acos(_d(x)))


def acosh(x: Column) -> Column:
    return no_nan(F.acosh(_d(x)))


def atanh(x: Column) -> Column:
    return no_nan(F.atanh(_d(x)))
