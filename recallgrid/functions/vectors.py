"""Vector expressions on array columns."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with ``value`` evaluated once a row: an expression used in a lambda is evaluated anew for every element."""
    return F.transform(F.array(value), f)[0]


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2_sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def normalise(a: Column) -> Column:
    by = lambda v, n: F.transform(v, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))
    return once(a, lambda v: once(norm(v), lambda n: by(v, n)))


def int8(a: Column) -> Column:
    """round(x * 127) within -127..127, halves away from zero."""
    return F.transform(a, lambda x: F.greatest(F.least(F.round(x * 127), F.lit(127.0)), F.lit(-127.0)).cast("tinyint"))
