"""Small array helpers for ordered folds; histories of one player are short (a season's gameweeks)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def divided(a: Column, b: Column) -> Column:
    """``a`` by ``b`` of at least 0 as floating point has it: by zero it is infinite, or NaN where ``a`` is zero too."""
    return F.when(b == 0, a * F.lit(math.inf)).otherwise(a / b)


def nearest(value: Column, digits: int) -> Column:
    """To ``digits`` as DuckDB has it: the shifted value goes to the nearest whole number, halves away from zero."""

    def whole(x: Column) -> Column:
        size = F.abs(x)
        return F.signum(x) * (F.rint(size) + F.when(size - F.rint(size) == 0.5, 1.0).otherwise(0.0)) / 10.0**digits

    return bind(bind(value * 10.0**digits, whole), lambda x: F.when(F.abs(x) < math.inf, x).otherwise(value))


def ewma(values: Column, alpha: float) -> Column:
    """The last exponentially weighted mean of an ordered array; it starts at the first value, 0 for none."""
    start = F.struct(F.lit(0.0).alias("y"), F.lit(True).alias("first"))
    step = lambda acc, x: F.struct(F.when(acc["first"], x.cast("double")).otherwise(x.cast("double") * alpha + acc["y"] * (1 - alpha)).alias("y"), F.lit(False).alias("first"))
    return F.aggregate(values, start, step)["y"]


def running_ewma(values: Column, alpha: float) -> Column:
    """The exponentially weighted mean at every place of an ordered array."""
    step = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) * (1 - alpha) + x.cast("double") * alpha, x.cast("double"))))
    return F.aggregate(values, F.array().cast("array<double>"), step)
