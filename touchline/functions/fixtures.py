"""Difficulty of fixtures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import fixed


def noise_factor(difficulty: Column) -> Column:
    """Factor on the observation noise, linear between whole difficulties of 1 to 5."""
    knots = F.array(*map(F.lit, fixed.FIXTURE_NOISE))
    d = F.least(F.lit(5.0), F.greatest(F.lit(1.0), difficulty.cast("double")))
    low = F.least(F.floor(d), F.lit(4)).cast("int")
    a, b = F.element_at(knots, low), F.element_at(knots, low + 1)
    return a + (b - a) * (d - low)


def with_venue(rating: Column, home: Column) -> Column:
    """A rating (3 if null), half a step easier at home and harder away."""
    d = F.coalesce(rating.cast("double"), F.lit(3.0))
    return F.when(home, F.greatest(F.lit(1.0), d - 0.5)).otherwise(F.least(F.lit(5.0), d + 0.5))


def difficulty(ratings: Column, homes: Column) -> Column:
    """Mean difficulty of an array of fixtures; 3 for none."""
    each = F.transform(F.arrays_zip(ratings.alias("r"), homes.alias("h")), lambda x: with_venue(x["r"], x["h"]))
    total = F.aggregate(each, F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.try_divide(total, F.nullif(F.size(each), F.lit(0))), F.lit(3.0))


def advantage(d: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (6 - F.coalesce(d, F.lit(3.5))) / 5))


def congestion(games: Column, days: int = 14) -> Column:
    """0 for one game a week, 1 for three or more."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (games / (days / 7.0) - 1) / 2))
