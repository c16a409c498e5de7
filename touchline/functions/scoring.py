"""Points expected from what a player did, by the rules of the game."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline import fixed


def by_position(position: Column, points: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, p in points.items():
        out = F.when(position == name, F.lit(p)).otherwise(out)
    return out.cast("double")


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def expected_points(get: Callable[[str], Column], position: Column, goals: Column, assists: Column) -> Column:
    """``get`` gives a statistic's column; ``goals`` and ``assists`` are the expected ones where they exist, else the real ones."""
    x = lambda name: zero_if_null(get(name))
    keeper = position == "GK"
    total = (
        F.when(x("minutes") >= 60, 2.0).otherwise(1.0)
        + zero_if_null(goals) * by_position(position, fixed.GOAL_POINTS, 4)
        + zero_if_null(assists) * fixed.ASSIST_POINTS
        + x("clean_sheets") * by_position(position, fixed.CLEAN_SHEET_POINTS, 0)
        + F.floor(x("goals_conceded") / 2).cast("double") * by_position(position, fixed.CONCEDED_POINTS, 0)
        + x("bonus")
        + F.when(keeper, F.floor(x("saves") / 3).cast("double")).otherwise(0.0)
        + x("yellow_cards") * fixed.YELLOW_POINTS
        + x("red_cards") * fixed.RED_POINTS
        + x("own_goals") * fixed.OWN_GOAL_POINTS
        + x("penalties_missed") * fixed.MISSED_PENALTY_POINTS
        + F.when(keeper, x("penalties_saved") * fixed.SAVED_PENALTY_POINTS).otherwise(0.0)
    )
    return F.when(x("minutes") > 0, total + 0.0).otherwise(0.0)


def share_of_minutes(minutes: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), zero_if_null(minutes) / 90))
