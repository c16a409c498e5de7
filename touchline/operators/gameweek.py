"""From fixtures to gameweeks: one row per player and gameweek."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from touchline import fixed

KEYS = ["player_id", "gameweek"]


def in_order(player: str = "player_id", time: str = "gameweek") -> WindowSpec:
    """The window that every series of a player shares, so that they take one exchange and one sort."""
    return Window.partitionBy(player).orderBy(time)


def played(rows: DataFrame, *, least: int = 2) -> DataFrame:
    """Each player's rows with minutes; of a player with fewer than ``least`` such rows, all."""
    on = F.coalesce(F.col("minutes") > 0, F.lit(False))
    return rows.withColumn("__n", F.count(F.when(on, 1)).over(Window.partitionBy("player_id"))).filter(on | (F.col("__n") < least)).drop("__n")


def played_before(value: str = "points", *, least: int = 2) -> Column:
    """The values of the gameweeks before each in order, of those with minutes if these are ``least`` or more, else of all."""
    past = F.collect_list(F.struct(F.col("minutes").alias("m"), F.col(value).cast("double").alias("v"))).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    on = F.filter(past, lambda r: r["m"] > 0)
    return F.transform(F.when(F.size(on) >= least, on).otherwise(past), lambda r: r["v"])


def per_gameweek(rows: DataFrame, *, order: str = "fixture_id") -> DataFrame:
    """Sums, means and last values over a player's fixtures of a gameweek, by fixed lists; other columns take the last value.

    Adds n_fixtures, points_norm and ``<column>_norm`` for what is summed. Rows with a null key drop out. Sums are partial
    before the shuffle.
    """
    rows = rows.filter(" and ".join(f"{k} is not null" for k in KEYS))
    summed, averaged = [c for c in fixed.SUMMED if c in rows.columns], [c for c in fixed.AVERAGED if c in rows.columns]
    rest = [c for c in rows.columns if c not in {*KEYS, *summed, *averaged, order}]
    out = rows.groupBy(*KEYS).agg(F.count("*").alias("n_fixtures"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in summed], *[F.avg(c).alias(c) for c in averaged], *[F.max_by(c, order).alias(c) for c in rest])
    return out.withColumns({f"{c}_norm": F.col(c) / F.col("n_fixtures") for c in summed})


def fixture_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n_fixtures"))


def upcoming_counts(players: DataFrame, fixtures: DataFrame, *, absent: int = 0) -> DataFrame:
    """How many fixtures each player's club has; ``fixtures`` has team_h and team_a. Clubs without one have ``absent``."""
    sides = fixtures.select(F.explode(F.array("team_h", "team_a")).alias("team")).groupBy("team").agg(F.count("*").alias("n_fixtures"))
    return players.join(sides, "team", "left").withColumn("n_fixtures", F.coalesce("n_fixtures", F.lit(absent).cast("long")))


def actual_points(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("points").alias("actual_points"))


def fixture_info(rows: DataFrame, *, order: str = "fixture_id") -> DataFrame:
    """Venue, opponent and the provider's forecast of each player's last fixture of a gameweek."""
    return rows.groupBy(*KEYS).agg(*[F.max_by(c, order).alias(c) for c in ("was_home", "opponent_team", "xP")])


def fixture_map(rows: DataFrame) -> DataFrame:
    """One row per player: a map from gameweek to fixtures."""
    return fixture_counts(rows).groupBy("player_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gameweek", "n_fixtures")))).alias("fixtures"))


def valid_players(rows: DataFrame, *, least_history: int = 5, least_players: int = 50) -> DataFrame:
    """Players with enough history before each gameweek they appear in; gameweeks with too few of them drop out.

    The second step counts per gameweek and joins the few counts back: the largest group is never brought together.
    """
    seen = rows.withColumn("n_history", F.row_number().over(in_order()) - 1).filter(F.col("n_history") >= least_history)
    enough = seen.groupBy("gameweek").agg(F.count("*").alias("__n")).filter(F.col("__n") >= least_players).drop("__n")
    return seen.join(enough, "gameweek", "left_semi")


def availability(minutes: str = "minutes", *, weeks: int = 3, least: float = 0.05) -> Column:
    """Share of a player's last ``weeks`` gameweeks with minutes, before each; ``least`` for none, 1 without history."""
    share = F.avg((F.col(minutes) > 0).cast("double")).over(in_order().rowsBetween(-weeks, -1))
    return F.when(share.isNull(), 1.0).when(share == 0, least).otherwise(share)
