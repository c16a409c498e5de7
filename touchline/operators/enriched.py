"""The structural forecast: expected points by the rules of scoring, recent form, venue and opponent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.arrays import bind
from touchline.functions.scoring import expected_points, zero_if_null

from .gameweek import in_order

STATS = ["minutes", "points", "xG", "xA", "goals", "assists", "clean_sheets", "goals_conceded", "bonus", "saves", "yellow_cards", "red_cards", "own_goals", "penalties_missed", "penalties_saved"]
FIRST = Window.unboundedPreceding


def _or_zero(df: DataFrame) -> Callable[[str], Column]:
    return lambda c: F.col(c) if c in df.columns else F.lit(0.0)


def with_expected_points(df: DataFrame, *, frame: int | None = None) -> DataFrame:
    """Adds xpts. A player whose expected goals (assists) are all zero in the frame is scored by the real ones.

    The frame is the player's whole table, or the last ``frame`` gameweeks up to each row.
    """
    get = _or_zero(df)
    w = Window.partitionBy("player_id") if frame is None else in_order().rowsBetween(1 - frame, 0)
    some = lambda c: F.max(F.abs(zero_if_null(get(c)))).over(w) > 0
    out = df.withColumn("__xg", F.when(some("xG"), zero_if_null(get("xG"))).otherwise(zero_if_null(get("goals")))).withColumn("__xa", F.when(some("xA"), zero_if_null(get("xA"))).otherwise(zero_if_null(get("assists"))))
    return out.withColumn("xpts", expected_points(get, F.col("position"), F.col("__xg"), F.col("__xa"))).drop("__xg", "__xa")


def venue_factors(df: DataFrame) -> dict[str, Column]:
    """home_factor and away_factor from all gameweeks before each."""
    past = in_order().rowsBetween(FIRST, -1)
    played = zero_if_null(F.col("minutes")) > 0
    points = zero_if_null(F.col("points"))
    home = zero_if_null(F.col("was_home").cast("double")) > 0.5
    overall = F.avg(F.when(played, points)).over(past)
    fine = (F.count(F.when(played, 1)).over(past) >= 4) & (overall >= 0.5)

    def factor(at: Column) -> Column:
        value = F.avg(F.when(played & at, points)).over(past)
        enough = F.count(F.when(played & at, 1)).over(past) >= 2
        return F.coalesce(F.when(fine & enough, F.least(F.lit(1.3), F.greatest(F.lit(0.8), value / overall))), F.lit(1.0))

    return {"home_factor": factor(home), "away_factor": factor(~home)}


def opponent_factor(df: DataFrame) -> Column:
    """How a player did against each row's opponent before, against how it did at all.

    A window by player and opponent lies inside the partitioning by player, so it takes a sort and no exchange.
    """
    played = zero_if_null(F.col("minutes")) > 0
    points = zero_if_null(F.col("points"))
    overall = F.coalesce(F.avg(F.when(played, points)).over(in_order().rowsBetween(FIRST, -1)), F.lit(2.0))
    against = F.avg(F.when(played, points)).over(Window.partitionBy("player_id", "opponent_team").orderBy("gameweek").rowsBetween(FIRST, -1))
    known = F.coalesce(F.col("opponent_team") > 0, F.lit(False))
    return F.when(known & (overall >= 0.5) & against.isNotNull(), F.least(F.lit(1.6), F.greatest(F.lit(0.6), against / overall))).otherwise(1.0)


def enriched(df: DataFrame, *, alpha: float = 0.3, lookback: int = 15, fixture: bool = True) -> DataFrame:
    """Mean, variance and downside risk (enr_mean, enr_var, enr_down) of each gameweek's points from the gameweeks before it.

    ``df`` has one row per player and gameweek; its own row tells only venue, opponent and the provider's forecast (xP).
    """
    get = _or_zero(df)
    past = in_order().rowsBetween(-lookback, -1)
    out = df.withColumn("__h", F.collect_list(F.struct(*[zero_if_null(get(c)).alias(c) for c in STATS])).over(past))
    if fixture:
        out = out.withColumns(venue_factors(df)).withColumn("opponent_factor", opponent_factor(df))
    return _forecast(out, alpha, lookback, fixture, get)


def weighted_sum(values: Column, alpha: float, most: int) -> Column:
    """The last exponentially weighted mean of an array of ``most`` values or fewer, 0 for none: a sum of each value by its power and its
    share, from the first on. ``arrays.ewma`` folds; its last bits differ."""
    powers = F.array(*[F.lit((1 - alpha) ** k) for k in range(max(most, 1))])
    parts = F.transform(values, lambda v, i: v * F.element_at(powers, F.size(values) - i) * F.when(i == 0, 1.0).otherwise(alpha))
    return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)


def variance(values: Column) -> Column:
    """The mean square around the mean in one pass; null for none."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sq"))

    def step(acc: Column, x: Column) -> Column:
        n = acc["n"] + 1.0
        return bind(acc["mean"] + (x - acc["mean"]) / n, lambda m: F.struct(n.alias("n"), m.alias("mean"), (acc["sq"] + (x - m) * (x - acc["mean"])).alias("sq")))

    return F.aggregate(values, start, step, lambda acc: F.when(acc["n"] > 0, acc["sq"] / acc["n"]))


def _forecast(out: DataFrame, alpha: float, lookback: int, fixture: bool, get: Callable[[str], Column]) -> DataFrame:
    h = F.col("__h")
    zero = lambda c: F.forall(h, lambda x: x[c] == 0)
    scored = lambda x: F.struct(expected_points(lambda c: x[c], F.col("position"), F.when(F.col("__nog"), x["goals"]).otherwise(x["xG"]), F.when(F.col("__noa"), x["assists"]).otherwise(x["xA"])).alias("x"), x["points"].alias("p"))
    out = out.withColumn("__nog", zero("xG")).withColumn("__noa", zero("xA"))
    out = out.withColumn("__s", F.transform(F.filter(h, lambda x: x["minutes"] > 0), scored))
    mean = lambda arr: F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, b: a + b), F.nullif(F.size(arr), F.lit(0)))
    recent = F.slice(h, F.greatest(F.lit(1), F.size(h) - 2), 3)
    out = out.withColumn("__avail", mean(F.transform(recent, lambda x: (x["minutes"] > 0).cast("double"))))
    out = out.withColumn("__res", F.transform("__s", lambda s: s["p"] - s["x"]))
    out = out.withColumn("__var", variance(F.col("__res")) + 1.0)
    out = out.withColumn("__neg", F.transform(F.filter("__res", lambda r: r < 0), lambda r: r * r))
    out = out.withColumn("__down", F.when(F.size("__neg") >= 2, F.sqrt(mean(F.col("__neg")))).otherwise(F.sqrt("__var") * 0.5))
    form = F.greatest(F.lit(0.0), weighted_sum(F.transform("__s", lambda s: s["x"]), alpha, lookback))
    if fixture:
        form = form * F.when(zero_if_null(F.col("was_home").cast("double")) > 0.5, F.col("home_factor")).otherwise(F.col("away_factor")) * F.col("opponent_factor")
        form = F.when(zero_if_null(get("xP")) > 0, 0.7 * form + 0.3 * zero_if_null(get("xP"))).otherwise(form)
    out = out.withColumn("__form", form)
    few, gone, a = F.size("__s") < 2, F.col("__avail") < 0.1, F.col("__avail")
    out = out.withColumn("enr_mean", F.when(few | gone, 0.0).otherwise(F.col("__form") * a))
    out = out.withColumn("enr_var", F.when(few, 4.0).when(gone, 1.0).otherwise(a * F.col("__var") + a * (1 - a) * F.col("__form") * F.col("__form")))
    out = out.withColumn("enr_down", F.when(few | gone, 0.0).otherwise(F.col("__down") * a))
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def panel(df: DataFrame) -> DataFrame:
    """A training panel: group, time, clean inputs with defaults, target; rows without a group, time or target drop out."""
    get = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)
    rows = with_expected_points(df)
    return rows.select(
        F.col("player_id").cast("string").alias("group_id"), F.col("gameweek").cast("int").alias("time_idx"), get("position", "MID").alias("position"), get("team", -1).cast("string").alias("team"), get("fixture_difficulty", 3.0).cast("double").alias("fixture_difficulty"),
        get("was_home", 0).cast("double").alias("is_home"), F.col("xpts").alias("xPts"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), zero_if_null(F.col("minutes")) / 90)).alias("mins_frac"), get("news_sentiment", 0.0).cast("double").alias("news_sentiment"), F.col("points").cast("double").alias("actual_points"),
    ).dropna(subset=["group_id", "time_idx", "actual_points"])


def eligible(panel_rows: DataFrame, *, encoder: int, horizon: int = 1) -> tuple[DataFrame, int]:
    """Rows of the groups long enough for an encoder of ``encoder`` gameweeks (less if no history is that long), and the length used."""
    lengths = panel_rows.groupBy("group_id").agg(F.count_distinct("time_idx").alias("n"))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    used = min(encoder, longest - horizon)
    if used < 1:
        raise ValueError(f"no group has more than {horizon} gameweeks")
    return panel_rows.join(lengths.filter(F.col("n") >= used + horizon), "group_id", "left_semi"), used
