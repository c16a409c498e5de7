"""Features of a player's series. All windows share one partitioning and order, so they take one exchange and one sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.arrays import ewma, running_ewma

from .gameweek import in_order

FIRST = Window.unboundedPreceding
KEY_COLUMNS = ["points", "minutes", "xG", "xA", "bonus"]
WINDOWS, LAGS, ALPHAS, TRENDS = [3, 5, 10], [1, 2, 3], [0.3, 0.5], [5, 10]
FUNCTIONS: dict[str, Callable[[str], Column]] = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def rolling(columns: list[str], windows: list[int] = WINDOWS, functions: list[str] = ["mean", "std"]) -> dict[str, Column]:  # noqa: B006
    """From the first row on; the standard deviation is that of a sample, null for one row."""
    w = in_order()
    return {f"{c}_rolling_{n}_{f}": FUNCTIONS[f](c).over(w.rowsBetween(1 - n, 0)) for c in columns for n in windows for f in functions}


def lags(columns: list[str], periods: list[int] = LAGS) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(in_order()) for c in columns for k in periods}


def differences(columns: list[str], periods: list[int] = [1]) -> dict[str, Column]:  # noqa: B006
    return {f"{c}_diff_{k}": F.col(c) - F.lag(c, k).over(in_order()) for c in columns for k in periods}


def trends(columns: list[str], windows: list[int] = TRENDS) -> dict[str, Column]:
    """Slope of the least-squares line over the window's rows, from two values on. Needs a column ``__at``, the row's number."""
    return {f"{c}_trend_{n}": F.regr_slope(F.col(c).cast("double"), F.col("__at")).over(in_order().rowsBetween(1 - n, 0)) for c in columns for n in windows}


def consistency(columns: list[str], window: int = 5) -> dict[str, Column]:
    frame = in_order().rowsBetween(1 - window, 0)
    return {f"{c}_consistency_{window}": F.stddev_samp(c).over(frame) / (F.avg(c).over(frame) + 1e-6) for c in columns}


def ewma_name(column: str, alpha: float) -> str:
    return f"{column}_ewma_{int(alpha * 100)}"


def with_ewma(df: DataFrame, columns: list[str], alphas: list[float] = ALPHAS) -> DataFrame:
    """Running exponentially weighted means. A player's rows meet in one array of a season's length and are laid out again."""
    names = {ewma_name(c, a): (c, a) for c in columns for a in alphas}
    whole = df.groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("gameweek", *[F.col(c).cast("double").alias(c) for c in columns]))).alias("s"))
    runs = [running_ewma(F.col("s")[c], a).alias(n) for n, (c, a) in names.items()]
    flat = whole.select("player_id", F.explode(F.arrays_zip(F.col("s.gameweek").alias("gameweek"), *runs)).alias("r")).select("player_id", "r.*")
    return df.join(flat, ["player_id", "gameweek"])


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key columns as numbers; what is no number is 0."""
    plain = {c: F.coalesce(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    return df.withColumns(plain)


def features(df: DataFrame, *, columns: list[str] = KEY_COLUMNS, windows: list[int] = WINDOWS, periods: list[int] = LAGS, alphas: list[float] = ALPHAS, slopes: list[int] = TRENDS) -> DataFrame:
    """All features of the key columns that ``df`` has: 72 for the five of them."""
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    base = with_ewma(coerced(df, columns), columns, alphas).withColumn("__at", F.row_number().over(in_order()))
    steady = [c for c in ("minutes", "points") if c in columns]
    return base.withColumns(rolling(columns, windows) | lags(columns, periods) | trends(columns, slopes) | differences(columns) | consistency(steady)).drop("__at")


def feature_names(columns: list[str] = KEY_COLUMNS) -> list[str]:
    """Names of all features, column by column."""
    out = []
    for c in columns:
        out += [f"{c}_rolling_{n}_{f}" for n in WINDOWS for f in ("mean", "std")] + [f"{c}_lag_{k}" for k in LAGS] + [ewma_name(c, a) for a in ALPHAS] + [f"{c}_trend_{n}" for n in TRENDS] + [f"{c}_diff_1"]
        out += [f"{c}_consistency_5"] * (c in ("minutes", "points"))
    return out


def future_features(df: DataFrame, horizon: int = 1, **how) -> DataFrame:
    """Features of ``horizon`` coming gameweeks, for which each player's last row stands in."""
    last = F.max_by(F.struct(*df.columns), "gameweek").alias("x")
    ahead = df.groupBy("player_id").agg(last).select("x.*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("ahead")).withColumn("gameweek", F.col("gameweek") + F.col("ahead"))
    return features(df.withColumn("ahead", F.lit(0)).unionByName(ahead), **how).filter("ahead > 0")


def rolling_baseline(points: str = "points", window: int = 5) -> Column:
    """Mean of the last ``window`` gameweeks before each; 0 without history."""
    return F.coalesce(F.avg(points).over(in_order().rowsBetween(-window, -1)), F.lit(0.0))


def ewma_baseline(points: str = "points", alpha: float = 0.3) -> Column:
    """Exponentially weighted mean of the gameweeks before each; 0 without history."""
    past = F.collect_list(F.col(points).cast("double")).over(in_order().rowsBetween(FIRST, -1))
    return ewma(past, alpha)


def last_value(points: str = "points") -> Column:
    return F.lag(points).over(in_order())





def form_forecast(base: Column, minutes: Column, slope: Column) -> Column:
    """A baseline made less for few minutes and more or less for a trend; not below 0."""
    few = F.when(minutes < 60, base * 0.7).otherwise(base)
    return F.greatest(F.lit(0.0), F.when(slope > 0.5, few * 1.1).when(slope < -0.5, few * 0.9).otherwise(few))


def stats_signal(row: Callable[[str], Column]) -> Column:
    """One score from a player's latest features; a feature that is null adds nothing, except that the trend counts upward only."""
    part = lambda c: F.coalesce(c, F.lit(0.0))
    score = part(row("points_rolling_5_mean") * 0.3) + part(row("xG_rolling_5_mean") * 10 * 0.15) + part(row("xA_rolling_5_mean") * 10 * 0.15)
    score = score + part(1 / (1 + row("minutes_consistency_5")) * 10 * 0.2) + part(F.greatest(F.lit(0.0), row("points_trend_5")) * 5 * 0.2)
    return F.greatest(F.lit(0.0), score)


def latest(df: DataFrame) -> DataFrame:
    """Each player's last row."""
    return df.groupBy("player_id").agg(F.max_by(F.struct(*[c for c in df.columns if c != "player_id"]), "gameweek").alias("x")).select("player_id", "x.*")


def folds(rows: DataFrame, *, train: int, test: int, step: int) -> DataFrame:
    """Sliding folds over each player's rows: one row per fold and row with its role (train or test). Players with too few rows have none.

    A row lies in at most (train + test) / step folds, which follow from its number alone; no join is needed.
    """
    if min(train, test, step) < 1:
        raise ValueError("train, test and step are at least 1")
    w = in_order()
    n = F.count("*").over(w.rowsBetween(FIRST, Window.unboundedFollowing))
    numbered = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    last = F.floor((F.col("__n") - train - test) / step)
    low = F.greatest(F.lit(0), F.floor((F.col("__i") - train - test) / step) + 1)
    high = F.least(last, F.floor(F.col("__i") / step))
    out = numbered.filter((last >= 0) & (low <= high)).withColumn("fold", F.explode(F.sequence(low, high)))
    return out.withColumn("role", F.when(F.col("__i") < F.col("fold") * step + train, "train").otherwise("test")).drop("__i", "__n")
