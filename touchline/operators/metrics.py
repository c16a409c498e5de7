"""How good forecasts and squads were. Averages are partial before the shuffle; nothing but a few sums moves."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordered


def inference_metrics(forecasts: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``forecasts`` has mean, var and actual; one row (per group of ``by``): errors, interval coverage, mean deviation and likelihood."""
    e = F.col("mean") - F.col("actual")
    var = F.greatest(F.col("var"), F.lit(1e-8))
    inside = lambda z: F.avg((F.abs(e) <= z * F.sqrt(var)).cast("double"))
    return forecasts.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), inside(1.96).alias("coverage_95"), inside(0.674).alias("coverage_50"),
        F.avg(F.sqrt(var)).alias("mean_sd"), F.avg(-0.5 * (F.log(2 * math.pi * var) + e * e / var)).alias("log_likelihood"),
    )


def state_metrics(rows: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """``rows`` has mean and truth, state and true_state; squared error of the values and share of states that are right."""
    e = F.col("mean") - F.col("truth")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg((F.col("state") == F.col("true_state")).cast("double")).alias("state_accuracy"))


def ablation(forecasts: DataFrame, models: list[str]) -> DataFrame:
    """``forecasts`` has actual and one column per model; one row per model that has forecast every row."""
    long = forecasts.select("actual", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("p")) for m in models])).alias("x")).select("actual", "x.*")
    e = F.col("p") - F.col("actual")
    return long.groupBy("model").agg(F.count("*").alias("n"), F.count("p").alias("__n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae")).filter("n = __n").drop("__n")


def optimization_metrics(points: DataFrame, oracle: DataFrame) -> DataFrame:
    """``points`` has strategy, gameweek and points, ``oracle`` gameweek and points. One row per strategy; gameweeks are matched by name."""
    o = oracle.select("gameweek", F.col("points").alias("best"))
    gap = (F.col("best") - F.col("points")) / F.greatest(F.col("best").cast("double"), F.lit(1e-6))
    rows = points.join(o, "gameweek").groupBy("strategy").agg(F.count("*").alias("n"), F.sum("points").alias("total"), F.avg("points").alias("mean"), F.stddev_pop("points").alias("sd"), F.min("points").alias("worst"), F.avg(gap).alias("mean_gap"), F.sum("best").alias("best_total"))
    cv = F.when(F.col("mean") > 0, F.try_divide("sd", "mean")).otherwise(0.0)
    share = F.coalesce(F.try_divide(F.col("total") * 100.0, F.col("best_total")), F.lit(0.0))
    return rows.withColumn("cv", cv).withColumn("percent_of_best", share).drop("best_total")


def rank_shift(forecasts: DataFrame, a: str, b: str, key: str = "player_id", by: list[str] = ["gameweek"]) -> DataFrame:  # noqa: B006
    """Each row's rank by two scores and the difference; ties to the smaller key. No task needs a whole group."""
    rows = forecasts.select(*by, key, F.col(a).alias("__a"), F.col(b).alias("__b"))
    rows = ordered.ranked(ordered.ranked(rows, by, [F.desc("__a"), F.asc(key)], "rank_a"), by, [F.desc("__b"), F.asc(key)], "rank_b")
    return rows.select(*by, key, "rank_a", "rank_b", (F.col("rank_a") - F.col("rank_b")).alias("shift"))


def risk_ranking(forecasts: DataFrame, *, weight: float = 0.5, most: int = 20) -> DataFrame:
    """The ``most`` best by mean less weight times deviation, per gameweek."""
    from pyspark.sql import Window

    scored = forecasts.withColumn("adjusted", F.col("mean") - weight * F.sqrt("var"))
    place = F.row_number().over(Window.partitionBy("gameweek").orderBy(F.desc(F.round("adjusted", 9)), "player_id"))
    return scored.withColumn("rank", place.cast("long")).filter(F.col("rank") <= most)
