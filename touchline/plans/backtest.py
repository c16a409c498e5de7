"""The walk-forward backtest as a run that can break off and go on.

Results stand in a table by gameweek. A run computes the gameweeks that the table lacks, some at a time, and each of its writes replaces
whole gameweeks, so a run that breaks off halfway and starts again ends with the same table as one that never broke off.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import fixed
from touchline.operators import gameweek as gk
from touchline.operators import metrics
from touchline.operators.lineage import written

from .inference import forecasts
from .squads import OTHERS, STRATEGIES, walk_forward

SCHEMA = "strategy string, points long, exact boolean, gameweek long"


def results(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows so far (strategy, points, exact, gameweek; the best in hindsight as strategy ``oracle``); none where nothing was written."""
    try:
        return spark.read.schema(SCHEMA).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def wanted(rows: DataFrame, *, least_history: int = 5, least_players: int = 50) -> DataFrame:
    return gk.valid_players(rows, least_history=least_history, least_players=least_players).select(F.col("gameweek").cast("long").alias("gameweek")).distinct()


def run(rows: DataFrame, path: str, *, strategies: list[tuple] = STRATEGIES, others: tuple[tuple, ...] = OTHERS, quantiles: dict | None = None, budget: float = fixed.BUDGET, least_history: int = 5, least_players: int = 50, at_a_time: int = 8, again: list[int] | None = None) -> DataFrame:
    """Complete the table at ``path`` and give its rows. ``again`` are gameweeks to compute anew.

    ``at_a_time`` gameweeks are written together. Forecasts are computed once a run, over all rows; those of a gameweek see what came before it alone, so
    more rows don't change what a finished gameweek holds.
    """
    spark = rows.sparkSession
    done = results(spark, path).select("gameweek").distinct()
    if again:
        done = done.filter(~F.col("gameweek").isin([int(g) for g in again]))
    limits = dict(least_history=least_history, least_players=least_players)
    # a season has 38 gameweeks
    open_ = sorted(r["gameweek"] for r in wanted(rows, **limits).join(done, "gameweek", "left_anti").collect())
    said = written(forecasts(rows)) if open_ else None
    for i in range(0, len(open_), at_a_time):
        some = open_[i : i + at_a_time]
        got, best = walk_forward(rows, strategies=strategies, others=others, quantiles=quantiles, budget=budget, said=said, gameweeks=some, **limits)
        both = got.unionByName(best.withColumn("strategy", F.lit("oracle"))).select("strategy", F.col("points").cast("long").alias("points"), "exact", F.col("gameweek").cast("long").alias("gameweek"))
        # a gameweek without any squad is marked, so that it isn't open for ever
        none = spark.createDataFrame([(g,) for g in some], "gameweek long").join(both.select("gameweek").distinct(), "gameweek", "left_anti").select(F.lit("none").alias("strategy"), F.lit(None).cast("long").alias("points"), F.lit(None).cast("boolean").alias("exact"), "gameweek")
        written(both.unionByName(none)).repartition("gameweek").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gameweek").parquet(path)
    return results(spark, path)


def summary(found: DataFrame) -> DataFrame:
    """One row per strategy over a table of ``run``: its points and gaps to the best squads in hindsight."""
    rows = found.filter("points is not null")
    return metrics.optimization_metrics(rows.filter("strategy != 'oracle'").select("strategy", "gameweek", "points"), rows.filter("strategy = 'oracle'").select("gameweek", "points"))
