"""Regressions on features: ridge and lasso, boosted trees, and rolling validation."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import exact_quantiles

TARGET = "target"


def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    """A vector of the columns; what is missing, as a column or as a value, is 0."""
    from pyspark.ml.feature import VectorAssembler

    there = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in columns}
    names = {c: f"__x{i}" for i, c in enumerate(columns)}
    return VectorAssembler(inputCols=list(names.values()), outputCol="features").transform(df.withColumns({names[c]: v for c, v in there.items()})).drop(*names.values())


def fit(df: DataFrame, columns: list[str], *, kind: str = "ridge", penalty: float | None = None, target: str = TARGET):
    """A fitted model. ``penalty`` means the same as in a closed-form ridge (sum of squares) and in a mean-squared lasso."""
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    rows = assembled(df.filter(F.col(target).isNotNull()), columns)
    if kind == "boosted":
        return GBTRegressor(featuresCol="features", labelCol=target, maxIter=100, maxDepth=3, stepSize=0.1, seed=42).fit(rows)
    if kind == "lasso":
        return LinearRegression(labelCol=target, elasticNetParam=1.0, regParam=0.1 if penalty is None else penalty, standardization=False).fit(rows)
    n, sd = rows.agg(F.count("*"), F.stddev_pop(target)).first()
    weight = (1.0 if penalty is None else penalty) * (sd or 0.0) / max(n, 1)  # Spark scales the label by its deviation
    return LinearRegression(labelCol=target, elasticNetParam=0.0, regParam=weight, standardization=False, solver="normal").fit(rows)


def predict(model, df: DataFrame, columns: list[str], *, as_: str = "predicted") -> DataFrame:
    """Forecasts, not below 0."""
    return model.transform(assembled(df, columns)).withColumn(as_, F.greatest(F.lit(0.0), F.col("prediction"))).drop("features", "prediction")


def importance(model, columns: list[str]) -> list[tuple[str, float]]:
    weights = model.featureImportances if hasattr(model, "featureImportances") else model.coefficients
    return sorted(zip(columns, map(abs, weights.toArray().tolist())), key=lambda x: (-x[1], x[0]))


def rolling_ridge(folds: DataFrame, columns: list[str], *, penalty: float = 1.0, least: int = 5, target: str = TARGET) -> DataFrame:
    """Ridge on each player's folds; rows of test with the forecast. Rows with gaps are left out; folds with fewer than ``least`` training rows give none.

    A fold's training rows come down to sums of products before any Python; the small systems of a batch are solved together.
    """
    k = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    y = F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double"))
    whole = functools.reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in x])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    terms = [F.lit(1.0), *x, y, *[x[i] * x[j] for i, j in pairs], *[c * y for c in x]]
    teaches = (F.col("role") == "train") & y.isNotNull()
    sums = F.array(*[F.coalesce(F.sum(F.when(teaches, t)), F.lit(0.0)) for t in terms])
    tests = F.collect_list(F.when(F.col("role") == "test", F.struct("gameweek", F.array(*x).alias("x"), y.alias("actual"))))
    rows = folds.filter(whole).groupBy("player_id", "fold").agg(sums.alias("sums"), tests.alias("tests")).filter(F.col("sums")[0] >= least)
    rows = rows.select("player_id", "fold", "sums", F.explode("tests").alias("t")).select("player_id", "fold", "t.gameweek", "sums", "t.x", "t.actual")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            s = np.stack(pdf["sums"])
            n, mean, level = s[:, :1], s[:, 1 : k + 1] / s[:, :1], s[:, k + 1] / s[:, 0]
            gram = np.empty((len(s), k, k))
            for at, (i, j) in enumerate(pairs, k + 2):
                gram[:, i, j] = gram[:, j, i] = s[:, at] - n[:, 0] * mean[:, i] * mean[:, j]
            cross = s[:, -k:] - n * mean * level[:, None]
            beta = np.linalg.solve(gram + penalty * np.eye(k), cross[..., None])[..., 0]
            said = level + ((np.stack(pdf["x"]) - mean) * beta).sum(1)
            yield pdf[["player_id", "fold", "gameweek"]].assign(predicted=said, actual=pdf["actual"])

    return rows.mapInPandas(run, "player_id long, fold long, gameweek long, predicted double, actual double")


def fold_metrics(predictions: DataFrame) -> DataFrame:
    """rmse and mae of each fold over its rows whose outcome is known; ``predictions`` has fold, predicted and actual."""
    e = F.col("predicted") - F.col("actual")
    return predictions.filter(e.isNotNull()).groupBy("fold").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def save(model, path: str) -> None:
    """Write a fitted model to any file system that Spark knows; a model there before is replaced."""
    model.write().overwrite().save(path)


def load(path: str, *, kind: str = "ridge"):
    """A model that ``save`` wrote; ``kind`` as in ``fit``."""
    from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel

    return (GBTRegressionModel if kind == "boosted" else LinearRegressionModel).load(path)


def residual_quantiles(forecasts: DataFrame) -> DataFrame:
    """10, 50 and 90% of a forecast from the quantiles of errors by position; ``forecasts`` has position, mean and actual (null for what is to come).

    The quantiles are exact and interpolated; a position without a known error has errors of 0.
    """
    shares = [0.1, 0.5, 0.9]
    found = exact_quantiles(forecasts.select("position", (F.col("actual") - F.col("mean")).alias("e")), ["e"], shares, by=["position"])
    # a row for each position
    q = found.groupBy("position").agg(F.array_sort(F.collect_list(F.struct("share", "value"))).alias("q"))
    low = lambda i: F.greatest(F.lit(0.0), F.col("mean") + F.coalesce(F.col("q")[i]["value"], F.lit(0.0)))
    return forecasts.join(q, "position", "left").withColumns({"p10": low(0), "p50": low(1), "p90": low(2)}).drop("q")


def from_quantiles(df: DataFrame) -> DataFrame:
    """mean and downside out of quantiles."""
    return df.withColumn("mean", F.col("p50")).withColumn("downside", F.greatest(F.lit(0.0), F.col("p50") - F.col("p10")))
