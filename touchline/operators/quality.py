"""Checks of a table and repairs of its gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gameweek import in_order
from .ordered import exact_quantiles


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def _gap(df: DataFrame, c: str):
    null = F.col(c).isNull()
    return null | F.isnan(c) if dict(df.dtypes)[c] in ("double", "float") else null


def quality_report(df: DataFrame, *, most_missing: float = 50.0) -> DataFrame:
    """One row per column: rows, missing values, their share in percent, and whether it exceeds ``most_missing``. One pass over the data."""
    counts = df.agg(F.count("*").alias("rows"), *[F.count_if(_gap(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])
    out = counts.select("rows", F.explode(pairs).alias("x")).select("x.column", "rows", "x.missing")
    share = F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0))
    return out.withColumn("percent", share).withColumn("too_many", F.col("percent") > most_missing)


def missing_percent(df: DataFrame) -> DataFrame:
    """One row: share of all cells that are missing, in percent."""
    return quality_report(df).agg(F.coalesce(F.try_divide(F.sum("missing") * 100.0, F.sum("rows")), F.lit(0.0)).alias("percent"))


def impute(df: DataFrame, columns: list[str], method: str = "mean") -> DataFrame:
    """Fill gaps by ``mean``, ``median`` (exact, interpolated), ``zero`` or ``forward_fill`` along a player's gameweeks; what is unknown counts as mean.

    A column without any value stays null under mean and median.
    """
    df = df.withColumns({c: F.when(~_gap(df, c), F.col(c).cast("double")) for c in columns})
    if method == "forward_fill":
        return df.withColumns({c: F.last(c, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)) for c in columns})
    if method == "zero":
        return df.fillna(0.0, columns)
    if method == "median":
        found = {r["column"]: r["value"] for r in exact_quantiles(df, columns, [0.5]).collect()}
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(found.get(c)).cast("double")) for c in columns})
    fills = df.agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    # the fills are one row by construction, whatever the size of the table
    return df.crossJoin(F.broadcast(fills)).withColumns({c: F.coalesce(c, f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])
