"""Two estimates of one quantity made one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fuse(mean_a: Column, var_a: Column, mean_b: Column, var_b: Column, floor: float = 1e-6) -> Column:
    """By inverse variance; variances are at least ``floor``."""
    va, vb = F.greatest(var_a, F.lit(floor)), F.greatest(var_b, F.lit(floor))
    return F.struct(((mean_a / va + mean_b / vb) / (1 / va + 1 / vb)).alias("mean"), (1 / (1 / va + 1 / vb)).alias("var"))


def blend(weight: Column, mean_a: Column, var_a: Column, mean_b: Column, var_b: Column) -> Column:
    """By a given weight of the first."""
    return F.struct((weight * mean_a + (1 - weight) * mean_b).alias("mean"), (weight * weight * var_a + (1 - weight) * (1 - weight) * var_b).alias("var"))


def scale_by_fixtures(mean: Column, var: Column, downside: Column, n: Column, *, independent: bool = True) -> Column:
    """A forecast for one fixture made one for ``n`` of them; none gives (0, 0.1, 0)."""
    times = n if independent else n * n
    return F.struct(F.when(n == 0, 0.0).otherwise(mean * n).alias("mean"), F.when(n == 0, 0.1).otherwise(var * times).alias("var"), F.when(n == 0, 0.0).otherwise(downside * F.sqrt(n.cast("double"))).alias("downside"))
