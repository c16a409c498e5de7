"""Exact order statistics and ranks without a task that holds a whole group, and values as of a time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

#: Parts that a range of values is cut into in each pass, and sought values that one search takes.
BUCKETS, MOST_TARGETS = 1024, 10_000


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], *, by: list[str] | None = None) -> DataFrame:
    """by..., column, share, value: exact interpolated quantiles of each column over the rows of each group whose value is known.

    Each pass counts the values within the range that still holds a sought one by parts of it, and the range shrinks to the smallest and
    largest value of the part where the count passes the sought rank, until they are equal. A pass sums ``BUCKETS`` counts
    for each sought value before the shuffle, so neither many distinct values nor large groups meet in one task. Groups are few (``MOST_TARGETS``
    sought values); a group without values has none. NaN counts as unknown.
    """
    by = by or []
    known = lambda c: F.col(c).cast("double").isNotNull() & ~F.isnan(F.col(c).cast("double"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(known(c), F.col(c).cast("double")).alias("v")) for c in columns]))
    long = df.select(*by, cells.alias("x")).select(*by, "x.*").filter("v is not null")
    groups = long.groupBy(*by, "column").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    spark = df.sparkSession
    sought: dict[tuple, dict] = {}
    for g in groups:
        key = tuple(g[c] for c in by) + (g["column"],)
        for p in shares:
            for k in {math.floor(p * (g["n"] - 1)), math.ceil(p * (g["n"] - 1))}:
                sought[(*key, k)] = {"lo": g["lo"], "hi": g["hi"], "before": 0}
    if len(sought) > MOST_TARGETS:
        raise ValueError(f"{len(sought)} sought values; group by less than {MOST_TARGETS} of them")
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = ", ".join(f"`{c}` {types[c]}" for c in by) + (", " if by else "")
    at = F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BUCKETS))
    while open_ := [(k, x) for k, x in sought.items() if x["lo"] < x["hi"]]:
        ranges = spark.createDataFrame([(*k, x["lo"], x["hi"]) for k, x in open_], f"{keys}column string, k long, lo double, hi double")
        # the ranges have a bound that was checked above
        on = [long[c].eqNullSafe(ranges[c]) for c in [*by, "column"]]
        inside = long.join(F.broadcast(ranges), [*on, F.col("v").between(F.col("lo"), F.col("hi"))]).select(*[ranges[c] for c in [*by, "column"]], "k", "v", at.alias("b"))
        counted: dict[tuple, list] = {}
        for r in inside.groupBy(*by, "column", "k", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
            counted.setdefault(tuple(r[c] for c in [*by, "column", "k"]), []).append((r["b"], r["n"], r["lo"], r["hi"]))
        for key, x in open_:
            for _, n, lo, hi in sorted(counted[key]):
                if x["before"] + n > key[-1]:
                    x["lo"], x["hi"] = lo, hi
                    break
                x["before"] += n
    rows = []
    for g in groups:
        key = tuple(g[c] for c in by) + (g["column"],)
        for p in shares:
            place = p * (g["n"] - 1)
            low, high = sought[(*key, math.floor(place))]["lo"], sought[(*key, math.ceil(place))]["lo"]
            rows.append((*key, float(p), low + (high - low) * (place - math.floor(place))))
    return spark.createDataFrame(rows, f"{keys}column string, share double, value double")


def ranked(df: DataFrame, by: list[str], order: list[Column], as_: str) -> DataFrame:
    """``df`` with the rank (from 1) of each row within ``by`` by ``order``, as ``row_number`` gives it.

    Rows are sorted over ranges of (by, order); a row's rank is its place in its range and the number of its group's rows in the
    ranges before, so a group is spread over as many tasks as it fills. The ranges are written before they are counted,
    as they are drawn from a sample and a rerun might draw others.
    """
    part, ahead = f"__{as_}_part", f"__{as_}_ahead"
    dealt = written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], *order).withColumn(part, F.spark_partition_id()))
    sums = dealt.groupBy(*by, part).agg(F.count("*").alias("__n"))
    # one row for each range that a group reaches into
    before = sums.select(*by, part, (F.sum("__n").over(Window.partitionBy(*by).orderBy(part)) - F.col("__n")).alias(ahead))
    placed = dealt.withColumn(as_, F.row_number().over(Window.partitionBy(*by, part).orderBy(*order)).cast("long"))
    left, right = placed.alias("l"), before.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, part]]
    return left.join(right, on).select(*[F.col(f"l.{c}") for c in df.columns], (F.col(f"l.{as_}") + F.col(f"r.{ahead}")).alias(as_))


def as_of(rows: DataFrame, told: DataFrame, *, key: str, at: str, told_at: str, values: list[str], ties: list[str] | None = None, same_time: bool = True, max_age: float | None = None) -> DataFrame:
    """``rows`` with the ``values`` of the last row of ``told`` with the same ``key`` at or before (without ``same_time``: before) their own
    time, null without one or where it is more than ``max_age`` older; and ``told_at`` of that row.

    Two clocks are brought together in one order per key and the last value is carried forward: one shuffle, no join of all pairs.
    Of values told at the same time that with the largest ``ties`` holds. Rows with a null key or time get nulls; rows that repeat stay.
    """
    packed = F.struct(F.col(told_at).alias(told_at), *values)
    heard = told.filter(F.col(key).isNotNull() & F.col(told_at).isNotNull()).select(F.col(key).alias("__key"), F.col(told_at).alias("__at"), F.lit(0 if same_time else 1).alias("__side"), (F.struct(*ties) if ties else F.struct(F.lit(0).alias("none"))).alias("__tie"), packed.alias("__told"), F.lit(None).cast(rows.schema).alias("__row"))
    asked = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1 if same_time else 0).alias("__side"), F.lit(None).cast(heard.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(heard.schema["__told"].dataType).alias("__told"), F.struct(*rows.columns).alias("__row"))
    clock = Window.partitionBy("__key").orderBy(F.col("__at").asc_nulls_first(), "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = heard.unionByName(asked).withColumn("__last", F.last("__told", ignorenulls=True).over(clock)).filter("__row is not null")
    fresh = F.col(f"__last.{told_at}").isNotNull() & F.col("__at").isNotNull()
    if max_age is not None:
        fresh = fresh & (F.col("__at") - F.col(f"__last.{told_at}") <= max_age)
    return both.select("__row.*", *[F.when(fresh, F.col(f"__last.{c}")).alias(c) for c in [told_at, *values]])
