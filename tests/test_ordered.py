"""Exact quantiles, ranks over ranges, values as of a time and the likeliest states, against plain computation."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import hmm
from touchline.operators import ordered, quality
from touchline.plans import catalog

from .oracle import check


@pytest.mark.parametrize("name", ["rank_shift", "impute_median", "quantile_forecast", "hmm_viterbi", "news_as_of"])
def test_queries_equal_their_sql(spark, name):
    check(catalog.queries()[name], catalog.oracle_sql()[name], spark, "/root/testdata/sf0.01")


def test_exact_quantiles_by_group(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 8)  # many passes
    rng = random.Random(1)
    rows = [(g, rng.choice([1e300, -1e300, 0.0, 1e-300, 5.0, 5.0, rng.uniform(-3, 3)]), rng.randint(0, 4), i) for g, n in (("a", 200), ("b", 1), (None, 40)) for i in range(n)]
    rows += [("c", None, 1, 0), ("a", float("nan"), None, 0), ("a", None, None, 0)]
    df = spark.createDataFrame(rows, "g string, x double, y int, id int")
    got = {(r["g"], r["column"], r["share"]): r["value"] for r in ordered.exact_quantiles(df, ["x", "y"], [0.0, 0.25, 0.5, 0.9, 1.0], by=["g"]).collect()}
    for g in ("a", "b", "c", None):
        for c, at in (("x", 1), ("y", 2)):
            own = [float(r[at]) for r in rows if r[0] == g and r[at] is not None and not math.isnan(r[at])]
            for p in (0.0, 0.25, 0.5, 0.9, 1.0):
                if own:
                    low, high = sorted(own)[math.floor(p * (len(own) - 1))], sorted(own)[math.ceil(p * (len(own) - 1))]
                    assert got[g, c, p] == low + (high - low) * (p * (len(own) - 1) - math.floor(p * (len(own) - 1)))
                else:
                    assert (g, c, p) not in got
    assert ordered.exact_quantiles(df.limit(0), ["x"], [0.5]).count() == 0


def test_median_of_many_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(1.0, None)] * 500 + [(2.0, None)] * 499 + [(None, None)], "a double, b double")
    out = quality.impute(df, ["a", "b"], "median")
    assert out.filter("a = 1.0").count() == 501 and out.filter("b is not null").count() == 0


def test_ranks_equal_row_number_and_no_task_has_a_whole_group(spark):
    rows = [(i % 2 if i % 11 else None, float((i * 7919) % 50) if i % 13 else None, i) for i in range(6_000)]
    df = spark.createDataFrame(rows, "g int, score double, id int").repartition(5)
    got = ordered.ranked(df, ["g"], [F.desc("score"), F.asc("id")], "rank")
    from pyspark.sql import Window

    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), F.asc("id"))).cast("long"))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    plan = got._jdf.queryExecution().analyzed().toString()
    windows = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*)", plan)
    assert windows and all("__rank_part" in w for w in windows)
    dealt = df.repartitionByRange(8, F.asc_nulls_first("g"), F.desc("score"), F.asc("id")).groupBy(F.spark_partition_id(), "g").count().groupBy("g").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()
    assert all(2 * r["most"] <= r["n"] for r in dealt if r["n"] > 2_000)
    assert ordered.ranked(df.limit(0), ["g"], [F.desc("score")], "rank").count() == 0


@pytest.mark.parametrize("same_time", [True, False])
@pytest.mark.parametrize("max_age", [None, 3])
def test_values_as_of_a_time(spark, same_time, max_age):
    rng = random.Random(3)
    told = [(rng.choice(["a", "b", "c", None]), rng.choice([*range(20), None]), i, rng.choice(["x", "y", None])) for i in range(60)]
    rows = [(rng.choice(["a", "b", "d", None]), rng.choice([*range(20), None])) for _ in range(60)] + [("a", 5)] * 3
    got = ordered.as_of(spark.createDataFrame(rows, "k string, t int"), spark.createDataFrame(told, "k string, at int, n int, v string"), key="k", at="t", told_at="at", values=["v"], ties=["n"], same_time=same_time, max_age=max_age)
    want = []
    for k, t in rows:
        fit = [x for x in told if x[0] is not None and x[0] == k and t is not None and x[1] is not None and (x[1] <= t if same_time else x[1] < t)]
        last = max(fit, key=lambda x: (x[1], x[2]), default=None)
        want.append((k, t, last[1], last[3]) if last and (max_age is None or t - last[1] <= max_age) else (k, t, None, None))
    order = lambda xs: sorted(map(str, xs))
    assert got.columns == ["k", "t", "at", "v"] and order(tuple(r) for r in got.collect()) == order(want)


def test_as_of_takes_one_shuffle_by_key(spark):
    rows, told = spark.range(100).selectExpr("id % 7 as k", "id as t"), spark.range(100).selectExpr("id % 7 as k", "id as at", "id as v")
    plan = ordered.as_of(rows, told, key="k", at="t", told_at="at", values=["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_viterbi_equals_all_paths(spark):
    rng = random.Random(2)
    series = [[float(rng.randint(0, 15)) for _ in range(n)] for n in (1, 2, 3, 5, 6)] + [[2.0] * 5, [400.0, 0.0, -300.0], []]
    df = spark.createDataFrame([(i, y) for i, y in enumerate(series)], "i int, y array<double>")
    got = {r["i"]: r["p"] for r in df.select("i", hmm.viterbi(F.col("y")).alias("p")).collect()}
    move, emit, first = hmm.DEFAULT
    log = lambda p: math.log(p + hmm.LEAST)
    dens = lambda y, j: max(-0.5 * ((y - emit[j][0]) / emit[j][1]) ** 2 - math.log(emit[j][1] * math.sqrt(2 * math.pi)), math.log(hmm.LEAST))
    for i, y in enumerate(series):
        if not y:
            assert got[i] == []
            continue
        value = lambda path: log(first[path[0]]) + dens(y[0], path[0]) + sum(log(move[a][b]) + dens(v, b) for a, b, v in zip(path, path[1:], y[1:]))
        best = max(value(p) for p in itertools.product(range(5), repeat=len(y)))
        assert len(got[i]) == len(y) and value(got[i]) == pytest.approx(best, abs=1e-9)
    from touchline.operators.learned import learn_scalar

    long = spark.createDataFrame([(i, [float(x) for x in np.random.default_rng(i).integers(0, 12, 30)]) for i in range(20)], "player_id long, y array<double>")
    both = long.join(learn_scalar(long, fit=False).select("player_id", "path"), "player_id").select("path", hmm.viterbi(F.col("y")).alias("p"))
    assert both.filter("path != p").count() == 0
