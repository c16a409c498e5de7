"""The resumable backtest, the planner's steps, and lineups in a requested formation."""

import pytest
from pyspark.sql import functions as F

from touchline import fixed
from touchline.api import SquadPlanner
from touchline.operators import squad as sq
from touchline.plans import backtest, catalog, squads
from touchline.plans.series import weekly
from touchline.sources.readers import Config

from .oracle import check

FEW = [("enr", "enr_mean", "enr_var", 0.5), ("rolling", "rolling", None, 0.0)]
HOW = {"strategies": FEW, "others": (), "budget": 72.0, "at_a_time": 2}


@pytest.fixture(scope="module")
def rows(spark):
    return weekly(spark, "/root/testdata/sf0.01").filter("gameweek <= 10").checkpoint()


@pytest.mark.parametrize("name", ["greedy_squad", "greedy_summary", "valid_formations"])
def test_queries_equal_their_sql(spark, name):
    check(catalog.queries()[name], catalog.oracle_sql()[name], spark, "/root/testdata/sf0.01")


def told(df):
    return sorted(map(str, df.select("gameweek", "strategy", "points", "exact").collect()))


def test_a_run_that_broke_off_ends_with_the_same_table(spark, rows, tmp_path, monkeypatch):
    whole = told(backtest.run(rows, str(tmp_path / "whole"), **HOW))
    assert len({r.split("strategy")[0] for r in whole}) == 5 and backtest.results(spark, str(tmp_path / "nothing")).count() == 0
    real, calls = backtest.walk_forward, []

    def breaks(*a, **k):
        calls.append(k["gameweeks"])
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(backtest, "walk_forward", breaks)
    path = str(tmp_path / "broken")
    with pytest.raises(RuntimeError):
        backtest.run(rows, path, **HOW)
    half = told(backtest.results(spark, path))
    assert 0 < len(half) < len(whole) and set(half) < set(whole)
    assert told(backtest.run(rows, path, **HOW)) == whole and calls == [[6, 7], [8, 9], [8, 9], [10]]
    assert told(backtest.run(rows, path, **HOW)) == whole and len(calls) == 4
    assert told(backtest.run(rows, path, again=[7], **HOW)) == whole and calls[4:] == [[7]]
    got = backtest.summary(backtest.results(spark, path)).collect()
    assert {r["strategy"] for r in got} == {"enr", "rolling"} and all(r["n"] == 5 and r["mean_gap"] >= 0 for r in got)


def test_planner_fits_saves_and_hears_news(spark, rows, tmp_path):
    plan = SquadPlanner(rows, Config({"budget": 72.0}))
    said = plan.fit(str(tmp_path / "model"), columns=["minutes", "xG", "bonus"])
    again = plan.forecast(SquadPlanner.fitted(str(tmp_path / "model"), columns=["minutes", "xG", "bonus"]))
    a, b = ({r["player_id"]: r["mean"] for r in x.collect()} for x in (said, again))
    assert a == pytest.approx(b) and len(a) == rows.select("player_id").distinct().count()
    assert again.filter("var != 4.0 or abs(downside - sqrt(2.0)) > 1e-9").count() == 0
    news = spark.createDataFrame([(7, 1, "Fit again"), (7, 2, "Ruled out for 3 weeks"), (8, 1, "Ruled out for 3 weeks"), (8, 2, "Back in training")], "player_id long, gameweek int, news_text string")
    heard = {r["player_id"]: r["mean"] for r in plan.forecast(SquadPlanner.with_news(news)).collect()}
    plain = {r["player_id"]: r["mean"] for r in plan.forecast("blended").collect()}
    assert heard[7] < plain[7] or plain[7] == 0
    assert {k: v for k, v in heard.items() if k not in (7, 8)} == pytest.approx({k: v for k, v in plain.items() if k not in (7, 8)})


def test_requested_formation_or_the_best_one(spark):
    def squad_of(name, sizes):
        return [(name, 100 * k + i, p, float(10 * k + i)) for k, (p, n) in enumerate(zip(fixed.POSITIONS, sizes)) for i in range(n)]

    df = spark.createDataFrame(squad_of("full", (2, 5, 5, 3)) + squad_of("short", (1, 5, 5, 1)), "problem string, player_id long, position string, mean double")
    got = sq.requested_lineup(df, formation="3-4-3", by="mean")
    shape = {r["problem"]: (r["formation"], r["d"], r["m"], r["f"]) for r in got.filter("role = 'starter'").groupBy("problem", "formation").agg(*[F.count_if(F.col("position") == p).alias(c) for p, c in zip(fixed.POSITIONS[1:], "dmf")]).collect()}
    assert shape["full"] == ("3-4-3", 3, 4, 3) and shape["short"][0] in ("5-4-1", "4-5-1") and shape["short"][3] == 1
    assert got.filter("is_captain").count() == 2
    plain, want = sq.requested_lineup(df.filter("problem = 'full'")), sq.lineup(df.filter("problem = 'full'"))
    assert plain.select(want.columns).exceptAll(want).count() == 0


def test_keyed_defaults_of_spread(spark):
    base = spark.createDataFrame([(1, 3.0), (2, 4.0), (3, 5.0)], "player_id long, mean double")
    var, down = spark.createDataFrame([(1, 8.0), (9, 1.0)], "player_id long, var double"), spark.createDataFrame([(1, 0.5), (2, None)], "player_id long, downside double")
    got = {r["player_id"]: (r["var"], r["downside"]) for r in sq.with_spread(base, var, down).collect()}
    assert got == {1: (8.0, 0.5), 2: (4.0, pytest.approx(2**0.5)), 3: (4.0, pytest.approx(2**0.5))}


def test_formations_that_can_be_filled(spark):
    df = spark.createDataFrame([("a", p) for p, n in zip(fixed.POSITIONS, (1, 3, 5, 2)) for _ in range(n)] + [("b", "DEF")], "problem string, position string")
    assert {(r["problem"], r["formation"]) for r in sq.fillable(df).collect()} == {("a", "3-5-2")}
    assert squads.STRATEGIES and sq.fillable(df.limit(0)).count() == 0
