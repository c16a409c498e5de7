import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import enriched as en
from touchline.operators import features as ft
from touchline.operators import forecast, metrics, regressors
from touchline.plans.series import weekly
from touchline.plans.squads import TIGHT, walk_forward


@pytest.fixture(scope="module")
def weeks(spark, small):
    return weekly(spark, small).checkpoint()


def test_features_equal_pandas(weeks):
    got = ft.features(weeks).toPandas().sort_values(["player_id", "gameweek"])
    made = [c for c in got.columns if c not in weeks.columns]
    assert len(made) == 72 and set(made) == set(ft.feature_names())
    for _, g in list(got.groupby("player_id"))[:4]:
        p = g["points"].reset_index(drop=True)
        slope = lambda s: np.polyfit(np.arange(len(s)), s, 1)[0]
        expected = {
            "points_rolling_5_mean": p.rolling(5, min_periods=1).mean(), "points_rolling_3_std": p.rolling(3, min_periods=1).std(), "points_lag_2": p.shift(2), "points_diff_1": p.diff(), "points_ewma_30": p.ewm(alpha=0.3, adjust=False).mean(),
            "points_trend_5": p.rolling(5, min_periods=2).apply(slope), "points_consistency_5": p.rolling(5, min_periods=1).std() / (p.rolling(5, min_periods=1).mean() + 1e-6),
        }
        for name, x in expected.items():
            np.testing.assert_allclose(g[name].astype(float), x, atol=1e-9, err_msg=name)


def test_names_of_ewma_cut_the_percentage():
    assert ft.ewma_name("points", 0.29) == "points_ewma_28" and ft.ewma_name("points", 0.3) == "points_ewma_30"


def test_features_share_one_exchange(weeks):
    plan = weeks.select("*", *[c.alias(n) for n, c in (ft.rolling(["points"]) | ft.lags(["points"]) | ft.consistency(["points"])).items()])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_folds_equal_a_plain_split(spark):
    n, train, test, step = 23, 7, 3, 4
    df = spark.createDataFrame([(1, i) for i in range(n)], "player_id long, gameweek long")
    got: dict = {}
    for r in ft.folds(df, train=train, test=test, step=step).collect():
        got.setdefault(r["fold"], {"train": set(), "test": set()})[r["role"]].add(r["gameweek"])
    starts = range(0, n - train - test + 1, step)
    assert got == {k: {"train": set(range(s, s + train)), "test": set(range(s + train, s + train + test))} for k, s in enumerate(starts)}
    assert ft.folds(df.filter("gameweek < 9"), train=train, test=test, step=step).count() == 0


def test_forecasts_know_nothing_of_their_own_or_later_gameweeks(weeks):
    cut = 12
    spoilt = weeks.withColumns({c: F.when(F.col("gameweek") >= cut, F.lit(99)).otherwise(F.col(c)).cast(weeks.schema[c].dataType) for c in ("points", "minutes", "goals", "bonus")})
    for make in (lambda d: en.enriched(d).select("player_id", "gameweek", "enr_mean", "enr_var", "enr_down"), lambda d: forecast.one_step(forecast.series(d)).drop("y"), lambda d: d.select("player_id", "gameweek", ft.rolling_baseline().alias("a"), ft.ewma_baseline().alias("b"))):
        a, b = (sorted(tuple(r) for r in make(d).filter(F.col("gameweek") <= cut).collect()) for d in (weeks, spoilt))
        assert a == b and a


def test_fitted_models_know_nothing_of_their_own_or_later_gameweeks(weeks):
    """Every column but keys and price is spoilt from a gameweek on, and xG alone for a player who had none before."""
    from touchline.operators import learned

    cut, keys = 9, {"player_id", "gameweek", "position", "team", "price_tenths"}
    some = weeks.filter("player_id % 4 = 0 and gameweek <= 12").withColumns({c: F.when((F.col("gameweek") < 9) & (F.col("player_id") % 8 == 0), F.lit(0.0)).otherwise(F.col(c)).cast(weeks.schema[c].dataType) for c in ("xG", "xA")})
    numeric = [f.name for f in weeks.schema.fields if f.name not in keys and f.dataType.typeName() in ("integer", "long", "double")]
    spoilt = some.withColumns({c: F.when(F.col("gameweek") >= cut, F.lit(7)).otherwise(F.col(c)).cast(weeks.schema[c].dataType) for c in numeric})
    a, b = (sorted(map(str, learned.windows(d).filter(F.col("gameweek") <= cut).collect())) for d in (some, spoilt))
    assert a == b and a
    a, b = (sorted((r["player_id"], r["gameweek"], round(r["mv_mean"], 9), round(r["weight"], 9)) for r in learned.learn_positions(learned.windows(d)).filter(F.col("gameweek") == cut).collect()) for d in (some, spoilt))
    assert a == b and a


def test_a_player_without_minutes_scores_nothing(spark):
    df = spark.createDataFrame([(1, g, "MID", 0, 0.0, 0.0, 0, 1) for g in range(1, 8)] + [(2, g, "GK", 90, 4.0, 0.0, 1, 2) for g in range(1, 8)], "player_id long, gameweek long, position string, minutes long, points double, xG double, was_home long, opponent_team long")
    got = {(r["player_id"], r["gameweek"]): r for r in en.enriched(df).collect()}
    assert (got[1, 7]["enr_mean"], got[1, 7]["enr_var"]) == (0.0, 4.0) and got[2, 1]["enr_mean"] == 0.0
    assert got[2, 7]["enr_mean"] == pytest.approx(2.0) and got[2, 7]["enr_var"] == pytest.approx(1.0) and got[2, 7]["enr_down"] == pytest.approx(0.5)


def test_metrics_of_a_perfect_forecast(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0), (3.0, 4.0, 3.0)], "mean double, var double, actual double")
    r = metrics.inference_metrics(df).first()
    assert (r["n"], r["mse"], r["bias"], r["coverage_95"], r["mean_sd"]) == (2, 0.0, 0.0, 1.0, 1.5)


def test_ridge_has_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=60)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(target=y))
    model = regressors.fit(df, list("abc"), penalty=3.0)
    xc = x - x.mean(0)
    np.testing.assert_allclose(model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + 3 * np.eye(3), xc.T @ (y - y.mean())), atol=1e-8)
    said = regressors.predict(model, df.drop("c"), list("abc"))
    assert said.filter("predicted < 0").count() == 0 and [n for n, _ in regressors.importance(model, list("abc"))][0] == "b"


def test_weights_of_an_ensemble_are_checked():
    with pytest.raises(ValueError):
        forecast.weighted({"a": 0.7, "b": 0.7})
    with pytest.raises(ValueError):
        forecast.weighted({"a": 1.5, "b": -0.5})


def test_walk_forward(spark, small):
    rows = weekly(spark, "/root/testdata/sf0.01").filter("gameweek <= 9")
    got, best = walk_forward(rows, strategies=[("rolling", "rolling", None, 0.0), ("semivar", "enr_mean", "enr_down", 0.5)], budget=TIGHT)
    top = {r["gameweek"]: r["points"] for r in best.collect()}
    points = got.collect()
    assert {r["strategy"] for r in points} == {"rolling", "semivar"} and all(r["points"] <= top[r["gameweek"]] for r in points)
    assert set(top) == {7, 8, 9} or set(top) <= {6, 7, 8, 9}


def test_rolling_ridge_equals_a_plain_solution(weeks, tmp_path):
    names = ["minutes", "xG", "bonus"]
    gaps = weeks.withColumn("target", F.lead("points").over(ft.in_order()).cast("double")).withColumn("xG", F.when(F.col("gameweek") % 7 != 0, F.col("xG")))
    folds = ft.folds(gaps, train=8, test=2, step=3)
    got = {(r["player_id"], r["fold"], r["gameweek"]): r for r in regressors.rolling_ridge(folds, names).collect()}
    expected = {}
    for (player, fold), g in folds.toPandas().dropna(subset=names).groupby(["player_id", "fold"]):
        train, test = g[(g["role"] == "train") & g["target"].notna()], g[g["role"] == "test"]
        if len(train) < 5:
            continue
        x, y = train[names].to_numpy(float), train["target"].to_numpy(float)
        wide = np.vstack([x - x.mean(0), np.eye(3)])
        beta = np.linalg.lstsq(wide, np.append(y - y.mean(), np.zeros(3)), rcond=None)[0]
        for r in test.itertuples():
            expected[player, fold, r.gameweek] = ((np.array([r.minutes, r.xG, r.bonus], float) - x.mean(0)) @ beta + y.mean(), None if pd.isna(r.target) else r.target)
    assert got.keys() == expected.keys() and got
    for key, (said, actual) in expected.items():
        assert got[key]["predicted"] == pytest.approx(said, abs=1e-6) and got[key]["actual"] == actual


def test_models_come_back_from_disk(weeks, tmp_path):
    rows = weeks.withColumn("target", F.lead("points").over(ft.in_order()).cast("double"))
    for kind in ("ridge", "boosted"):
        model = regressors.fit(rows.limit(40), ["minutes", "xG"], kind=kind)
        for _ in range(2):
            regressors.save(model, str(tmp_path / kind))
        again = regressors.load(str(tmp_path / kind), kind=kind)
        said = [sorted(tuple(r) for r in regressors.predict(m, rows, ["minutes", "xG"]).select("player_id", "gameweek", "predicted").collect()) for m in (model, again)]
        assert said[0] == said[1] and said[0]
