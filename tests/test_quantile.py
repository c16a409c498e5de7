"""Windows against plain slices, quantile regressions against their optimality and coverage after the cutoff."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import enriched as en
from touchline.operators import quantile as qt
from touchline.plans import catalog
from touchline.plans.series import weekly

from .oracle import check


def test_windows_equal_their_sql(spark):
    check(catalog.queries()["quantile_windows"], catalog.oracle_sql()["quantile_windows"], spark, "/root/testdata/sf0.01")


@pytest.mark.parametrize("encoder, horizon", [(3, 1), (4, 2)])
def test_windows_equal_plain_slices(spark, encoder, horizon):
    rng = random.Random(encoder)
    rows = [(g, t, "MID", "1", 3.0, float(t % 2), rng.random(), rng.random() if t % 5 else None, 0.0, float(rng.randint(0, 9)) if t != 9 else None) for g, n in (("a", 10), ("b", 4), ("c", 3)) for t in range(1, n + 1)]
    panel = spark.createDataFrame(rows, "group_id string, time_idx int, position string, team string, fixture_difficulty double, is_home double, xPts double, mins_frac double, news_sentiment double, actual_points double")
    got = {(r["group_id"], r["time_idx"]): r for r in qt.windows(panel, encoder=encoder, horizon=horizon).collect()}
    want = {}
    for g in "abc":
        own = [r for r in rows if r[0] == g]
        for i in range(encoder, len(own) - horizon + 1):
            want[g, own[i][1]] = ([r[9] for r in own[i - encoder : i]], [r[7] for r in own[i - encoder : i]], [r[9] for r in own[i : i + horizon]], [r[5] for r in own[i : i + horizon]])
    assert {k: (r["enc_actual_points"], r["enc_mins_frac"], r["target"], r["dec_is_home"]) for k, r in got.items()} == want


def rows_of(spark, n=3_000, seed=1):
    """Outcomes whose spread grows with one feature, over 20 gameweeks."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = np.zeros(len(qt.FEATURES))
        x[0], x[1], x[4] = 1.0, rng.uniform(0, 5), rng.uniform(0, 3)
        out.append((int(1 + i % 20), x.tolist(), float(4 + x[1] + x[4] * rng.normal())))
    return spark.createDataFrame(out, "time_idx int, x array<double>, y double"), out


def test_coefficients_minimise_the_pinball_loss(spark):
    df, rows = rows_of(spark)
    beta = qt.fit(df, [10, 20], rounds=60)
    for c in (10, 20):
        x, y = np.array([r[1] for r in rows if r[0] <= c]), np.array([r[2] for r in rows if r[0] <= c])
        for share, b in zip(qt.SHARES, beta[c]):
            loss = lambda v: (lambda e: (e * (share - (e < 0))).mean())(y - x @ v)  # noqa: B023, E731
            base = loss(b)
            for j in (0, 1, 4):
                for step in (-0.05, 0.05):
                    other = b.copy()
                    other[j] += step
                    assert loss(other) >= base - 2e-4
            assert abs((y <= x @ b).mean() - share) < 0.01
    assert abs(beta[20][1][1] - 1) < 0.15 and beta[20][2][4] > 0.8 > -0.8 > beta[20][0][4]


def test_models_know_nothing_after_their_cutoff(spark):
    df, _ = rows_of(spark, 1_000)
    spoilt = df.withColumn("y", F.when(F.col("time_idx") > 10, 1e6).otherwise(F.col("y")))
    a, b = qt.fit(df, [10], rounds=8), qt.fit(spoilt, [10], rounds=8)
    np.testing.assert_array_equal(a[10], b[10])
    said = qt.predict(df, {10: a[10], 15: a[10]})
    assert {(r["time_idx"] > 15, r["cutoff"]) for r in said.select("time_idx", "cutoff").distinct().collect()} == {(False, 10), (True, 15)} and said.agg(F.min("time_idx")).first()[0] == 11


def test_coverage_of_held_out_gameweeks(spark):
    said = qt.forecast(en.panel(weekly(spark, "/root/testdata/sf0.01")), encoder=15, every=5)
    assert said.filter("p10 > p50 or p50 > p90 or p10 < 0 or time_idx <= cutoff").count() == 0
    r = qt.coverage(said).first()
    # points are whole numbers, so the share lies between those below and at most
    for c, share in zip(("p10", "p50", "p90"), qt.SHARES):
        assert r[f"under_{c}"] - 0.05 <= share <= r[f"below_{c}"] + 0.05
    flat = said.withColumns({c: F.lit(v) for c, v in zip(("p10", "p50", "p90"), (2.0, 8.0, 20.0))})
    assert r["n"] > 500 and r["loss"] <= qt.coverage(flat).first()["loss"]


def test_empty_panel(spark):
    panel = en.panel(weekly(spark, "/root/testdata/sf0.001")).limit(0)
    assert qt.windows(panel).count() == 0 and qt.forecast(panel).count() == 0
