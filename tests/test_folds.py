"""Filters and state models against plain loops written from their definitions."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchline import fixed
from touchline.functions import arrays, fusion, hmm
from touchline.operators import forecast, learned

RNG = np.random.default_rng(42)
SERIES = {1: [5.0], 2: [4.0, 5.0, 4.0, 3.0, 4.5], 3: list(np.round(RNG.gamma(2, 2, 38), 1)), 4: [0.0] * 6}
A, PI = np.array(fixed.TRANSITION), np.array(fixed.INITIAL)
MU, SD = np.array(fixed.EMISSIONS).T


def normal(y):
    return np.exp(-0.5 * ((y - MU) / SD) ** 2) / (SD * math.sqrt(2 * math.pi))


def boost_at(player, t):
    return [10.0, 2.0, 1.0, 1.0, 1.0] if player == 3 and t % 5 == 3 else None


def stepped(player, t):
    b = boost_at(player, t)
    if b is None:
        return A
    x = A * np.array(b)
    return x / x.sum(1, keepdims=True)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(p, t, float(y), boost_at(p, t), 5.0 if t % 4 == 2 else None, 1.5 if t % 3 == 1 else None) for p, ys in SERIES.items() for t, y in enumerate(ys)]
    df = spark.createDataFrame(rows, "player_id long, gameweek long, points double, boost array<double>, q double, r double")
    out = forecast.smoothed(forecast.series(df))
    return {r["player_id"]: r.asDict(recursive=True) for r in out.collect()}, out


def test_filter_and_smoother(runs):
    for p, ys in SERIES.items():
        x, v, means, variances, ahead = fixed.FIRST_MEAN, fixed.FIRST_VARIANCE, [], [], []
        for t, y in enumerate(ys):
            v = v if t == 0 else v + fixed.PROCESS_NOISE * (5.0 if t % 4 == 2 else 1.0)
            ahead.append((x, v))
            k = v / (v + fixed.OBSERVATION_NOISE * (1.5 if t % 3 == 1 else 1.0))
            x, v = x + k * (y - x), (1 - k) * v
            means.append(x)
            variances.append(v)
        got = runs[0][p]
        np.testing.assert_allclose([s["mean"] for s in got["kf"]], means, rtol=1e-12)
        np.testing.assert_allclose([s["var"] for s in got["kf"]], variances, rtol=1e-12)
        sm, sv = means[:], variances[:]
        for t in range(len(ys) - 2, -1, -1):
            g = variances[t] / ahead[t + 1][1]
            sm[t] = means[t] + g * (sm[t + 1] - ahead[t + 1][0])
            sv[t] = variances[t] + g**2 * (sv[t + 1] - ahead[t + 1][1])
        np.testing.assert_allclose([s["mean"] for s in got["kf_smooth"]], sm, rtol=1e-12)
        np.testing.assert_allclose([s["var"] for s in got["kf_smooth"]], sv, rtol=1e-12)


def test_forward_and_smoothed_beliefs(runs):
    for p, ys in SERIES.items():
        alpha = []
        for t, y in enumerate(ys):
            raw = (PI if t == 0 else alpha[-1] @ stepped(p, t)) * normal(y)
            alpha.append(raw / raw.sum())
        got = runs[0][p]
        np.testing.assert_allclose([s["belief"] for s in got["hm"]], alpha, atol=1e-12)
        beta = [np.ones(5)]
        for t in range(len(ys) - 2, -1, -1):
            beta.insert(0, stepped(p, t + 1) @ (normal(ys[t + 1]) * beta[0]))
        gamma = np.array(alpha) * np.array(beta)
        gamma /= gamma.sum(1, keepdims=True)
        np.testing.assert_allclose(got["hm_smooth"], gamma, atol=1e-10)
        np.testing.assert_allclose(np.sum(got["hm_smooth"], 1), 1)


def test_bad_news_raise_the_injured_state(spark):
    obs = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(None).cast("array<double>").alias("boost")) for y in (6.0, 5.0, 7.0)])
    boost = F.array(*map(F.lit, fixed.STATE_BOOST["unavailable"]))
    row = spark.range(1).select(hmm.predict(hmm.forward(obs)).alias("a"), hmm.predict(hmm.forward(obs), boost).alias("b")).first()
    assert row["b"]["mean"] < row["a"]["mean"] and row["a"]["var"] > 0


def test_viterbi_is_the_best_of_all_paths(spark):
    ys = [4.0, 0.0, 9.0, 2.0, 6.5]
    best = max(itertools.product(range(5), repeat=len(ys)), key=lambda s: math.log(PI[s[0]]) + sum(math.log(normal(y)[i]) for y, i in zip(ys, s)) + sum(math.log(A[i, j] + 1e-300) for i, j in zip(s, s[1:])))
    got = learned.learn_scalar(spark.createDataFrame([(1, ys)], "player_id long, y array<double>"), fit=False).first()
    assert tuple(got["path"]) == best


def plain_em(ys, iterations, weight=None, means=MU[:, None], variances=(SD**2)[:, None], relative=False):
    """Baum-Welch by loops over steps and states, for one series (T, D)."""
    x = np.array(ys, float).reshape(len(ys), -1)
    pi, a, mu, var = PI.copy(), A.copy(), np.array(means, float), np.array(variances, float)
    a0, mu0, var0 = a.copy(), mu.copy(), var.copy()
    last, n = -np.inf, len(x)

    def emission(t):
        log = np.array([-0.5 * np.sum(np.log(2 * np.pi * np.maximum(var[s], 1e-8)) + (x[t] - mu[s]) ** 2 / np.maximum(var[s], 1e-8)) for s in range(5)])
        return np.exp(log - log.max()) if relative else np.exp(log)

    for _ in range(iterations):
        b = [emission(t) for t in range(n)]
        alpha, scale = np.zeros((n, 5)), np.zeros(n)
        for t in range(n):
            raw = (pi if t == 0 else alpha[t - 1] @ a) * b[t]
            scale[t] = raw.sum()
            alpha[t] = raw / scale[t] if scale[t] > 0 else raw
        beta = np.ones((n, 5))
        for t in range(n - 2, -1, -1):
            beta[t] = a @ (b[t + 1] * beta[t + 1]) / (scale[t + 1] if scale[t + 1] > 0 else 1)
        gamma = alpha * beta
        gamma = gamma / gamma.sum(1, keepdims=True)
        xi = np.zeros((n - 1, 5, 5))
        for t in range(n - 1):
            for i in range(5):
                for j in range(5):
                    xi[t, i, j] = alpha[t, i] * a[i, j] * b[t + 1][j] * beta[t + 1, j]
            xi[t] /= xi[t].sum()
        w = weight or 0.0
        pi = gamma[0] if weight is None else np.maximum(gamma[0], 1e-10) / np.maximum(gamma[0], 1e-10).sum()
        for i in range(5):
            d = gamma[:-1, i].sum()
            if d > (0 if weight is None else 1e-10):
                a[i] = w * a0[i] + (1 - w) * xi[:, i].sum(0) / d
            a[i] = a[i] / a[i].sum()
        for s in range(5):
            g = gamma[:, s]
            if g.sum() > 1e-10:
                m = (g[:, None] * x).sum(0) / g.sum()
                v = (g[:, None] * (x - m) ** 2).sum(0) / g.sum()
                mu[s] = w * mu0[s] + (1 - w) * m
                var[s] = np.maximum(w * var0[s] + (1 - w) * v, 0.01 if weight is None else 1e-4)
        now = np.log(scale + 1e-300).sum()
        if abs(now - last) < 1e-4:
            break
        last = now
    return pi, a, mu, var


@pytest.mark.parametrize("iterations", [1, 4, 20])
def test_em_equals_plain_loops(iterations):
    ys = np.array([SERIES[3][:20], SERIES[3][15:35]])
    got = learned.scalar_models(2).fit(ys[:, :, None], iterations)
    for k in range(2):
        pi, a, mu, var = plain_em(ys[k], iterations)
        np.testing.assert_allclose(got.start[k], pi, atol=1e-8)
        np.testing.assert_allclose(got.move[k], a, atol=1e-7)
        np.testing.assert_allclose(got.mean[k], mu, rtol=1e-6, atol=1e-7)
        np.testing.assert_allclose(got.var[k], var, rtol=1e-6, atol=1e-7)
    assert not np.allclose(got.mean, MU[None, :, None])


def test_position_models_keep_to_their_prior():
    x = np.stack([np.array(SERIES[3][:12]), np.clip(np.array(SERIES[3][:12]) / 8, 0, 1)], 1)[None]
    got = learned.position_models(["MID"]).fit(x, 15)
    prior = learned.position_models(["MID"])
    pi, a, mu, var = plain_em(x[0], 15, 0.85, prior.mean[0], prior.var[0], relative=True)
    np.testing.assert_allclose(got.mean[0], mu, atol=1e-8)
    np.testing.assert_allclose(got.var[0], var, atol=1e-8)
    np.testing.assert_allclose(got.move[0], a, atol=1e-8)
    np.testing.assert_allclose(got.start[0], pi, atol=1e-8)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 20), min_size=0, max_size=12), st.sampled_from([0.1, 0.3, 0.57, 1.0]))
def test_ewma(spark, values, alpha):
    row = spark.createDataFrame([(values,)], "v array<double>").select(arrays.ewma(F.col("v"), alpha).alias("last"), arrays.running_ewma(F.col("v"), alpha).alias("all")).first()
    y, out = None, []
    for v in values:
        y = v if y is None else alpha * v + (1 - alpha) * y
        out.append(y)
    assert row["all"] == pytest.approx(out) and row["last"] == pytest.approx(out[-1] if out else 0.0)


def test_fusion_lies_between_and_is_surer(spark):
    row = spark.range(1).select(fusion.fuse(F.lit(2.0), F.lit(4.0), F.lit(6.0), F.lit(1.0)).alias("f"), fusion.scale_by_fixtures(F.lit(4.0), F.lit(2.0), F.lit(1.0), F.lit(2)).alias("d"), fusion.scale_by_fixtures(F.lit(4.0), F.lit(2.0), F.lit(1.0), F.lit(0)).alias("b")).first()
    assert row["f"]["mean"] == pytest.approx(5.2) and row["f"]["var"] == pytest.approx(0.8)
    assert tuple(row["d"]) == pytest.approx((8.0, 4.0, math.sqrt(2))) and tuple(row["b"]) == (0.0, 0.1, 0.0)


def test_alpha_is_the_best_of_the_grid(runs):
    ahead = forecast.one_step(runs[1].select("player_id", "obs", "kf", "hm"))
    got = {r["player_id"]: r["alpha"] for r in forecast.fusion_weights(ahead).collect()}
    rows = sorted((r for r in ahead.collect() if r["player_id"] == 3), key=lambda r: r["t"])[8:]
    grid = [0.5 + 0.05 * i for i in range(11)]
    errors = [np.mean([(a * r["kf_mean"] + (1 - a) * r["hmm_mean"] - r["y"]) ** 2 for r in rows]) for a in grid]
    assert got[3] == pytest.approx(grid[int(np.argmin(errors))]) and got[2] == 0.8 and all(0 <= a <= 1 for a in got.values())
