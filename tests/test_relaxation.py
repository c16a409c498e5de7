"""The relaxation and its prices: the certificate of duality, and plain search over mixes on small pools."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline import fixed
from touchline.operators import relaxation as rx
from touchline.operators import squad as sq
from touchline.plans import squads

from .test_squad import BUDGET, SCHEMA, brute, pool


def frame(rows):
    return pd.DataFrame(rows, columns=sq.CANDIDATE)


def proven(r, p, budget, cap=3):
    """Checks every constraint of both programs on one problem, from their definitions."""
    s, x, lam, mu = r.member, r.start, r.money, r.clubs
    assert (s >= -1e-9).all() and (s <= 1 + 1e-7).all() and (x >= -1e-9).all() and (x <= s + 1e-7).all()
    assert s.sum() == pytest.approx(15) and x.sum() == pytest.approx(11) and p.price @ s <= budget + 1e-5
    dual = lam * budget + cap * mu.sum() + 11 * r.lineup
    for k in range(4):
        own = p.rows(k)
        assert s[own].sum() == pytest.approx(rx.QUOTA[k]) and rx.LEAST[k] - 1e-7 <= x[own].sum() <= rx.MOST[k] + 1e-7
        dual += rx.QUOTA[k] * r.quota[k] - rx.LEAST[k] * r.least[k] + rx.MOST[k] * r.most[k]
    for c in range(len(p.clubs)):
        assert s[p.club == c].sum() <= cap + 1e-6
    assert lam >= 0 and (mu >= 0).all() and (r.least >= 0).all() and (r.most >= 0).all()
    start_price = r.lineup + r.most - r.least
    coupling = np.maximum(0, p.score - start_price[p.place])
    own_place = np.maximum(0, coupling - lam * p.price - mu[p.club] - r.quota[p.place])
    dual += own_place.sum()
    assert dual == pytest.approx(r.objective, abs=1e-5)


@pytest.mark.parametrize("seed", range(30))
@pytest.mark.parametrize("clubs, budget", [(5, 880), (6, 920), (14, 800), (3, 1100)])
def test_strong_duality_on_random_pools(seed, clubs, budget):
    group = frame(pool(seed, clubs=clubs, sizes=(4, 9, 9, 6)))
    r = rx.solve(rx.Pool.of(group), budget=budget, cap=3)
    if r is None:
        assert sq.choose(group, budget=budget, cap=3, most_nodes=500) is None
        return
    proven(r, rx.Pool.of(group), budget)
    whole = sq.choose(group, budget=budget, cap=3, most_nodes=5_000)
    assert not whole.open and whole.objective <= r.objective + 1e-6


def test_the_bound_lies_above_plain_search_and_is_reached_without_limits():
    for seed in range(8):
        rows = pool(seed)
        best, r = brute(rows, BUDGET), rx.solve(rx.Pool.of(frame(rows)), budget=920, cap=3)
        assert r is None if best is None and r is None else best is None or r.objective >= best - 1e-7
        free = rx.solve(rx.Pool.of(frame(rows)), budget=10_000, cap=15)
        assert free.objective == pytest.approx(brute(rows, 1000.0, cap=15)) and free.money == 0 and not free.clubs.any()


def test_prices_are_what_a_larger_limit_brings():
    group = frame(pool(5, clubs=5, sizes=(5, 12, 12, 8)))
    at = lambda b: rx.solve(rx.Pool.of(group), budget=b, cap=3)
    r = at(820)
    assert r.money > 0
    for b in range(780, 861, 5):
        assert (o := at(b)) is None or o.objective <= r.objective + r.money * (b - 820) + 1e-6


def test_ties_and_equal_players():
    rows = [("t", i, p, f"c{i % 4}", 50, 1.0, 1.0) for i, p in enumerate(p for p in fixed.POSITIONS for _ in range(8))]
    r = rx.solve(rx.Pool.of(frame(rows)), budget=750, cap=4)
    proven(r, rx.Pool.of(frame(rows)), 750, cap=4)
    assert r.objective == pytest.approx(11)
    assert rx.solve(rx.Pool.of(frame(rows)), budget=749, cap=4) is None and rx.solve(rx.Pool.of(frame(rows)), budget=750, cap=3) is None


@pytest.fixture(scope="module")
def pools(spark):
    rows = [r for s in range(6) for r in pool(s, clubs=7, sizes=(5, 12, 12, 8))]
    return spark.createDataFrame(rows, SCHEMA)


def test_constraints_of_all_problems(spark, pools):
    solved = rx.levels(sq.problems(pools), budget=85.0).cache()
    prices = rx.player_prices(pools, solved)
    every = rx.constraints(solved, prices, budget=85.0)
    n = every.groupBy("problem").count().collect()
    # budget, sizes of squad and lineup, 4 quotas, 8 limits of the lineup, 7 clubs at most, and one for each player
    assert n and all(3 + 4 + 8 + 37 + 4 <= r["count"] <= 3 + 4 + 8 + 37 + 7 for r in n)
    assert every.filter("slack < 0 or (abs(dual) > 1e-6 and not binding)").count() == 0
    assert every.filter("constraint = 'budget' and binding and dual > 0").count() > 0 and every.filter("constraint like 'coupling%' and dual > 0").count() > 0
    for r in rx.certificate(solved, prices, budget=85.0).collect():
        assert r["objective"] == pytest.approx(r["dual_objective"], abs=1e-5) and r["violation"] < 1e-5 and r["complementarity"] < 1e-5


def test_pruned_players_are_priced_too(spark, pools):
    many = pools.unionByName(pools.withColumn("player_id", F.col("player_id") + 1000).withColumn("score", F.col("score") - 5))
    solved = rx.levels(sq.problems(many), budget=85.0)
    prices = rx.player_prices(many, solved)
    assert prices.count() == many.join(solved.select("problem").distinct(), "problem").count()
    assert all(r["violation"] < 1e-5 and r["objective"] == pytest.approx(r["dual_objective"], abs=1e-5) for r in rx.certificate(solved, prices, budget=85.0).collect())


def test_empty_and_impossible_problems(spark, pools):
    none = rx.levels(sq.problems(pools.limit(0)))
    assert none.count() == 0 and rx.player_prices(pools.limit(0), none).count() == 0
    assert rx.levels(sq.problems(pools), budget=10.0).count() == 0 and rx.levels(sq.problems(pools.filter("position != 'GK'"))).count() == 0


def test_registered_queries(spark, small):
    found = squads.lp_certificate(spark, "/root/testdata/sf0.01").collect()
    assert len(found) > 5
    for r in found:
        assert r["objective"] == pytest.approx(r["dual_objective"], abs=1e-4) and r["violation"] < 1e-5 and r["complementarity"] < 1e-5
        assert r["whole"] <= r["objective"] + 1e-6 and 0 <= r["gap"] < 0.2 and r["n_binding"] > 10
    duals = squads.lp_duals(spark, "/root/testdata/sf0.01")
    assert duals.columns == rx.CONSTRAINTS and duals.filter("constraint = 'budget' and dual > 0").count() > 0
