"""Squads against brute force on pools small enough for it, and properties of the rules."""

import itertools
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline import fixed
from touchline.operators import squad as sq

SCHEMA = "problem string, player_id long, position string, team string, price_tenths long, score double, mean double"


def pool(seed, clubs=6, sizes=(3, 6, 6, 4)):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for p, n in zip(fixed.POSITIONS, sizes):
        for _ in range(n):
            s = float(np.round(rng.normal(4, 3), 3))
            rows.append((str(seed), i, p, f"c{rng.integers(clubs)}", int(rng.integers(40, 90)), s, s))
            i += 1
    return rows


def brute(rows, budget, cap=3):
    """The best objective over every legal squad and lineup."""
    best = None
    by = {p: [r for r in rows if r[2] == p] for p in fixed.POSITIONS}
    choices = [list(itertools.combinations(by[p], fixed.SQUAD_QUOTA[p])) for p in fixed.POSITIONS]
    ways = [(1, d, m, 10 - d - m) for d in range(3, 6) for m in range(2, 6) if 1 <= 10 - d - m <= 3]
    for squad in itertools.product(*choices):
        flat = [r for part in squad for r in part]
        if sum(r[4] for r in flat) > budget * 10 or max(Counter(r[3] for r in flat).values()) > cap:
            continue
        lines = [sorted((r[5] for r in part), reverse=True) for part in squad]
        value = max(sum(sum(x[:n]) for x, n in zip(lines, w)) for w in ways)
        best = value if best is None else max(best, value)
    return best


POOLS = {s: pool(s) for s in range(12)}
BUDGET = 92.0


@pytest.fixture(scope="module")
def pools(spark):
    return spark.createDataFrame([r for rows in POOLS.values() for r in rows], SCHEMA)


def test_exact_squads_equal_brute_force(spark, pools):
    got = sq.exact(pools, budget=BUDGET)
    chosen = got.toPandas()
    objective = chosen.groupby("problem")["objective"].first().to_dict()
    for s, rows in POOLS.items():
        assert objective.get(str(s)) == pytest.approx(brute(rows, BUDGET)) if (b := brute(rows, BUDGET)) is not None else str(s) not in objective, (s, b)
    assert chosen["exact"].all() and (chosen["bound"] >= chosen["objective"] - 1e-9).all()
    rules = sq.validate(got.join(pools, ["problem", "player_id", "position"]), budget=BUDGET).toPandas()
    assert len(rules) and rules[["quota_ok", "formation_ok", "budget_ok", "club_ok"]].all(axis=None)
    starters = chosen[chosen["role"] == "starter"].merge(pd.DataFrame([r for x in POOLS.values() for r in x], columns=["problem", "player_id", "position", "team", "price", "score", "mean"]), on=["problem", "player_id"])
    np.testing.assert_allclose(starters.groupby("problem")["score"].sum().sort_index(), pd.Series(objective).sort_index())
    captains = starters[starters["is_captain"]]
    assert (captains.set_index("problem")["mean"] == starters.groupby("problem")["mean"].max()).all()


def test_pruning_keeps_the_optimum(spark):
    rows = pool(99, clubs=14)
    many = spark.createDataFrame([(p, 100 * k + i, pos, team, price, s - 2 * k, m - 2 * k) for k in range(5) for p, i, pos, team, price, s, m in rows], SCHEMA)
    few = sq.pruned(many)
    assert few.groupBy("problem", "position", "team", "price_tenths").count().agg(F.max("count")).first()[0] == 3
    found = sq.exact(many, budget=BUDGET).select("objective", "exact").first()
    assert found["exact"] and found["objective"] == pytest.approx(sq.choose(many.toPandas(), budget=920, cap=3, most_nodes=400).objective)


@pytest.mark.parametrize("most_nodes", [1, 3])
def test_a_search_handed_on_as_a_table_ends_with_the_same_squads(spark, pools, most_nodes):
    hard = [r for seed in (0, 5, 7, 8) for r in pool(seed, clubs=6, sizes=(5, 12, 12, 8))]
    left = [len(sq.choose(pd.DataFrame([r for r in hard if r[0] == str(seed)], columns=sq.CANDIDATE), budget=800, cap=3, most_nodes=1).open) for seed in (0, 5, 7, 8)]
    assert all(left)
    df = spark.createDataFrame(hard, SCHEMA)
    got = sq.exact(df, budget=80.0, most_nodes=most_nodes)
    rules = sq.validate(got.join(df, ["problem", "player_id", "position"]), budget=80.0).toPandas()
    assert len(rules) == 4 and rules[["quota_ok", "formation_ok", "budget_ok", "club_ok"]].all(axis=None)
    best = {r["problem"]: r["objective"] for r in sq.exact(df, budget=80.0).select("problem", "objective").distinct().collect()}
    assert {r["problem"]: r["objective"] for r in got.select("problem", "objective").distinct().collect()} == pytest.approx(best) and got.filter("not exact").count() == 0


def plain_greedy(rows, budget):
    left, squad, clubs = round(budget * 10), [], Counter()
    for p in fixed.POSITIONS:
        n = 0
        for r in sorted((r for r in rows if r[2] == p), key=lambda r: (-(r[6] / max(r[4] / 10, 0.1)), r[1])):
            if n < fixed.SQUAD_QUOTA[p] and clubs[r[3]] < 3 and r[4] <= left:
                squad.append(r[1])
                left, n = left - r[4], n + 1
                clubs[r[3]] += 1
    return squad if len(squad) == 15 else None


def test_greedy_equals_a_plain_loop(spark, pools):
    got: dict = {}
    for r in sq.greedy(pools, budget=BUDGET).orderBy("problem", "pick").collect():
        got.setdefault(r["problem"], []).append(r["player_id"])
    assert got == {str(s): x for s, rows in POOLS.items() if (x := plain_greedy(rows, BUDGET))}


def test_exact_beats_greedy_and_multiplier_bounds(spark, pools):
    best = {r["problem"]: r["objective"] for r in sq.exact(pools, budget=BUDGET).select("problem", "objective").distinct().collect()}
    squads = sq.greedy(pools, budget=BUDGET).join(pools, ["problem", "player_id"])
    for r in sq.best_formation(squads).collect():
        assert best[r["problem"]] >= r["total"] - 1e-9
    trace = sq.subgradient(pools, budget=BUDGET).toPandas()
    assert (trace["multiplier"] >= 0).all() and trace["multiplier"].map(np.isfinite).all()
    feasible = trace[trace["slack"] <= 0.01].groupby("problem")["primal"].max()
    for p, v in feasible.items():
        if p in best:
            assert v <= best[p] + 1e-9


def test_price_of_money_is_the_slope_of_the_hull():
    group = pd.DataFrame(pool(3, sizes=(5, 10, 10, 7)), columns=["problem", "player_id", "position", "team", "price_tenths", "score", "mean"])
    free = group.assign(team=[f"t{i}" for i in range(len(group))])
    at = lambda b: sq.choose(free, budget=b, cap=3, most_nodes=50)
    found = at(900)
    values = {b: x.objective for b in range(780, 961, 4) if (x := at(b))}
    assert all(v <= found.bound + found.price * (b - 900) / 10 + 1e-6 for b, v in values.items())


def test_an_impossible_pool_gives_no_squad(spark):
    rows = [r for r in pool(1) if r[2] != "GK"]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sq.exact(df).count() == 0 and sq.greedy(df).count() == 0 and sq.exact(df.limit(0)).count() == 0


def test_there_are_eight_formations(spark):
    assert {r["formation"] for r in sq.formations(spark).collect()} == {"3-4-3", "3-5-2", "4-3-3", "4-4-2", "4-5-1", "5-2-3", "5-3-2", "5-4-1"}


def test_broken_rules_are_found(spark):
    rows = [("p", p, "club", 100, "starter" if i < {"GK": 1, "DEF": 4, "MID": 4, "FWD": 2}[p] else "bench") for p in fixed.POSITIONS for i in range(fixed.SQUAD_QUOTA[p])]
    r = sq.validate(spark.createDataFrame(rows, "problem string, position string, team string, price_tenths long, role string")).first()
    assert (r["quota_ok"], r["formation_ok"], r["budget_ok"], r["club_ok"], r["left_tenths"]) == (True, True, False, False, -500)


def test_other_ways_choose_legal_squads(spark):
    """The multiplier's and the greedy squads keep all rules; none beats the best one, and no bound lies below it."""
    import random

    rng = random.Random(4)
    rows = [(f"p{k}", 100 * k + i, ["GK", "DEF", "MID", "FWD"][i % 4], f"t{i % 9}", rng.randint(35, 90), float(m := round(rng.uniform(0, 9), 3)), m) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(rows, "problem string, player_id long, position string, team string, price_tenths int, score double, mean double")
    best = {r["problem"]: r["objective"] for r in sq.exact(df, budget=85.0).collect()}
    for choose in (sq.lagrangian, sq.greedy_squad):
        chosen = choose(df, budget=85.0)
        whole = chosen.join(df.select("problem", "player_id", "team", "price_tenths", "mean", "score"), ["problem", "player_id"])
        checks = sq.validate(whole, budget=85.0).collect()
        assert checks and all(r["quota_ok"] and r["formation_ok"] and r["budget_ok"] and r["club_ok"] for r in checks)
        for r in whole.filter("role = 'starter'").groupBy("problem").agg(F.sum("score").alias("s"), F.first("objective").alias("o"), F.first("bound").alias("b")).collect():
            assert abs(r["s"] - r["o"]) < 1e-6 and r["o"] <= best[r["problem"]] + 1e-6
        vice = {r["problem"]: r for r in sq.vice_captain(chosen, df).filter("is_captain or is_vice").groupBy("problem").agg(F.count("*").alias("n"), F.countDistinct("player_id").alias("d")).collect()}
        assert all((r["n"], r["d"]) == (2, 2) for r in vice.values())
