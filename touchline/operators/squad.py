"""Squads of fifteen and lineups of eleven under budget, quotas and club limits.

A problem is a group of candidates: problem, player_id, position, team, price_tenths, score (what the lineup maximises) and
mean. All problems are solved at once. Of candidates alike in problem, position, club and price at most three can be chosen
(the club limit), and the best three by score serve any solution as well as others would; a ranked window keeps those, so
a problem's size is bounded by clubs, positions and prices, however many players there are.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import fixed

from . import relaxation
from .lineage import written
from .relaxation import Pool

CANDIDATE = ["problem", "player_id", "position", "team", "price_tenths", "score", "mean"]
OUT = "problem string, player_id long, position string, role string, is_captain boolean, formation string, objective double, bound double, budget_price double, exact boolean"


def place_of(position: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.POSITIONS)), position)


def formations(spark: SparkSession) -> DataFrame:
    """Every way to line up ten players in the field: d, m, f and the name."""
    d, m, f = (spark.range(fixed.LINEUP_LEAST[p], fixed.LINEUP_MOST[p] + 1).toDF(c) for p, c in zip(fixed.POSITIONS[1:], "dmf"))
    # three ranges of at most four numbers each
    return d.crossJoin(m).crossJoin(f).filter("d + m + f = 10").withColumn("formation", F.concat_ws("-", "d", "m", "f"))


def validate(squads: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP) -> DataFrame:
    """``squads`` has problem, position, team, price_tenths and role (starter or bench). One row per problem, and which rules hold."""
    clubs = squads.groupBy("problem", "team").agg(F.count("*").alias("n")).groupBy("problem").agg(F.max("n").alias("most_of_club"))
    has = lambda p, *more: F.count_if((F.col("position") == p) & (more[0] if more else F.lit(True)))
    starts = F.col("role") == "starter"
    rows = squads.groupBy("problem").agg(
        F.count("*").alias("n"), F.count_if(starts).alias("n_lineup"), F.sum("price_tenths").cast("long").alias("cost_tenths"),
        *[has(p).alias(f"n_{p.lower()}") for p in fixed.POSITIONS], *[has(p, starts).alias(f"l_{p.lower()}") for p in fixed.POSITIONS],
    ).join(clubs, "problem")
    quota, lines = F.lit(True), F.lit(True)
    for p in fixed.POSITIONS:
        quota &= F.col(f"n_{p.lower()}") == fixed.SQUAD_QUOTA[p]
        lines &= F.col(f"l_{p.lower()}").between(fixed.LINEUP_LEAST[p], fixed.LINEUP_MOST[p])
    tenths = round(budget * 10)
    return rows.select(
        "problem", (quota & (F.col("n") == fixed.SQUAD_SIZE)).alias("quota_ok"), (lines & (F.col("n_lineup") == fixed.LINEUP_SIZE)).alias("formation_ok"), (F.col("cost_tenths") <= tenths).alias("budget_ok"), (F.col("most_of_club") <= cap).alias("club_ok"), (tenths - F.col("cost_tenths")).alias("left_tenths"),
    )


def ranked(candidates: DataFrame, by: str = "score") -> DataFrame:
    """Adds rank within problem and position, ties to the smaller id."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("problem", "position").orderBy(F.desc(by), "player_id")))


def pruned(candidates: DataFrame, by: str = "score", keep: int = fixed.CLUB_CAP) -> DataFrame:
    alike = Window.partitionBy("problem", "position", "team", "price_tenths").orderBy(F.desc(by), "player_id")
    return candidates.withColumn("__r", F.row_number().over(alike)).filter(F.col("__r") <= keep).drop("__r")


def best_formation(squad: DataFrame, by: str = "score") -> DataFrame:
    """``squad`` has problem, player_id, position and the score; gives each problem's best lineup: formation and total (ties to the first name)."""
    spark = squad.sparkSession
    top = ranked(squad, by).filter(F.col("rank") <= 5)
    sums = top.withColumn("sum", F.sum(by).over(Window.partitionBy("problem", "position").orderBy("rank")))
    line = lambda p, n: F.max(F.when((F.col("position") == p) & (F.col("rank") == n), F.col("sum")))
    # eight formations for each row of a squad
    ways = sums.crossJoin(F.broadcast(formations(spark))).groupBy("problem", "formation").agg(line("GK", F.lit(1)).alias("g"), line("DEF", F.col("d")).alias("dd"), line("MID", F.col("m")).alias("mm"), line("FWD", F.col("f")).alias("ff"))
    whole = ways.withColumn("total", F.col("g") + F.col("dd") + F.col("mm") + F.col("ff")).filter("total is not null")
    first = F.struct((-F.round("total", 9)).alias("t"), "formation")
    return whole.groupBy("problem").agg(F.min_by("formation", first).alias("formation"), F.max("total").alias("total"))


def greedy(candidates: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP) -> DataFrame:
    """Squads by falling mean per price, position after position; problem, player_id and pick (from 1). Problems without a full squad give none.

    The choice is a fold over a problem's pruned candidates in order.
    """
    value = F.col("mean") / F.greatest(F.col("price_tenths") / 10, F.lit(0.1))
    few = pruned(candidates.withColumn("value", value), "value")
    order = F.struct(place_of(F.col("position")).alias("place"), (-F.col("value")).alias("v"), F.col("player_id").alias("id"), F.col("team").cast("string").alias("team"), "price_tenths")
    one = few.groupBy("problem").agg(F.array_sort(F.collect_list(order)).alias("c"))
    quotas = F.array(*[F.lit(fixed.SQUAD_QUOTA[p]) for p in fixed.POSITIONS])
    start = F.struct(F.lit(round(budget * 10)).cast("long").alias("left"), F.array().cast("array<struct<id:bigint,place:bigint,team:string>>").alias("picked"))

    def step(acc: Column, x: Column) -> Column:
        count = lambda f: F.size(F.filter(acc["picked"], f))
        fits = (count(lambda y: y["place"] == x["place"]) < F.element_at(quotas, x["place"].cast("int"))) & (count(lambda y: y["team"] == x["team"]) < cap) & (x["price_tenths"] <= acc["left"])
        taken = F.struct((acc["left"] - x["price_tenths"]).cast("long").alias("left"), F.concat(acc["picked"], F.array(F.struct(x["id"].cast("long").alias("id"), x["place"].cast("long").alias("place"), x["team"].alias("team")))).alias("picked"))
        return F.when(fits, taken).otherwise(acc)

    done = one.select("problem", F.aggregate("c", start, step)["picked"].alias("picked")).filter(F.size("picked") == fixed.SQUAD_SIZE)
    return done.select("problem", F.posexplode("picked").alias("pick", "x")).select("problem", F.col("x.id").alias("player_id"), (F.col("pick") + 1).cast("long").alias("pick"))


def fillable(candidates: DataFrame) -> DataFrame:
    """problem and formation: those that each problem's candidates suffice for."""
    counts = candidates.groupBy("problem").agg(*[F.count_if(F.col("position") == p).alias(f"n_{p}") for p in fixed.POSITIONS])
    d, m, f = (F.col(c) for c in "dmf")
    ways = F.broadcast(formations(candidates.sparkSession))  # eight rows
    return counts.filter("n_GK >= 1").join(ways, (d <= F.col("n_DEF")) & (m <= F.col("n_MID")) & (f <= F.col("n_FWD"))).select("problem", "formation")


def requested_lineup(squads: DataFrame, *, formation: str = "4-4-2", by: str = "mean") -> DataFrame:
    """Roles as ``lineup`` gives them in the ``formation``; squads that can't fill it line up in their best one. Adds formation."""
    fits = fillable(squads).filter(F.col("formation") == formation)
    other = best_formation(squads.join(fits, "problem", "left_anti"), by).select("problem", "formation")
    ways = fits.unionByName(other)
    lines = F.split("formation", "-")
    need = F.when(F.col("position") == "GK", 1)
    for i, p in enumerate(fixed.POSITIONS[1:]):
        need = need.when(F.col("position") == p, lines[i].cast("int"))
    out = ranked(squads, by).join(ways, "problem").withColumn("role", F.when(F.col("rank") <= need, "starter").otherwise("bench"))
    best = F.row_number().over(Window.partitionBy("problem", "role").orderBy(F.desc(by), "player_id"))
    return out.withColumn("is_captain", (F.col("role") == "starter") & (best == 1)).drop("rank")


def with_spread(forecasts: DataFrame, variances: DataFrame | None = None, downsides: DataFrame | None = None, *, keys: list[str] = ["player_id"], var: float = 4.0) -> DataFrame:  # noqa: B006
    """``forecasts`` with var and downside joined by ``keys`` (from columns of those names); a player without a variance has ``var``, one without a downside
    the root of half its variance."""
    out = forecasts.drop("var", "downside")
    for name, of in (("var", variances), ("downside", downsides)):
        out = out.withColumn(name, F.lit(None).cast("double")) if of is None else out.join(of.select(*keys, F.col(name).cast("double").alias(name)).dropDuplicates(keys), keys, "left")
    out = out.withColumn("var", F.coalesce("var", F.lit(var)))
    return out.withColumn("downside", F.coalesce("downside", F.sqrt(F.greatest(F.lit(0.0), F.col("var")) / 2)))


def lineup(squads: DataFrame, *, formation: str = "4-4-2", by: str = "mean") -> DataFrame:
    """Roles in given squads (problem, player_id, position and the score): starters by rank in a fixed formation, the captain the best of them."""
    d, m, f = map(int, formation.split("-"))
    need = dict(zip(fixed.POSITIONS, (1, d, m, f)))
    most = F.lit(0)
    for p, n in need.items():
        most = F.when(F.col("position") == p, F.lit(n)).otherwise(most)
    out = ranked(squads, by).withColumn("role", F.when(F.col("rank") <= most, "starter").otherwise("bench"))
    best = F.row_number().over(Window.partitionBy("problem", "role").orderBy(F.desc(by), "player_id"))
    return out.withColumn("is_captain", (F.col("role") == "starter") & (best == 1)).drop("rank")


# -- exact choice ------------------------------------------------------------------------------------------------------


def _one_position(price: np.ndarray, score: np.ndarray, toll: np.ndarray, quota: int, most: int, forced: np.ndarray, budget: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """best[l, b, c]: the largest score of l starters and b others that cost c together, less everyone's toll; and each player's part in it."""
    best = np.full((most + 1, quota + 1, budget + 1), -np.inf)
    best[0, 0, 0] = 0.0
    parts = []
    for p, s, t, must in zip(price, score, toll, forced):
        new = np.full_like(best, -np.inf) if must else best.copy()
        part = np.zeros(best.shape, np.int8)
        if p <= budget:
            for kind, from_, gain in ((2, best[:, :-1, : budget + 1 - p], -t), (1, best[:-1, :, : budget + 1 - p], s - t)):
                to = (slice(None), slice(1, None), slice(p, None)) if kind == 2 else (slice(1, None), slice(None), slice(p, None))
                better = from_ + gain > new[to]
                new[to] = np.where(better, from_ + gain, new[to])
                part[to][better] = kind
        parts.append(part)
        best = new
    return best, parts


def _join(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest sums by cost of two, and what the first of them costs."""
    out, at = np.full(len(a), -np.inf), np.zeros(len(a), int)
    for c in np.flatnonzero(a > -np.inf):
        sums = a[c] + b[: len(b) - c]
        better = sums > out[c:]
        out[c:][better], at[c:][better] = sums[better], c
    return out, at


def _within(pool: Pool, keep: np.ndarray, forced: np.ndarray, budget: int, toll: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
    """The best squad within the budget, without club limits but with a toll for each player: value, starters, others. Of the players that
    ``keep`` tells, and with all of the ``forced`` ones."""
    tables, found = [], None
    for k, p in enumerate(fixed.POSITIONS):
        own = np.flatnonzero((pool.place == k) & keep)
        best, parts = _one_position(pool.price[own], pool.score[own], toll[own], fixed.SQUAD_QUOTA[p] - fixed.LINEUP_LEAST[p], fixed.LINEUP_MOST[p], forced[own], budget)
        tables.append((own, best, parts))
    row = lambda k, n: tables[k][1][n, fixed.SQUAD_QUOTA[fixed.POSITIONS[k]] - n]
    ends = {f: _join(row(0, 1), row(3, f)) for f in {w[3] for w in relaxation.WAYS}}
    for _, d, m, f in relaxation.WAYS:
        middle, at_d = _join(row(1, d), row(2, m))
        whole, at_mid = _join(middle, ends[f][0])
        c = int(np.argmax(whole))
        if whole[c] > -np.inf and (found is None or whole[c] > found[0] + 1e-9):
            cm = int(at_mid[c])
            ce = c - cm
            found = (float(whole[c]), [(1, int(ends[f][1][ce])), (d, int(at_d[cm])), (m, cm - int(at_d[cm])), (f, ce - int(ends[f][1][ce]))])
    if found is None:
        return None
    starters, others = [], []
    for (own, _, parts), quota, (n, c) in zip(tables, relaxation.QUOTA, found[1]):
        b = quota - n
        for i in range(len(own) - 1, -1, -1):
            kind = parts[i][n, b, c]
            if kind:
                (starters if kind == 1 else others).append(own[i])
                n, b, c = n - (kind == 1), b - (kind == 2), c - int(pool.price[own[i]])
    return found[0], np.array(starters, int), np.array(others, int)


EVEN = 1e-9
Node = tuple[frozenset, frozenset]  # ids that must be in the squad, ids that must not


@dataclass
class Found:
    """A search's best squad (none if ``objective`` is not above the floor it began with) and the nodes that it left."""

    objective: float
    starters: list[int]
    others: list[int]
    formation: str
    bound: float
    price: float
    open: list[Node]


def _search(pool: Pool, nodes: list[Node], floor: float, *, tolls: np.ndarray, budget: int, cap: int, most_nodes: int) -> tuple[float, tuple | None, list[Node]]:
    """Best first over which players of a club that exceeds its limit stay. A node's bound is the lesser of the best squad without club
    limits and the one that pays the clubs' ``tolls`` and gets them back for a full club."""
    best, heap, n = None, [], 0
    toll, back = tolls[pool.club], cap * float(tolls.sum())
    free = np.zeros(len(pool.ids))
    clubs_of = lambda squad: np.bincount(pool.club[squad], minlength=len(pool.clubs))

    def visit(forced: frozenset, banned: frozenset) -> None:
        nonlocal best, floor, n
        n += 1
        must = np.isin(pool.ids, list(forced))
        if must.sum() < len(forced):
            return  # a forced player can be in no better squad
        keep, bound = ~np.isin(pool.ids, list(banned)), np.inf
        if back > 0:
            found = _within(pool, keep, must, budget, toll)
            if found is None:
                return
            bound = found[0] + back
            value = float(pool.score[found[1]].sum())
            if value > floor + EVEN and clubs_of(np.concatenate(found[1:])).max() <= cap:
                best, floor = found[1:], value
            if bound <= floor + EVEN:
                return
        found = _within(pool, keep, must, budget, free)
        if found is None or found[0] <= floor + EVEN:
            return
        squad = np.concatenate(found[1:])
        count = clubs_of(squad)
        if count.max() <= cap:
            best, floor = found[1:], found[0]
            return
        over = sorted(pool.ids[squad[pool.club[squad] == int(np.argmax(count > cap))]].tolist())
        heapq.heappush(heap, (-min(bound, found[0]), n, forced, banned, over))

    for node in nodes:
        visit(*node)
    n = 0  # only the nodes below those given count, so every round gets on
    while heap and (n < most_nodes or -heap[0][0] <= floor + EVEN):
        bound, _, forced, banned, over = heapq.heappop(heap)
        if -bound <= floor + EVEN:
            return floor, best, []
        over = [x for x in over if x in forced] + [x for x in over if x not in forced]
        club = set(pool.ids[pool.club == pool.club[pool.ids == over[0]][0]].tolist())
        for i in range(cap):
            if over[i] not in forced:
                visit(forced | set(over[:i]), banned | {over[i]})
        visit(forced | set(over[:cap]), banned | (club - set(over[:cap])))
    return floor, best, [(x[2], x[3]) for x in heap if -x[0] > floor + EVEN]


def choose(group: pd.DataFrame, *, budget: int, cap: int, most_nodes: int, nodes: list[Node] | None = None, floor: float = -np.inf) -> Found | None:
    """The best squad of one problem, or of some ``nodes`` of its search, if better than ``floor``. ``budget`` in tenths.

    The relaxation comes first: its club prices bound the nodes, and a player whose place would cost the bound more than a first good
    squad leaves over can be in no better one, so few players are left. None if no squad is legal.
    """
    pool = Pool.of(group)
    relaxed = relaxation.solve(pool, budget=budget, cap=cap)
    if relaxed is None:
        return None
    short = np.maximum(0.0, -relaxed.worth(pool))
    how = dict(tolls=relaxed.clubs, budget=budget, cap=cap, most_nodes=most_nodes)
    best = None
    whole = lambda part, x: x and (part.ids[x[0]], part.ids[x[1]])
    if nodes is None:
        likely = np.zeros(len(pool.ids), bool)
        for k, quota in enumerate(relaxation.QUOTA):
            own = pool.rows(k)
            likely[own[np.argsort(short[own], kind="stable")[: 3 * quota]]] = True
        few = pool.only(likely)
        floor, found, _ = _search(few, [(frozenset(), frozenset())], floor, **how)
        best = whole(few, found)
    few = pool.only(relaxed.objective - short >= floor - 1e-7)
    known = set(few.ids.tolist())
    begin = [(f, b & known) for f, b in nodes or [(frozenset(), frozenset())]]
    floor, found, left = _search(few, begin, floor, **how)
    best = whole(few, found) or best
    starters, others = (x.tolist() for x in best) if best else ([], [])
    lines = Counter(pool.place[np.isin(pool.ids, starters)].tolist())
    return Found(floor, sorted(starters), sorted(others), "-".join(str(lines[k]) for k in (1, 2, 3)), relaxed.objective, 10 * relaxed.money, left)


ROUND = f"{OUT}, node long, forced array<long>, banned array<long>"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def _solved(group: pd.DataFrame, found: Found | None, node: int) -> pd.DataFrame:
    """Rows of the chosen squad, and a row without a player for each node that is left."""
    rows: list[tuple] = []
    if found is not None and found.starters:
        mean, at = dict(zip(group["player_id"], group["mean"])), dict(zip(group["player_id"], group["position"]))
        captain = min(found.starters, key=lambda x: (-mean[x], x))
        rows = [(group["problem"].iloc[0], x, at[x], role, x == captain, found.formation, found.objective, found.bound, found.price, True, node, None, None) for role, xs in (("starter", found.starters), ("bench", found.others)) for x in xs]
    for forced, banned in found.open if found is not None else []:
        rows.append((group["problem"].iloc[0], None, None, None, None, None, found.objective if np.isfinite(found.objective) else None, None, None, None, node, sorted(forced), sorted(banned)))
    out = pd.DataFrame(rows, columns=[*NAMES, "node", "forced", "banned"], dtype=object)
    return out.astype({"player_id": "Int64", "node": "Int64", "is_captain": "boolean", "exact": "boolean", "objective": float, "bound": float, "budget_price": float})


def exact(candidates: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP, most_nodes: int = 2_000) -> DataFrame:
    """The best squad of every problem, proven. Problems without a legal squad give no rows.

    One row per chosen player: role, captain (best mean, ties to the smaller id), formation, objective, the bound of the linear
    relaxation and its price of one more unit of money; ``exact`` is always true.

    Each problem is one task's work at first. A search that has not ended after ``most_nodes`` nodes hands the rest of them on as a
    table; in the next round every one of them is a task of its own, and the best squad of its problem so far cuts it short.
    """
    tenths = round(budget * 10)
    pools = problems(candidates, cap)

    def first(group: pd.DataFrame) -> pd.DataFrame:
        return _solved(group, choose(group, budget=tenths, cap=cap, most_nodes=most_nodes), 0)

    def next_(nodes: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes) or not len(group):
            return _solved(group, None, 0)
        begin = [(frozenset(int(x) for x in f), frozenset(int(x) for x in b)) for f, b in zip(nodes["forced"], nodes["banned"])]
        floor = nodes["floor"].max()
        return _solved(group, choose(group, budget=tenths, cap=cap, most_nodes=most_nodes, nodes=begin, floor=-np.inf if pd.isna(floor) else float(floor)), int(nodes["node"].iloc[0]))

    found = written(pools.groupBy("problem").applyInPandas(first, ROUND))
    chosen = found.filter("player_id is not null").withColumn("round", F.lit(0))
    n = 0
    while found.filter("player_id is null").limit(1).count():
        n += 1
        best = chosen.groupBy("problem").agg(F.max("objective").alias("floor"))
        nodes = found.filter("player_id is null").select("problem", "forced", "banned").join(best, "problem", "left").withColumn("node", F.monotonically_increasing_id())
        nodes = written(nodes)
        of = pools.join(nodes.select("problem", F.col("node").alias("of_node")), "problem")
        found = written(nodes.groupBy("problem", "node").cogroup(of.groupBy("problem", "of_node")).applyInPandas(next_, ROUND))
        chosen = chosen.unionByName(found.filter("player_id is not null").withColumn("round", F.lit(n)))
    if not n:
        return chosen.select(*NAMES)
    # of a problem's squads the best one, and of equal ones the first
    top = chosen.groupBy("problem").agg(F.min(F.struct((-F.col("objective")).alias("o"), "round", "node")).alias("top")).select("problem", F.col("top.round").alias("round"), F.col("top.node").alias("node"))
    return chosen.join(top, ["problem", "round", "node"], "left_semi").select(*NAMES)


TRACE = "problem string, step int, multiplier double, dual double, primal double, slack double, converged boolean"


def _inner(place: np.ndarray, team: np.ndarray, score: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy by score within quotas and club limits: squad and lineup (row numbers)."""
    squad, count = [], Counter()
    for k, p in enumerate(fixed.POSITIONS):
        own = np.flatnonzero(place == k)
        n = 0
        for i in own[np.argsort(-score[own], kind="stable")]:
            if n < fixed.SQUAD_QUOTA[p] and count[team[i]] < cap:
                squad.append(i)
                count[team[i]] += 1
                n += 1
    squad = np.array(squad, int)
    if len(squad) < fixed.SQUAD_SIZE:
        return squad, squad[: fixed.LINEUP_SIZE]
    lines = [squad[place[squad] == k] for k in range(4)]
    lines = [x[np.argsort(-score[x], kind="stable")] for x in lines]
    ways = [(d, m, 10 - d - m) for d in range(3, 6) for m in range(2, 6) if 1 <= 10 - d - m <= 3]
    trials = [np.concatenate([x[:n] for x, n in zip(lines, (1, *w))]) for w in ways]
    return squad, max(trials, key=lambda x: round(score[x].sum(), 9))


def _descend(group: pd.DataFrame, budget: float, cap: int, iterations: int, tol: float) -> tuple[list[tuple], tuple[np.ndarray, np.ndarray] | None, float, float]:
    """The trace of a problem's multiplier, the best squad and lineup within the budget, their score and the best dual bound. ``group`` comes by id."""
    place = group["position"].map(fixed.POSITIONS.index).to_numpy()
    team, price, gain = group["team"].to_numpy(), group["price_tenths"].to_numpy() / 10, group["score"].to_numpy()
    lam, theta, still, best_dual, best_primal, rows, kept = 0.5, 2.0, 0, np.inf, -np.inf, [], None
    for k in range(iterations):
        score = gain - lam * price
        squad, eleven = _inner(place, team, score, cap)
        dual, primal, slack = score[eleven].sum() + lam * budget, gain[eleven].sum(), price[squad].sum() - budget
        still = 0 if dual < best_dual else still + 1
        best_dual = min(best_dual, dual)
        if slack <= 0.01 and len(squad) == fixed.SQUAD_SIZE and primal > best_primal:
            best_primal, kept = primal, (squad, eleven)
        done = best_primal > -np.inf and (best_dual - best_primal) / max(abs(best_dual), 1e-6) < tol
        rows.append((group["problem"].iloc[0], k, lam, dual, primal, slack, bool(done)))
        if done:
            break
        if abs(slack) >= 1e-8:
            lam = max(0.0, lam + theta * (dual - (best_primal if best_primal > -np.inf else 0.0)) / slack**2 * slack)
        if still >= 5:
            theta, still = theta * 0.95, 0
    return rows, kept, best_primal, best_dual


def problems(candidates: DataFrame, cap: int = fixed.CLUB_CAP) -> DataFrame:
    """The candidates that matter, as the solvers take them."""
    return pruned(candidates, keep=cap).select(F.col("problem").cast("string").alias("problem"), F.col("player_id").cast("long").alias("player_id"), "position", F.col("team").cast("string").alias("team"), F.col("price_tenths").cast("int").alias("price_tenths"), F.col("score").cast("double").alias("score"), F.col("mean").cast("double").alias("mean"))


def subgradient(candidates: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP, iterations: int = 100, tol: float = 0.01) -> DataFrame:
    """The budget priced into the score: a multiplier moved along the budget's excess, one row per step and problem.

    Starts at 0.5; Polyak steps with factor 2, which falls by 5% after five steps without a better dual; ends once the
    relative gap is below ``tol``. While no squad has met the budget, the target of a step is 0.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_descend(group.sort_values("player_id"), budget, cap, iterations, tol)[0], columns=[x.split()[0] for x in TRACE.split(", ")])

    return problems(candidates, cap).groupBy("problem").applyInPandas(run, TRACE)


def lagrangian(candidates: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP, iterations: int = 100, tol: float = 0.01) -> DataFrame:
    """The best squad within the budget that the multiplier's steps met, in the form of ``exact``: the bound is the best dual
    value and ``exact`` says that the two meet. A problem whose steps met no such squad gives no rows."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("player_id")
        columns = [x.split()[0] for x in OUT.split(", ")]
        trace, kept, primal, dual = _descend(group, budget, cap, iterations, tol)
        if kept is None or len(kept[1]) != fixed.LINEUP_SIZE:
            return pd.DataFrame(columns=columns)
        squad, eleven = (group.iloc[x] for x in kept)
        starters = set(eleven["player_id"])
        lines = eleven["position"].value_counts()
        captain = min(zip(-eleven["mean"], eleven["player_id"]))[1]
        rows = [(r.problem, r.player_id, r.position, "starter" if r.player_id in starters else "bench", r.player_id == captain, "-".join(str(lines.get(p, 0)) for p in ("DEF", "MID", "FWD")), primal, dual, trace[-1][2], dual - primal < 1e-9) for r in squad.itertuples()]
        return pd.DataFrame(rows, columns=columns)

    return problems(candidates, cap).groupBy("problem").applyInPandas(run, OUT)


def greedy_squad(candidates: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP) -> DataFrame:
    """Greedy squads with their best formation by score, in the form of ``exact`` (without a bound or a price of money)."""
    one = candidates.select(F.col("problem").cast("string").alias("problem"), F.col("player_id").cast("long").alias("player_id"), "position", "team", "price_tenths", F.col("score").cast("double").alias("score"), F.col("mean").cast("double").alias("mean"))
    squads = ranked(greedy(one, budget=budget, cap=cap).join(one, ["problem", "player_id"])).join(best_formation(greedy(one, budget=budget, cap=cap).join(one, ["problem", "player_id"])), "problem")
    lines = F.split("formation", "-")
    most = F.when(F.col("position") == "GK", 1)
    for i, p in enumerate(("DEF", "MID", "FWD")):
        most = most.when(F.col("position") == p, lines[i].cast("int"))
    out = squads.withColumn("role", F.when(F.col("rank") <= most, "starter").otherwise("bench"))
    best = F.row_number().over(Window.partitionBy("problem", "role").orderBy(F.desc("mean"), "player_id"))
    return out.select("problem", "player_id", "position", "role", ((F.col("role") == "starter") & (best == 1)).alias("is_captain"), "formation", F.col("total").alias("objective"), F.lit(None).cast("double").alias("bound"), F.lit(None).cast("double").alias("budget_price"), F.lit(False).alias("exact"))


def vice_captain(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """``chosen`` with is_vice: the starter with the second best mean (ties to the smaller id)."""
    means = candidates.select(F.col("problem").cast("string").alias("problem"), F.col("player_id").cast("long").alias("player_id"), F.col("mean").alias("__mean"))
    second = F.row_number().over(Window.partitionBy("problem", "role").orderBy(F.desc("__mean"), "player_id")) == 2
    return chosen.join(means, ["problem", "player_id"]).withColumn("is_vice", (F.col("role") == "starter") & second).drop("__mean")


def summary(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per problem: what the eleven are expected to score, what all fifteen cost, formation and captain; money to one digit, points to two."""
    rows = chosen.join(candidates.select(F.col("problem").cast("string").alias("problem"), "player_id", "price_tenths", "mean"), ["problem", "player_id"])
    return rows.groupBy("problem", "formation").agg(F.round(F.sum(F.when(F.col("role") == "starter", F.col("mean"))), 2).alias("expected"), F.round(F.sum("price_tenths") / 10, 1).alias("cost"), F.max(F.when(F.col("is_captain"), F.col("player_id"))).alias("captain"))
