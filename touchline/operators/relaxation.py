"""The linear relaxation of the squad program: its value, a price for every constraint, and what binds.

A squad's shares ``s`` and starting shares ``x`` of all players may be fractions. Without budget and club limits the program is a
flow (quotas by position, starters by position and in all), whose best vertex is a whole squad and comes from ranks alone. So
the relaxation mixes whole squads: each step prices money and clubs, finds the best squad at these prices, and lets it
enter the mix (a revised simplex over squads that are never listed). At the end no squad beats the mix, and the prices of
the remaining constraints follow in closed form from the marginal starters.

All problems are solved side by side, one task a problem, whose candidates are bounded by ``squad.pruned``; prices of the
constraints that come once a player (starting needs membership) are column expressions over all candidates, pruned ones included.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import fixed

QUOTA = np.array([fixed.SQUAD_QUOTA[p] for p in fixed.POSITIONS])
LEAST, MOST = ([d[p] for p in fixed.POSITIONS] for d in (fixed.LINEUP_LEAST, fixed.LINEUP_MOST))
WAYS = [(1, d, m, fixed.LINEUP_SIZE - 1 - d - m) for d in range(LEAST[1], MOST[1] + 1) for m in range(LEAST[2], MOST[2] + 1) if LEAST[3] <= fixed.LINEUP_SIZE - 1 - d - m <= MOST[3]]
TINY = 1e-9


@dataclass
class Pool:
    """A problem's candidates by position and id; clubs as numbers into ``clubs``."""

    ids: np.ndarray
    place: np.ndarray
    club: np.ndarray
    price: np.ndarray
    score: np.ndarray
    clubs: list[str]

    @classmethod
    def of(cls, group: pd.DataFrame) -> Pool:
        group = group.assign(__place=group["position"].map(fixed.POSITIONS.index)).sort_values(["__place", "player_id"])
        club, clubs = pd.factorize(group["team"], sort=True)
        as_of = lambda c, kind: group[c].to_numpy(kind)
        return cls(as_of("player_id", np.int64), as_of("__place", np.int64), club, as_of("price_tenths", np.int64), as_of("score", float), list(clubs))

    def only(self, keep: np.ndarray) -> Pool:
        return Pool(self.ids[keep], self.place[keep], self.club[keep], self.price[keep], self.score[keep], self.clubs)

    def rows(self, place: int) -> np.ndarray:
        return np.flatnonzero(self.place == place)


def _line(score: np.ndarray, cost: np.ndarray, quota: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """By starters n from 0 to ``quota``: the largest score of n starters less the cost of all ``quota``; who that is can be traced by the parts."""
    best = np.full((quota + 1, quota + 1), -np.inf)
    best[0, 0] = 0.0
    parts = []
    for s, c in zip(score, cost):
        part = np.zeros(best.shape, np.int8)
        new = best.copy()
        for kind, to, from_, gain in ((2, new[:, 1:], best[:, :-1], -c), (1, new[1:], best[:-1], s - c)):
            better = from_ + gain > to
            to[better] = (from_ + gain)[better]
            (part[:, 1:] if kind == 2 else part[1:])[better] = kind
        parts.append(part)
        best = new
    return best[np.arange(quota + 1), quota - np.arange(quota + 1)], parts


def best_squad(pool: Pool, cost: np.ndarray, score: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, list[np.ndarray], tuple]:
    """The best whole squad at a cost of each player, without budget and clubs: value, starters, others, values by number of
    starters for each position, and the numbers chosen. Of a position only the best ``quota`` as starters and as others can be in it."""
    lines, traces = [], []
    for k, quota in enumerate(QUOTA):
        own = pool.rows(k)
        as_starter, as_other = score[own] - cost[own], -cost[own]
        if len(own) > 2 * quota:
            own = own[np.unique(np.concatenate([np.argpartition(-v, quota - 1)[:quota] for v in (as_starter, as_other)]))]
        values, parts = _line(score[own], cost[own], quota)
        lines.append(values)
        traces.append((own, parts))
    way = max(WAYS, key=lambda w: sum(line[n] for line, n in zip(lines, w)))
    starters, others = [], []
    for (own, parts), quota, n in zip(traces, QUOTA, way):
        rest = quota - n
        for i in range(len(own) - 1, -1, -1):
            kind = parts[i][n, rest]
            if kind:
                (starters if kind == 1 else others).append(own[i])
                n, rest = n - (kind == 1), rest - (kind == 2)
    return float(sum(line[n] for line, n in zip(lines, way))), np.array(starters, int), np.array(others, int), lines, way


@dataclass
class Relaxed:
    """The solved relaxation. ``money`` is for a tenth; ``member`` and ``start`` are the shares s and x of the pool's players."""

    objective: float
    money: float
    clubs: np.ndarray
    quota: np.ndarray
    lineup: float
    line: np.ndarray
    least: np.ndarray
    most: np.ndarray
    member: np.ndarray
    start: np.ndarray
    squads: list[tuple[np.ndarray, np.ndarray]]

    def worth(self, pool: Pool) -> np.ndarray:
        """What a place in the squad for each player brings at these prices, less the price of a place of its position."""
        return np.maximum(0.0, pool.score - self.line[pool.place]) - self.money * pool.price - self.clubs[pool.club] - self.quota[pool.place]


def solve(pool: Pool, *, budget: int, cap: int, most_steps: int = 5_000) -> Relaxed | None:
    """The relaxation of one problem, ``budget`` in tenths; None if no mix of squads keeps the limits."""
    if any(len(pool.rows(k)) < q for k, q in enumerate(QUOTA)):
        return None
    n_clubs = len(pool.clubs)
    size = n_clubs + 2  # money, clubs, the shares' sum
    limits = np.array([budget, *[cap] * n_clubs, 1], float)
    # slightly shifted limits keep steps from standing still where several limits meet; prices don't depend on them
    shift = np.append(1e-7 * (1 + np.random.default_rng(0).random(size - 1)), 0.0)
    columns, squads = np.eye(size), [None] * size
    worth = np.zeros(size)  # what each column of the mix scores; the last one stands for a squad that does not exist
    missing = size - 1
    nothing = np.zeros(len(pool.ids))
    for _ in range(most_steps):
        # until real squads make up the mix, the share of the one that does not exist is all that counts
        real = missing is None
        values = worth if real else np.where(np.arange(size) == missing, -1.0, 0.0)
        prices = np.linalg.solve(columns.T, values)
        even = TINY * max(1.0, float(np.abs(values).max()))
        low = int(np.argmin(prices[:-1]))
        if prices[low] < -even:
            entering, value, squad = np.eye(size)[low], 0.0, None
        else:
            money, clubs = max(prices[0], 0.0), np.maximum(prices[1:-1], 0.0)
            found, starters, others, lines, way = best_squad(pool, money * pool.price + clubs[pool.club], pool.score if real else nothing)
            if found - prices[-1] <= even * 10:
                if real:
                    break
                return None
            own = np.concatenate([starters, others])
            entering = np.array([pool.price[own].sum(), *np.bincount(pool.club[own], minlength=n_clubs), 1], float)
            value, squad = pool.score[starters].sum(), (starters, others)
        shares, along = np.linalg.solve(columns, np.stack([limits + shift, entering], 1)).T
        rising = along > 1e-9
        ratio = np.where(rising, np.maximum(shares, 0.0) / np.where(rising, along, 1.0), np.inf)
        least = ratio.min()
        near = np.flatnonzero(ratio <= least * (1 + 1e-9) + 1e-13)
        leaving = missing if missing is not None and missing in near else int(near[np.argmax(along[near])])
        columns[:, leaving], worth[leaving], squads[leaving] = entering, value, squad
        if leaving == missing:
            missing = None
    else:
        raise RuntimeError(f"the relaxation took more than {most_steps} steps")
    shares = np.maximum(np.linalg.solve(columns, limits), 0.0)
    member, start = np.zeros(len(pool.ids)), np.zeros(len(pool.ids))
    for share, squad in zip(shares, squads):
        if squad is not None:
            start[squad[0]] += share
            member[np.concatenate(squad)] += share
    gains = [np.diff(line) for line in lines]  # gains[k][n - 1] is what the n-th starter adds
    up = lambda k: gains[k][way[k]] if way[k] < QUOTA[k] else -np.inf
    lineup = max(up(k) for k in range(4) if way[k] < MOST[k])
    line = np.array([min(max(lineup, up(k)), gains[k][way[k] - 1]) for k in range(4)])
    out = Relaxed(float(pool.score @ start), float(money), clubs, np.zeros(4), float(lineup), line, np.maximum(0.0, lineup - line), np.maximum(0.0, line - lineup), member, start, [s for s in squads if s is not None])
    worth = out.worth(pool)
    out.quota = np.array([np.partition(worth[pool.rows(k)], -q)[-q] for k, q in enumerate(QUOTA)])
    return out


LEVELS = "problem string, kind string, key string, dual double, level double"
CONSTRAINTS = ["problem", "constraint", "dual", "slack", "binding"]


def _levels(budget: int, cap: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        pool = Pool.of(group)
        r = solve(pool, budget=budget, cap=cap)
        if r is None:
            return pd.DataFrame(columns=[c.split()[0] for c in LEVELS.split(", ")])
        starts = [float(r.start[pool.rows(k)].sum()) for k in range(4)]
        rows = [("objective", "", r.objective, r.objective), ("budget", "", 10 * r.money, float(pool.price @ r.member) / 10), ("squad_size", "", 0.0, float(r.member.sum())), ("lineup_size", "", r.lineup, float(r.start.sum()))]
        rows += [("team_cap", c, float(r.clubs[i]), float(r.member[pool.club == i].sum())) for i, c in enumerate(pool.clubs)]
        for k, p in enumerate(fixed.POSITIONS):
            rows += [("squad_quota", p, float(r.quota[k]), float(r.member[pool.rows(k)].sum())), ("lineup_min", p, -float(r.least[k]), starts[k]), ("lineup_max", p, float(r.most[k]), starts[k]), ("line", p, float(r.line[k]), 0.0)]
        rows += [("player", str(pool.ids[i]), float(r.start[i]), float(r.member[i])) for i in np.flatnonzero(r.member > 0)]
        return pd.DataFrame([(group["problem"].iloc[0], *x) for x in rows], columns=[c.split()[0] for c in LEVELS.split(", ")])

    return run


def levels(problems: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP) -> DataFrame:
    """Prices and levels of the constraints of each problem (``squad.problems``), and the shares of its players."""
    return problems.groupBy("problem").applyInPandas(_levels(round(budget * 10), cap), LEVELS)


def _limit(budget: float, cap: int):
    by_place = lambda d: F.element_at(F.create_map(*[F.lit(x) for p in fixed.POSITIONS for x in (p, float(d[p]))]), F.col("key"))
    kind = F.col("kind")
    whole = F.when(kind == "budget", float(budget)).when(kind == "squad_size", float(fixed.SQUAD_SIZE)).when(kind == "lineup_size", float(fixed.LINEUP_SIZE)).when(kind == "team_cap", float(cap))
    return whole.when(kind == "squad_quota", by_place(fixed.SQUAD_QUOTA)).when(kind == "lineup_min", by_place(fixed.LINEUP_LEAST)).when(kind == "lineup_max", by_place(fixed.LINEUP_MOST))


def player_prices(candidates: DataFrame, solved: DataFrame) -> DataFrame:
    """Each candidate's shares (``member``, ``start``), the price of "starting needs membership" (``coupling``) and the price of its own
    place (``place``: what the bound of one place holds it back by), from the ``levels`` of its problem."""
    of = lambda kind, key, name: solved.filter(F.col("kind") == kind).select("problem", F.col("key").alias(key), F.col("dual").alias(name))
    c = candidates.select(F.col("problem").cast("string").alias("problem"), "player_id", "position", F.col("team").cast("string").alias("team"), "price_tenths", "score")
    c = c.join(of("line", "position", "line"), ["problem", "position"]).join(of("squad_quota", "position", "quota"), ["problem", "position"]).join(of("team_cap", "team", "club"), ["problem", "team"])
    c = c.join(solved.filter("kind = 'budget'").select("problem", F.col("dual").alias("money")), "problem")
    shares = solved.filter("kind = 'player'").select("problem", F.col("key").cast("long").alias("player_id"), F.col("dual").alias("start"), F.col("level").alias("member"))
    c = c.join(shares, ["problem", "player_id"], "left").na.fill(0.0, ["start", "member"])
    c = c.withColumn("coupling", F.greatest(F.lit(0.0), F.col("score") - F.col("line")))
    return c.withColumn("worth", F.col("coupling") - F.col("money") * F.col("price_tenths") / 10 - F.col("club") - F.col("quota")).withColumn("place", F.greatest(F.lit(0.0), F.col("worth")))


def constraints(solved: DataFrame, prices: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP) -> DataFrame:
    """problem, constraint, dual, slack (0 or more) and binding, for every constraint of every problem. The dual says how much the
    objective gains when the right side grows by one; that of a lower limit is 0 or less."""
    rows = solved.withColumn("limit", _limit(budget, cap)).filter("limit is not null")
    name = F.when(F.col("key") == "", F.col("kind")).otherwise(F.concat_ws("_", "kind", "key"))
    whole = rows.select("problem", name.alias("constraint"), "dual", F.abs(F.col("limit") - F.col("level")).alias("slack"))
    each = prices.select("problem", F.concat(F.lit("coupling_"), F.col("player_id").cast("string")).alias("constraint"), F.col("coupling").alias("dual"), F.abs(F.col("member") - F.col("start")).alias("slack"))
    return whole.unionByName(each).withColumn("binding", F.col("slack") < 1e-6).select(*CONSTRAINTS)


def certificate(solved: DataFrame, prices: DataFrame, *, budget: float = fixed.BUDGET, cap: int = fixed.CLUB_CAP) -> DataFrame:
    """What proves the relaxation of each problem: its objective, that of the dual program, the largest violation of the dual's
    constraints, and the largest product of a price with its slack. The first two agree and the others are 0 but for rounding."""
    rows = solved.withColumn("limit", _limit(budget, cap))
    whole = rows.groupBy("problem").agg(
        F.max(F.when(F.col("kind") == "objective", F.col("dual"))).alias("objective"), F.sum(F.when(F.col("limit").isNotNull(), F.col("dual") * F.col("limit"))).alias("fixed"),
        F.max(F.when(F.col("limit").isNotNull(), F.abs(F.col("dual") * (F.col("limit") - F.col("level"))))).alias("slack_a"),
        F.max(F.when(F.col("kind").isin("budget", "team_cap", "lineup_max"), -F.col("dual")).when(F.col("kind") == "lineup_min", F.col("dual"))).alias("sign"),
        F.max(F.when(F.col("kind").isin("budget", "team_cap", "lineup_max"), F.col("level") - F.col("limit")).when(F.col("kind") == "lineup_min", F.col("limit") - F.col("level")).when(F.col("limit").isNotNull(), F.abs(F.col("limit") - F.col("level")))).alias("infeasible"),
    )
    each = prices.groupBy("problem").agg(
        F.sum("place").alias("places"), F.max(F.greatest("coupling", F.lit(0.0)) * (F.col("member") - F.col("start"))).alias("slack_b"), F.max(F.col("place") * (1 - F.col("member"))).alias("slack_c"),
        F.max(-F.least(F.col("worth"), F.lit(0.0)) * F.col("member")).alias("slack_d"), F.max((F.col("coupling") - (F.col("score") - F.col("line"))) * F.col("start")).alias("slack_e"),
        F.max(F.greatest(F.col("start") - F.col("member"), F.col("member") - 1)).alias("shares"),
    )
    both = whole.join(each, "problem")
    return both.select("problem", "objective", (F.col("fixed") + F.col("places")).alias("dual_objective"), F.greatest("sign", "infeasible", "shares", F.lit(0.0)).alias("violation"), F.greatest("slack_a", "slack_b", "slack_c", "slack_d", "slack_e").alias("complementarity"))
