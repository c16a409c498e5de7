"""State models fitted per player by expectation maximisation, batched over the rows of an Arrow batch.

Spark brings each player's series together (a season's gameweeks at most) and spreads the players; inside a task rows of one
length are fitted at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import fixed
from touchline.functions.scoring import expected_points, share_of_minutes, zero_if_null

from .gameweek import in_order

TINY = 1e-300


class Models:
    """Parameters of a batch of models: start (B, S), move (B, S, S), mean and var (B, S, D)."""

    def __init__(self, start, move, mean, var, *, weight: float | None = None, relative: bool = False):
        self.start, self.move, self.mean, self.var = (np.array(x, float) for x in (start, move, mean, var))
        self.prior = self.move.copy(), self.mean.copy(), self.var.copy()
        self.weight, self.relative = weight, relative

    def log_density(self, x: np.ndarray) -> np.ndarray:
        var = np.maximum(self.var, 1e-8)[:, None]
        return -0.5 * (np.log(2 * np.pi * var) + (x[:, :, None] - self.mean[:, None]) ** 2 / var).sum(-1)

    def density(self, x: np.ndarray) -> np.ndarray:
        log = self.log_density(x)
        return np.exp(log - log.max(-1, keepdims=True)) if self.relative else np.exp(log)

    def forward(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        alpha, scale = np.empty_like(e), np.empty(e.shape[:2])
        ahead = self.start
        for t in range(e.shape[1]):
            raw = ahead * e[:, t]
            scale[:, t] = raw.sum(1)
            alpha[:, t] = raw / np.where(scale[:, t] > 0, scale[:, t], 1)[:, None]
            ahead = np.einsum("bi,bij->bj", alpha[:, t], self.move)
        return alpha, scale

    def backward(self, e: np.ndarray, scale: np.ndarray) -> np.ndarray:
        beta = np.ones_like(e)
        for t in range(e.shape[1] - 2, -1, -1):
            beta[:, t] = np.einsum("bij,bj->bi", self.move, e[:, t + 1] * beta[:, t + 1]) / np.where(scale[:, t + 1] > 0, scale[:, t + 1], 1)[:, None]
        return beta

    def posterior(self, x: np.ndarray) -> np.ndarray:
        e = self.density(x)
        alpha, scale = self.forward(e)
        return _even(alpha * self.backward(e, scale))

    def fit(self, x: np.ndarray, iterations: int = 20, tol: float = 1e-4) -> Models:
        """Each model stops by itself once its likelihood moves by less than ``tol``."""
        live, last = np.ones(len(x), bool), np.full(len(x), -np.inf)
        for _ in range(iterations):
            e = self.density(x)
            alpha, scale = self.forward(e)
            beta = self.backward(e, scale)
            gamma = _even(alpha * beta)
            xi = np.einsum("bti,bij,btj->btij", alpha[:, :-1], self.move, e[:, 1:] * beta[:, 1:])
            xi /= np.where((s := xi.sum((2, 3), keepdims=True)) > 0, s, 1)
            self._improve(x, gamma, xi, live)
            now = np.log(scale + TINY).sum(1)
            live &= ~(np.abs(now - last) < tol)
            last = now
            if not live.any():
                break
        return self

    def _improve(self, x: np.ndarray, gamma: np.ndarray, xi: np.ndarray, live: np.ndarray) -> None:
        least = 0.0 if self.weight is None else 1e-10
        keep = 0.0 if self.weight is None else self.weight
        start = gamma[:, 0] if self.weight is None else _even(np.maximum(gamma[:, 0], 1e-10))
        left = gamma[:, :-1].sum(1)
        move = keep * self.prior[0] + (1 - keep) * xi.sum(1) / np.where(left > least, left, 1)[:, :, None]
        move = np.where((left > least)[:, :, None], move, self.move)
        move = move / np.where((s := move.sum(2, keepdims=True)) > 0, s, 1)
        mass = gamma.sum(1)
        share = gamma / np.where(mass > 0, mass, 1)[:, None]
        mean = np.einsum("bts,btd->bsd", share, x)
        var = np.einsum("bts,btsd->bsd", share, (x[:, :, None] - mean[:, None]) ** 2)
        mean, var = keep * self.prior[1] + (1 - keep) * mean, keep * self.prior[2] + (1 - keep) * var
        var = np.maximum(var, 0.01 if self.weight is None else 1e-4)
        seen = live[:, None] & (mass > 1e-10)
        self.mean[seen], self.var[seen] = mean[seen], var[seen]
        self.start[live], self.move[live] = start[live], move[live]

    def path(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states; the first of equals."""
        log_e = self.log_density(x) if self.relative else np.log(np.exp(self.log_density(x)) + TINY)
        log_move, best = np.log(self.move + TINY), np.log(self.start + TINY) + log_e[:, 0]
        back = np.zeros(log_e.shape, int)
        for t in range(1, x.shape[1]):
            ways = best[:, :, None] + log_move
            back[:, t] = ways.argmax(1)
            best = ways.max(1) + log_e[:, t]
        out = np.empty(x.shape[:2], int)
        out[:, -1] = best.argmax(1)
        for t in range(x.shape[1] - 1, 0, -1):
            out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t, None], 1)[:, 0]
        return out

    def ahead(self, x: np.ndarray, boost: np.ndarray | None = None) -> np.ndarray:
        """The distribution over states before each step but the first, and after the last (B, T, S)."""
        alpha, _ = self.forward(self.density(x))
        out = np.einsum("bti,bij->btj", alpha, self.move)
        if boost is not None:
            out[:, -1] = np.einsum("bi,bij->bj", alpha[:, -1], _even(self.move * boost[:, None]))
        return out

    def outlook(self, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and variance of the first feature under distributions (B, S)."""
        mean = np.einsum("bs,bs->b", ahead, self.mean[:, :, 0])
        return mean, np.einsum("bs,bs->b", ahead, self.var[:, :, 0] + self.mean[:, :, 0] ** 2) - mean**2


def _even(x: np.ndarray) -> np.ndarray:
    total = x.sum(-1, keepdims=True)
    return x / np.where(total == 0, 1, total)


def scalar_models(n: int) -> Models:
    mean, sd = np.array(fixed.EMISSIONS).T
    rows = lambda x: np.broadcast_to(x, (n, *np.shape(x)))
    return Models(rows(fixed.INITIAL), rows(fixed.TRANSITION), rows(mean[:, None]), rows(sd[:, None] ** 2))


def position_models(positions: list[str], weight: float = 0.85) -> Models:
    n = len(positions)
    anchor = np.array([fixed.STAR_ANCHOR.get(p, fixed.OTHER_ANCHOR) for p in positions])
    mean = np.array(fixed.LADDER)[None] * np.stack([anchor, np.ones(n)], 1)[:, None]
    rows = lambda x: np.broadcast_to(x, (n, *np.shape(x)))
    return Models(rows(fixed.INITIAL), rows(fixed.TRANSITION), mean, rows(fixed.LADDER_VARIANCE), weight=weight, relative=True)


def _by_length(pdf: pd.DataFrame, column: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for n, part in pdf.groupby(pdf[column].map(len)):
        if n:
            x = np.stack([np.stack([np.atleast_1d(v) for v in row]) for row in part[column]]).astype(float)
            yield part, x


def learn_scalar(series: DataFrame, *, iterations: int = 20, least: int = 10, fit: bool = True) -> DataFrame:
    """``series`` has player_id and y, the ordered points; gives the forecast, the likeliest path and the learned means.

    Series shorter than ``least`` keep the default parameters. Players without points drop out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, x in _by_length(pdf, "y"):
                models = scalar_models(len(part))
                if fit and x.shape[1] >= least:
                    models.fit(x, iterations)
                mean, var = models.outlook(models.ahead(x)[:, -1])
                yield pd.DataFrame({"player_id": part["player_id"].to_numpy(), "mean": mean, "var": np.maximum(var, 0), "path": models.path(x).tolist(), "state_means": models.mean[:, :, 0].tolist()})

    return series.select("player_id", "y").mapInPandas(run, "player_id long, mean double, var double, path array<long>, state_means array<double>")


def learn_positions(windows: DataFrame, *, iterations: int = 20, least: int = 3, weight: float = 0.85, step: float = 0.1, history: int = 3) -> DataFrame:
    """``windows`` has player_id, gameweek, position, x (ordered [expected points, share of minutes]), points and e (the
    structural forecast of each row, null where unknown). Gives mv_mean, mv_var and the blend's weight for that gameweek.

    Windows shorter than ``least`` keep the default parameters. The weight is the smallest of a grid with the least squared
    error of weight * e + (1 - weight) * one-step forecasts, 0.8 where at most ``history`` rows can be compared.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = np.arange(0.0, 1.0 + 1e-9, step)
        for pdf in batches:
            for part, x in _by_length(pdf, "x"):
                models = position_models(part["position"].tolist(), weight)
                if x.shape[1] >= least:
                    models.fit(x, iterations)
                ahead = models.ahead(x)
                mean, var = models.outlook(ahead[:, -1])
                before = np.maximum(0.0, np.einsum("bts,bs->bt", ahead[:, :-1], models.mean[:, :, 0]))
                weights = []
                for y, e, m in zip(part["points"], part["e"], before):
                    y, e = np.array(y, float)[1:], np.array(e, float)[1:]
                    fine = np.isfinite(y) & np.isfinite(e) & np.isfinite(m)
                    if fine.sum() <= history:
                        weights.append(fixed.DEFAULT_ALPHA)
                        continue
                    errors = ((grid[:, None] * e[fine] + (1 - grid[:, None]) * m[fine] - y[fine]) ** 2).mean(1)
                    weights.append(float(grid[int(np.argmin(errors.round(12)))]))
                yield pd.DataFrame({"player_id": part["player_id"].to_numpy(), "gameweek": part["gameweek"].to_numpy(), "mv_mean": np.maximum(0, mean), "mv_var": np.maximum(var, 1e-6) + 1, "weight": weights})

    return windows.select("player_id", "gameweek", "position", "x", "points", "e").mapInPandas(run, "player_id long, gameweek long, mv_mean double, mv_var double, weight double")


def windows(df: DataFrame, *, lookback: int = 8) -> DataFrame:
    """For each row of ``df``, the ``lookback`` gameweeks before it; rows without any drop out.

    x is a gameweek's expected points and share of minutes; e is the expected points times the share of the three gameweeks
    before it that were played. Whether real goals (assists) stand in for expected ones, because those are all zero,
    is told from the window alone, so nothing of the row itself or after it enters.
    """
    get = lambda c: zero_if_null(F.col(c)) if c in df.columns else F.lit(0.0)
    played = F.avg((F.col("minutes") > 0).cast("double")).over(in_order().rowsBetween(-3, -1))
    points = [expected_points(get, F.col("position"), get(g), get(a)).alias(f"{g}_{a}") for g in ("xG", "goals") for a in ("xA", "assists")]
    row = F.struct(*points, share_of_minutes(F.col("minutes")).alias("share"), F.col("points").cast("double").alias("p"), F.col("__played").alias("played"), get("xG").alias("g"), get("xA").alias("a"))
    out = df.withColumn("__played", played).withColumn("__w", F.collect_list(row).over(in_order().rowsBetween(-lookback, -1))).filter(F.size("__w") > 0)
    out = out.withColumn("__g", F.exists("__w", lambda r: r["g"] != 0)).withColumn("__a", F.exists("__w", lambda r: r["a"] != 0))
    chosen = lambda r: F.when(F.col("__g"), F.when(F.col("__a"), r["xG_xA"]).otherwise(r["xG_assists"])).when(F.col("__a"), r["goals_xA"]).otherwise(r["goals_assists"])
    x, e = F.transform("__w", lambda r: F.array(chosen(r), r["share"])), F.transform("__w", lambda r: r["played"] * chosen(r))
    return out.select("player_id", "gameweek", "position", x.alias("x"), F.col("__w.p").alias("points"), e.alias("e"))
