"""The scalar models as one forecast per player and gameweek, and their fusion.

One fold over a player's series holds every prefix's state, so forecasts of all gameweeks come from one pass: what the fold
knows before a step is the forecast of that step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline import fixed
from touchline.functions import fixtures, hmm, kalman, news
from touchline.functions.arrays import bind, total
from touchline.functions.fusion import blend, fuse



def with_signals(df: DataFrame, snapshots: DataFrame | None = None, difficulty: str | None = None) -> DataFrame:
    """Adds what reaches the models from outside: boost and q from the latest news of a gameweek, r from its difficulty.

    ``snapshots`` has player_id, gameweek, news_text, at most one row each.
    """
    null = F.lit(None)
    if snapshots is None:
        out = df.withColumn("boost", null.cast("array<double>")).withColumn("q", null.cast("double"))
    else:
        text = F.col("news_text")
        kind = news.category(news.availability(text), news.minutes_risk(text))
        told = snapshots.select("player_id", "gameweek", news.state_boost(kind, news.confidence(text)).alias("boost"), news.process_shock(kind).alias("q"))
        out = df.join(told, ["player_id", "gameweek"], "left")
    return out.withColumn("r", fixtures.noise_factor(F.col(difficulty)) if difficulty else null.cast("double"))


def series(df: DataFrame, points: str = "points", *, undefined: bool = False) -> DataFrame:
    """One row per player: its observations in order, and the arrays that the folds make of them; ``undefined`` as in ``hmm``."""
    cols = [c for c in ("boost", "q", "r") if c in df.columns]
    kinds = {"boost": "array<double>", "q": "double", "r": "double"}
    rest = [F.lit(None).cast(kinds[c]).alias(c) for c in kinds if c not in cols]
    obs = F.array_sort(F.collect_list(F.struct("gameweek", F.col(points).cast("double").alias("y"), *cols, *rest)))
    out = df.groupBy("player_id").agg(obs.alias("obs"))
    out = out.withColumn("kf", kalman.kalman_filter(F.col("obs"))).withColumn("hm", hmm.forward(F.col("obs"), undefined=undefined))
    return out


def smoothed(runs: DataFrame, *, undefined: bool = False) -> DataFrame:
    return runs.withColumn("kf_smooth", kalman.kalman_smooth(F.col("kf"))).withColumn("hm_smooth", hmm.smooth(F.col("obs"), F.col("hm"), undefined=undefined))


def one_step(runs: DataFrame) -> DataFrame:
    """Per player and gameweek, forecasts from the gameweeks before: kf_mean, kf_var, hmm_mean, hmm_var, fused_mean, fused_var, with y and t (from 0)."""
    rows = runs.select("player_id", F.posexplode(F.arrays_zip("obs", "kf", "hm")).alias("t", "x")).select("player_id", "t", "x.obs", "x.kf", "x.hm")
    ahead = rows.withColumn("m", hmm.moments(F.col("hm.ahead"))).select(
        "player_id", F.col("t").cast("long").alias("t"), F.col("obs.gameweek").alias("gameweek"), F.col("obs.y").alias("y"), F.col("kf.ahead_mean").alias("kf_mean"),
        (F.col("kf.ahead_var") + F.coalesce("obs.r", F.lit(1.0)) * fixed.OBSERVATION_NOISE).alias("kf_var"), F.col("m.mean").alias("hmm_mean"), F.col("m.var").alias("hmm_var"),
    )
    fused = fuse(F.col("hmm_mean"), F.greatest(F.col("hmm_var"), F.lit(fixed.VARIANCE_FLOOR)), F.col("kf_mean"), F.col("kf_var"))
    return ahead.withColumn("__f", fused).withColumn("fused_mean", F.col("__f.mean")).withColumn("fused_var", F.col("__f.var")).drop("__f")


def fusion_weights(ahead: DataFrame, *, default: float = fixed.DEFAULT_ALPHA, floor: float = fixed.ALPHA_FLOOR, step: float = fixed.ALPHA_STEP, history: int = fixed.ALPHA_HISTORY) -> DataFrame:
    """player_id, alpha: the filter's weight against the state model, the smallest on a grid of least squared error over its forecasts.

    A squared error of a blend is a square in alpha with three sums, so the grid needs no copies of the rows: it is an array of
    one row per player.
    """
    history = max(3, history)
    d, e = F.col("kf_mean") - F.col("hmm_mean"), F.col("hmm_mean") - F.col("y")
    seen = F.col("t") >= history
    sums = ahead.groupBy("player_id").agg(F.count(F.when(seen, F.col("y"))).alias("n"), F.coalesce(F.sum(F.when(seen, d * d)), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(seen, d * e)), F.lit(0.0)).alias("b"), F.coalesce(F.sum(F.when(seen, e * e)), F.lit(0.0)).alias("c"))
    grid = [round(floor + i * step, 10) for i in range(int((1.0 - floor) / step + 1e-9) + 1)]
    scored = F.array(*[F.struct(F.round((F.col("a") * g * g + F.col("b") * (2 * g) + F.col("c")) / F.col("n"), 9).alias("mse"), F.lit(g).alias("g")) for g in grid])
    return sums.select("player_id", F.when(F.col("n") < 3, F.lit(default)).otherwise(F.array_min(scored)["g"]).alias("alpha"))


def next_forecast(runs: DataFrame, *, mode: str = "precision") -> DataFrame:
    """Each player's next gameweek: kf, hmm and fused means and variances. ``mode`` is precision or calibrated_alpha."""
    out = runs.withColumn("__k", kalman.kalman_predict(F.col("kf"))).withColumn("__h", hmm.predict(F.col("hm")))
    floor = F.greatest(F.col("__h.var"), F.lit(fixed.VARIANCE_FLOOR))
    if mode == "calibrated_alpha":
        out = out.join(fusion_weights(one_step(runs)), "player_id")
        joint = blend(F.col("alpha"), F.col("__k.mean"), F.greatest(F.col("__k.var"), F.lit(1e-6)), F.col("__h.mean"), floor)
    else:
        out = out.withColumn("alpha", F.lit(None).cast("double"))
        joint = fuse(F.col("__h.mean"), floor, F.col("__k.mean"), F.col("__k.var"))
    return out.withColumn("__f", joint).select("player_id", F.col("__k.mean").alias("kf_mean"), F.col("__k.var").alias("kf_var"), F.col("__h.mean").alias("hmm_mean"), F.col("__h.var").alias("hmm_var"), "alpha", F.col("__f.mean").alias("fused_mean"), F.col("__f.var").alias("fused_var"))


def fused_sequence(runs: DataFrame, *, undefined: bool = False) -> DataFrame:
    """Per player and gameweek: the filtered mean fused with the smoothed beliefs' mixture."""
    rows = smoothed(runs, undefined=undefined).select("player_id", F.explode(F.arrays_zip("obs", "kf", "hm_smooth")).alias("x")).withColumn("m", hmm.moments(F.col("x.hm_smooth"), floor=fixed.VARIANCE_FLOOR))
    joint = fuse(F.col("m.mean"), F.col("m.var"), F.col("x.kf.mean"), F.col("x.kf.var"))
    return rows.withColumn("__f", joint).select("player_id", F.col("x.obs.gameweek").alias("gameweek"), F.col("__f.mean").alias("mean"), F.col("__f.var").alias("var"))


def adaptive_weights(errors: DataFrame, models: list[str], *, rate: float = 0.1, recent: int = 5) -> DataFrame:
    """Weights of ``models`` after each gameweek; ``errors`` has gameweek and one column of mean errors per model. One row per gameweek.

    Each gameweek moves the weights a part of the way to the inverse of the mean of the latest errors, then makes them sum to one.
    """
    rows = F.array_sort(F.collect_list(F.struct("gameweek", *[F.col(m).cast("double").alias(m) for m in models])))
    one = errors.agg(rows.alias("s"))  # one row per gameweek of a season

    def step(acc: Column, i: Column) -> Column:
        lo = F.greatest(F.lit(1), i - recent + 1)
        mean = lambda m: F.aggregate(F.slice(F.col("s"), lo, i - lo + 1)[m], F.lit(0.0), lambda a, b: a + b) / (i - lo + 1)
        inverse = F.array(*[1 / (mean(m) + 1e-6) for m in models])
        old = lambda k: F.coalesce(F.try_element_at(acc, F.lit(-1))["w"][k], F.lit(1.0 / len(models)))
        moved = lambda v: F.array(*[old(k) * (1 - rate) + v[k] / total([v[j] for j in range(len(models))]) * rate for k in range(len(models))])
        even = lambda w: F.array(*[w[k] / total([w[j] for j in range(len(models))]) for k in range(len(models))])
        return F.concat(acc, F.array(F.struct(F.element_at(F.col("s"), i)["gameweek"].alias("gameweek"), bind(bind(inverse, moved), even).alias("w"))))

    kind = f"array<struct<gameweek:{dict(errors.dtypes)['gameweek']},w:array<double>>>"
    runs = one.select(F.explode(F.aggregate(F.sequence(F.lit(1), F.size("s")), F.array().cast(kind), step)).alias("x"))
    return runs.select("x.gameweek", *[F.col("x.w")[k].alias(m) for k, m in enumerate(models)])


def weighted(means: dict[str, float]) -> Column:
    """The weighted mean of model columns; a model without a forecast counts as 0. The weights sum to one and aren't negative."""
    if not means or min(means.values()) < 0 or abs(sum(means.values()) - 1) > 1e-6:
        raise ValueError("weights are at least 0 and sum to 1")
    return total([F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in means.items()])


def live_blend(enr_mean: Column, enr_var: Column, enr_down: Column, mv_mean: Column, mv_var: Column, recent: Column, news_availability: Column, *, alpha: float = 0.8) -> dict[str, Column]:
    """Forecast before a deadline: a fixed blend times the smaller of recent and reported availability, with floors."""
    avail = F.least(F.greatest(F.lit(0.05), recent), F.coalesce(news_availability, F.lit(1.0)))
    # the weights as decimals: 0.2, 0.64 and 0.04 for 0.8, not what differences and squares leave in their last bits
    rest = round(1 - alpha, 15)
    square, rest_square = round(alpha**2, 15), round(rest**2, 15)
    down = alpha * enr_down + rest * F.sqrt(F.greatest(mv_var, F.lit(0.0)) / 2)
    return {"mean": F.greatest(F.lit(0.0), (alpha * enr_mean + rest * mv_mean) * avail), "var": F.greatest(F.lit(0.1), (square * enr_var + rest_square * mv_var) * avail), "downside": F.greatest(F.lit(0.0), down * avail)}


