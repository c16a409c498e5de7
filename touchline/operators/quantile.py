"""Windows of a panel and regressions of quantiles on them.

A window is what a sequence model would read: the last ``encoder`` gameweeks of a player as arrays, and what is known of
the ``horizon`` to come. In place of a neural network, quantiles are linear in summaries of the window: each minimises its pinball
loss, by weighted least squares whose weights follow the last round's errors (a majorant of the loss, so it falls in every round). A round is one
pass over the windows, which brings all quantiles and cutoffs down to sums of products; only those reach the driver, whatever the rows.

Models know nothing after their cutoff: the model of a cutoff learns from targets up to it and forecasts those between it and the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

SHARES = (0.1, 0.5, 0.9)
#: What of a panel (``enriched.panel``) is seen up to the window's end, and what is known of the horizon too.
SEEN, KNOWN = ["xPts", "mins_frac", "news_sentiment", "actual_points"], ["fixture_difficulty", "is_home"]
FEATURES = ["one", "points_mean", "points_recent", "points_last", "points_sd", "xpts_mean", "minutes_mean", "minutes_last", "news_last", "difficulty", "home", "is_gk", "is_def", "is_fwd"]
#: Rows whose products are formed at a time.
BLOCK = 8_192


def windows(panel: DataFrame, *, encoder: int = 15, horizon: int = 1) -> DataFrame:
    """One row per group and time from which ``encoder`` rows before it and ``horizon`` rows from it on exist: group_id, time_idx,
    position, team, ``enc_<column>`` arrays in order, ``dec_<column>`` arrays of what is known, and ``target``, the outcomes (null where unknown)."""
    order = Window.partitionBy("group_id").orderBy("time_idx")
    before, after = order.rowsBetween(-encoder, -1), order.rowsBetween(0, horizon - 1)
    # collecting leaves nulls out, so each value is wrapped
    arrays = lambda c, over: F.transform(F.collect_list(F.struct(F.col(c).alias("v"))).over(over), lambda x: x["v"])
    out = panel.select("group_id", "time_idx", "position", "team", *[arrays(c, before).alias(f"enc_{c}") for c in [*SEEN, *KNOWN]], *[arrays(c, after).alias(f"dec_{c}") for c in KNOWN], arrays("actual_points", after).alias("target"))
    return out.filter((F.size("enc_xPts") == encoder) & (F.size("target") == horizon))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0))) / F.size(a)


def summaries(rows: DataFrame) -> DataFrame:
    """``rows`` of windows with ``x``, the summaries (``FEATURES``) of each, and ``y``, its first target."""
    pts, last = F.col("enc_actual_points"), lambda c: F.coalesce(F.element_at(c, -1), F.lit(0.0))
    recent = F.slice(pts, -F.least(F.lit(4), F.size(pts)), 4)
    mean = _mean(pts)
    spread = F.sqrt(F.greatest(F.lit(0.0), _mean(F.transform(pts, lambda v: v * v)) - mean * mean))
    at = lambda p: (F.col("position") == p).cast("double")
    first = lambda c: F.coalesce(F.element_at(c, 1), F.lit(0.0))
    x = [F.lit(1.0), mean, _mean(recent), last("enc_actual_points"), spread, _mean(F.col("enc_xPts")), _mean(F.col("enc_mins_frac")), last("enc_mins_frac"), last("enc_news_sentiment"), first("dec_fixture_difficulty"), first("dec_is_home"), at("GK"), at("DEF"), at("FWD")]
    return rows.withColumn("x", F.array(*x)).withColumn("y", F.element_at("target", 1))


def cutoffs(first: int, last: int, every: int) -> list[int]:
    return list(range(first, last, every))


def _sums(beta: dict[int, np.ndarray], shares: tuple[float, ...], smooth: float):
    """For each cutoff and quantile: the sums of products of the rows that it may learn from, one row a task."""
    p = len(next(iter(beta.values()))[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {c: np.zeros((len(shares), p * p + p + 1)) for c in beta}
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                x, y, t = np.stack(part["x"]), part["y"].to_numpy(float), part["time_idx"].to_numpy()
                for c, b in beta.items():
                    mine = t <= c
                    if not mine.any():
                        continue
                    xs, ys = x[mine], y[mine]
                    for q, share in enumerate(shares):
                        e = ys - xs @ b[q]
                        w = 1 / (smooth + np.abs(e))
                        wx = xs * w[:, None]
                        total[c][q, : p * p] += (xs.T @ wx).ravel()
                        total[c][q, p * p : -1] += wx.T @ ys + (2 * share - 1) * xs.sum(0)
                        total[c][q, -1] += (e * (share - (e < 0))).sum()
        yield pd.DataFrame([(c, q, i, v) for c, rows in total.items() for q, row in enumerate(rows) for i, v in enumerate(row)], columns=["cutoff", "q", "i", "v"])

    return run


def fit(rows: DataFrame, at: list[int], *, shares: tuple[float, ...] = SHARES, rounds: int = 30, smooth: float = 1e-3, ridge: float = 1e-6, tolerance: float = 1e-6) -> dict[int, np.ndarray]:
    """Coefficients by cutoff (quantiles x features). ``rows`` has time_idx, x and y; rows without y teach nothing, and a cutoff before any row
    has coefficients of 0. Sums by cutoff, quantile and product come to the driver, which solves systems of a dozen unknowns."""
    known = written(rows.filter("y is not null").select("time_idx", "x", "y"))
    p = len(FEATURES)
    beta = {c: np.zeros((len(shares), p)) for c in at}
    loss: dict[int, np.ndarray] = {}
    for n in range(rounds):
        # the first round takes all rows alike, as an ordinary regression does
        found = known.mapInPandas(_sums(beta, shares, smooth if n else 1e9), "cutoff int, q int, i int, v double").groupBy("cutoff", "q", "i").agg(F.sum("v").alias("v")).collect()
        table = {c: np.zeros((len(shares), p * p + p + 1)) for c in at}
        for r in found:
            table[r["cutoff"]][r["q"], r["i"]] = r["v"]
        now = {c: t[:, -1] for c, t in table.items()}
        if n > 1 and all((np.abs(loss[c] - now[c]) <= tolerance * (1 + np.abs(now[c]))).all() for c in at):
            break
        loss = now
        for c, t in table.items():
            for q in range(len(shares)):
                gram, cross = t[q, : p * p].reshape(p, p), t[q, p * p : -1]
                scale = np.trace(gram)
                if scale > 0:
                    if not n:  # with weights of 1e-9 the pull of the share would count for too much
                        cross = cross - (2 * shares[q] - 1) * gram[0] * 1e9
                    beta[c][q] = np.linalg.solve(gram + ridge * scale / p * np.eye(p), cross)
    return beta


def predict(rows: DataFrame, beta: dict[int, np.ndarray], *, names: tuple[str, ...] = ("p10", "p50", "p90")) -> DataFrame:
    """``rows`` whose time lies after the first cutoff with the quantiles of the last model before it: not below 0, and in order."""
    spark = rows.sparkSession
    at = sorted(beta)
    # a row for each cutoff
    models = F.broadcast(spark.createDataFrame([(c, d, beta[c].tolist()) for c, d in zip(at, [*at[1:], 1 << 30])], "after int, upto int, b array<array<double>>"))
    dot = lambda b: F.aggregate(F.zip_with("x", b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    out = rows.join(models, (F.col("time_idx") > F.col("after")) & (F.col("time_idx") <= F.col("upto")))
    out = out.withColumn("__q", F.array_sort(F.transform("b", lambda b: F.greatest(F.lit(0.0), dot(b)))))
    return out.withColumns({n: F.col("__q")[i] for i, n in enumerate(names)}).drop("__q", "b", "upto").withColumnRenamed("after", "cutoff")


def forecast(panel: DataFrame, *, encoder: int = 15, horizon: int = 1, every: int = 5, first: int | None = None, **how) -> DataFrame:
    """group_id, time_idx, cutoff, p10, p50, p90 and ``y`` for every window after the first cutoff; models are fitted anew each ``every`` gameweeks."""
    rows = written(summaries(windows(panel, encoder=encoder, horizon=horizon)).select("group_id", "time_idx", "x", "y"))
    span = rows.agg(F.min("time_idx").alias("a"), F.max("time_idx").alias("b")).first()
    if span["a"] is None:
        at = [0]
    else:
        at = cutoffs(first if first is not None else span["a"] + every - 1, max(span["b"], span["a"] + every), every)
    return predict(rows, fit(rows, at, **how)).drop("x")


def coverage(forecasts: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows and the shares of outcomes at or below each quantile, and the mean pinball loss over the quantiles."""
    pin = lambda c, s: F.greatest(s * (F.col("y") - F.col(c)), (s - 1) * (F.col("y") - F.col(c)))
    named = list(zip(("p10", "p50", "p90"), SHARES))
    rows = forecasts.filter("y is not null")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg((F.col("y") <= F.col(c)).cast("double")).alias(f"below_{c}") for c, _ in named], *[F.avg((F.col("y") < F.col(c)).cast("double")).alias(f"under_{c}") for c, _ in named], F.avg(sum((pin(c, s) for c, s in named), F.lit(0.0)) / len(named)).alias("loss"))
