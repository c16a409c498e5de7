"""The whole way from rows of play to a squad, for one coming gameweek."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline import fixed
from touchline.functions import news as nw
from touchline.functions.fusion import scale_by_fixtures
from touchline.operators import enriched, features, forecast, gameweek, learned, regressors, squad
from touchline.sources.readers import Config


class Model(Protocol):
    """A forecast: rows of play in, one row per player (player_id, mean, var, downside) out."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Signal(Protocol):
    """A number per row: a DataFrame in, the same with one more column out."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Optimizer(Protocol):
    """Candidates of any number of problems in, chosen players out."""

    def __call__(self, candidates: DataFrame, *, budget: float, cap: int) -> DataFrame: ...


def coming(rows: DataFrame) -> DataFrame:
    """``rows`` with one more row per player for the gameweek after the last of the table; of it only the place is known."""
    last = rows.agg(F.max("gameweek").alias("__last"))
    known = [c for c in ("position", "team", "price_tenths") if c in rows.columns]
    ahead = features.latest(rows).select("player_id", *known).crossJoin(F.broadcast(last)).withColumn("gameweek", F.col("__last") + 1).drop("__last")
    return rows.unionByName(ahead, allowMissingColumns=True)


def rolling(rows: DataFrame) -> DataFrame:
    last = features.latest(rows.withColumn("mean", F.avg("points").over(gameweek.in_order().rowsBetween(-4, 0))))
    return last.select("player_id", "mean", F.lit(4.0).alias("var"), F.lit(2.0).alias("downside"))


def scalar(rows: DataFrame, *, mode: str = "calibrated_alpha") -> DataFrame:
    """Filter and state model, fused."""
    out = forecast.next_forecast(forecast.series(rows), mode=mode)
    return out.select("player_id", F.greatest(F.lit(0.0), F.col("fused_mean")).alias("mean"), F.col("fused_var").alias("var"), F.sqrt(F.col("fused_var") / 2).alias("downside"))


def structural(rows: DataFrame) -> DataFrame:
    ahead = enriched.enriched(coming(rows))
    newest = ahead.groupBy("player_id").agg(F.max_by(F.struct("enr_mean", "enr_var", "enr_down"), "gameweek").alias("x"))
    return newest.select("player_id", F.col("x.enr_mean").alias("mean"), F.col("x.enr_var").alias("var"), F.col("x.enr_down").alias("downside"))


def blended(rows: DataFrame, *, news: DataFrame | None = None) -> DataFrame:
    """The structural forecast and the fitted state model at fixed weights, times availability. ``news`` has player_id and news_text."""
    ahead = coming(rows)
    last = ahead.groupBy("player_id").agg(F.max("gameweek").alias("gameweek"))
    fitted = learned.learn_positions(learned.windows(ahead, lookback=38).join(last, ["player_id", "gameweek"]))
    recent = features.latest(rows.withColumn("recent", F.avg((F.col("minutes") > 0).cast("double")).over(gameweek.in_order().rowsBetween(-2, 0)))).select("player_id", "recent")
    both = structural(rows).join(fitted, "player_id", "left").join(recent, "player_id", "left")
    both = both.withColumn("news_text", F.lit(None).cast("string")) if news is None else both.join(news.select("player_id", "news_text"), "player_id", "left")
    said = forecast.live_blend(F.col("mean"), F.col("var"), F.col("downside"), F.coalesce("mv_mean", "mean"), F.coalesce("mv_var", "var"), F.coalesce("recent", F.lit(1.0)), nw.availability(F.col("news_text")))
    return both.select("player_id", *[c.alias(n) for n, c in said.items()])


def _features(rows: DataFrame, columns: list[str] | None) -> tuple[DataFrame, list[str]]:
    wide = features.features(rows)
    return wide, columns or [c for c in features.feature_names() if c in wide.columns]


def regression(rows: DataFrame, *, kind: str = "ridge", columns: list[str] | None = None) -> DataFrame:
    """A regression of the next gameweek's points on the features of all players."""
    wide, columns = _features(rows, columns)
    known = wide.withColumn(regressors.TARGET, F.lead("points").over(gameweek.in_order()).cast("double"))
    model = regressors.fit(known, columns, kind=kind)
    said = regressors.predict(model, features.latest(wide), columns, as_="mean")
    return said.select("player_id", "mean", F.lit(4.0).alias("var"), F.lit(2.0).alias("downside"))


MODELS: dict[str, Model] = {"rolling": rolling, "scalar": scalar, "structural": structural, "blended": blended, "regression": regression}
OPTIMIZERS: dict[str, Optimizer] = {"exact": squad.exact, "greedy": squad.greedy_squad, "lagrangian": squad.lagrangian}


class SquadPlanner:
    """Rows of play, a model and the rules of a squad. Every step returns a DataFrame; nothing runs before it is asked for."""

    def __init__(self, rows: DataFrame, config: Config | None = None):
        self.rows, self.config = rows, config or Config()

    def forecast(self, model: str | Model = "structural", *, fixtures: DataFrame | None = None) -> DataFrame:
        """``fixtures`` has team_h and team_a of the coming gameweek; with it forecasts are scaled to each club's number of fixtures."""
        known = features.latest(self.rows).select("player_id", "position", "team", "price_tenths")
        out = (MODELS[model] if isinstance(model, str) else model)(self.rows).join(known, "player_id")
        if fixtures is None:
            return out
        counted = gameweek.upcoming_counts(out, fixtures)
        scaled = scale_by_fixtures(F.col("mean"), F.col("var"), F.col("downside"), F.col("n_fixtures"))
        return counted.withColumn("__s", scaled).withColumns({c: F.col(f"__s.{c}") for c in ("mean", "var", "downside")}).drop("__s")

    def candidates(self, forecasts: DataFrame, *, risk: float = 0.0, by: str = "downside") -> DataFrame:
        """``by`` is downside or var (whose root counts)."""
        penalty = F.col("downside") if by == "downside" else F.sqrt(F.greatest(F.col("var"), F.lit(0.0)))
        return forecasts.select(F.lit("squad").alias("problem"), "player_id", "position", "team", "price_tenths", (F.col("mean") - risk * penalty).alias("score"), "mean")

    def fit(self, path: str, *, kind: str = "ridge", columns: list[str] | None = None) -> DataFrame:
        """Fit the regression of the next gameweek's points and save it at ``path``; gives its forecasts of the coming gameweek. ``fitted`` reads it again."""
        wide, columns = _features(self.rows, columns)
        known = wide.withColumn(regressors.TARGET, F.lead("points").over(gameweek.in_order()).cast("double"))
        regressors.save(regressors.fit(known, columns, kind=kind), path)
        return self.fitted(path, kind=kind, columns=columns)(self.rows)

    @staticmethod
    def fitted(path: str, *, kind: str = "ridge", columns: list[str] | None = None) -> Model:
        """A saved regression as a model, for any later rows."""

        def forecast(rows: DataFrame) -> DataFrame:
            wide, names = _features(rows, columns)
            said = regressors.predict(regressors.load(path, kind=kind), features.latest(wide), names, as_="mean")
            return squad.with_spread(said.select("player_id", "mean"))

        return forecast

    @staticmethod
    def with_news(news: DataFrame) -> Model:
        """The blended model with what ``news`` (player_id, news_text, and gameweek where there are several) last said of each player."""
        last = news.groupBy("player_id").agg(F.max_by("news_text", "gameweek").alias("news_text")) if "gameweek" in news.columns else news
        return lambda rows: blended(rows, news=last)

    def backtest(self, path: str, **how) -> DataFrame:
        """Points and gaps of every strategy over all gameweeks. Results are kept by gameweek at ``path``: a run that broke off goes on there."""
        from touchline.plans import backtest

        return backtest.summary(backtest.run(self.rows, path, budget=self.config.get("budget", fixed.BUDGET), **how))

    def squad(self, model: str | Model = "structural", *, optimizer: str | Optimizer = "exact", risk: float = 0.0, fixtures: DataFrame | None = None) -> DataFrame:
        choose = OPTIMIZERS[optimizer] if isinstance(optimizer, str) else optimizer
        return choose(self.candidates(self.forecast(model, fixtures=fixtures), risk=risk), budget=self.config.get("budget", fixed.BUDGET), cap=self.config.get("club_cap", fixed.CLUB_CAP))
