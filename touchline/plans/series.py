"""Queries over one row per player and gameweek: aggregation, features, repairs, news and fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline import fixed
from touchline.functions import fixtures as fx
from touchline.functions import news
from touchline.functions.arrays import nearest
from touchline.functions.fusion import scale_by_fixtures
from touchline.operators import enriched as en
from touchline.operators import features as ft
from touchline.operators import gameweek as gk
from touchline.operators import metrics, quality, regressors
from touchline.sources import readers, tables

from . import sql as S
from .registry import query


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gk.per_gameweek(tables.player_fixture(spark, sf_dir))


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def nearest_of(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """As ``rounded``, with halves as the SQL has them."""
    return df.withColumns({c: nearest(F.col(c), digits) for c in columns})


def steady(df: DataFrame, columns: list[str]) -> DataFrame:
    """To six digits; a value just at a boundary is moved off it first, since engines differ there by their last bits."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in columns})


def features_of(spark: SparkSession, sf_dir: str, made: dict[str, Column], keep: list[str] = []) -> DataFrame:  # noqa: B006
    rows = weekly(spark, sf_dir).withColumn("__at", F.row_number().over(gk.in_order()))
    return rows.select("player_id", "gameweek", *keep, *[F.round(c.cast("double"), 6).alias(n) for n, c in made.items()])


_NORMS = [f"{c}_norm" for c in S.SUMMED]


@query(f"WITH {S.GW} SELECT player_id, gameweek, n_fixtures, {', '.join(S.SUMMED + S.LAST)}, {S.rounded(['xG', 'xA', 'xP'])}, {', '.join(f'round({c} / n_fixtures, 6) AS {c}_norm' for c in S.SUMMED)} FROM gw")
def dgw_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(weekly(spark, sf_dir), ["xG", "xA", "xP", *_NORMS])


@query(f"WITH {S.PF} SELECT player_id, gameweek, count(*) AS n_fixtures FROM pf GROUP BY ALL")
def fixture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gk.fixture_counts(tables.player_fixture(spark, sf_dir))


_TEAM_FIXTURES = f"tf AS (SELECT event_id AS fixture_id, {S.WEEK} AS gameweek, user_id % 20 AS team_h, (user_id + 1 + event_id % 19) % 20 AS team_a FROM events WHERE event_id % 25 = 0)"


@query(f"""WITH {S.PF}, {_TEAM_FIXTURES}, s AS (SELECT team_h AS team FROM tf WHERE gameweek = 10 UNION ALL SELECT team_a FROM tf WHERE gameweek = 10), n AS (SELECT team, count(*) AS n_fixtures FROM s GROUP BY ALL)
SELECT p.player_id, p.team, coalesce(n.n_fixtures, 0) AS n_fixtures FROM (SELECT DISTINCT player_id, team FROM pf) p LEFT JOIN n USING (team)""")
def upcoming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures of each player's club in gameweek 10."""
    players = tables.player_fixture(spark, sf_dir).select("player_id", "team").distinct()
    return gk.upcoming_counts(players, tables.team_fixtures(spark, sf_dir).filter("gameweek = 10")).select("player_id", "team", "n_fixtures")


@query(f"WITH {S.PF} SELECT player_id, gameweek, CAST(sum(points) AS BIGINT) AS actual_points FROM pf GROUP BY ALL")
def actual_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gk.actual_points(tables.player_fixture(spark, sf_dir))


@query(f"WITH {S.PF} SELECT player_id, gameweek, arg_max(was_home, fixture_id) AS was_home, arg_max(opponent_team, fixture_id) AS opponent_team, arg_max(xP, fixture_id) AS xP FROM pf GROUP BY ALL")
def fixture_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gk.fixture_info(tables.player_fixture(spark, sf_dir))


@query(f"""WITH {S.GW}, s AS (SELECT player_id, gameweek, row_number() OVER (PARTITION BY player_id ORDER BY gameweek) - 1 AS n_history FROM gw)
SELECT * FROM s WHERE n_history >= 5 QUALIFY count(*) OVER (PARTITION BY gameweek) >= 50""")
def valid_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gk.valid_players(weekly(spark, sf_dir)).select("player_id", "gameweek", F.col("n_history").cast("long").alias("n_history"))


@query(f"WITH {S.PF}, t AS (SELECT player_id, CAST(sum(points) AS BIGINT) AS total_points FROM pf GROUP BY ALL) SELECT * FROM t ORDER BY total_points DESC, player_id LIMIT 20")
def season_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.season_totals(tables.player_fixture(spark, sf_dir), 20)


@query(f"WITH {S.PF} SELECT player_id, arg_min(team, (gameweek, fixture_id)) AS team, arg_min(position, (gameweek, fixture_id)) AS position, arg_max(value, (gameweek, fixture_id)) AS price_tenths FROM pf GROUP BY ALL")
def player_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.players_of(tables.player_fixture(spark, sf_dir).drop("price_tenths"))


_FRAME = lambda n: f"(PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_AGG = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


@query(f"WITH {S.GW} SELECT player_id, gameweek, " + ", ".join(f"round(CAST({_AGG[f]}({c}) OVER {_FRAME(n)} AS DOUBLE), 6) AS {c}_rolling_{n}_{f}" for c in ("points", "minutes") for n in (3, 5, 10) for f in _AGG) + " FROM gw")
def rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(spark, sf_dir, ft.rolling(["points", "minutes"], functions=list(_AGG)))


@query(f"WITH {S.GW} SELECT player_id, gameweek, " + ", ".join(f"CAST(lag({c}, {k}) OVER w AS DOUBLE) AS {c}_lag_{k}" for c in ("points", "minutes") for k in (1, 2, 3)) + ", CAST(points - lag(points) OVER w AS DOUBLE) AS points_diff_1, CAST(minutes - lag(minutes) OVER w AS DOUBLE) AS minutes_diff_1 FROM gw WINDOW w AS (PARTITION BY player_id ORDER BY gameweek)")
def lag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features_of(spark, sf_dir, ft.lags(["points", "minutes"]) | ft.differences(["points", "minutes"]))


_AT = "a AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY gameweek) AS ix FROM gw)"


#: one row has no slope, which DuckDB gives as NaN
_SLOPE = lambda n: f"CASE WHEN isfinite(regr_slope(points, ix) OVER {_FRAME(n)}) THEN regr_slope(points, ix) OVER {_FRAME(n)} END"


@query(f"WITH {S.GW}, {_AT} SELECT player_id, gameweek, round({_SLOPE(5)}, 6) + 0.0 AS points_trend_5, round({_SLOPE(10)}, 6) + 0.0 AS points_trend_10 FROM a")
def trend_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features_of(spark, sf_dir, ft.trends(["points"]))
    return out.withColumns({c: F.col(c) + 0.0 for c in out.columns[2:]})


@query(f"WITH {S.GW} SELECT player_id, gameweek, " + ", ".join(f"round(stddev_samp({c}) OVER {_FRAME(5)} / (avg({c}) OVER {_FRAME(5)} + 1e-6), 4) AS {c}_consistency_5" for c in ("points", "minutes")) + " FROM gw")
def consistency_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = weekly(spark, sf_dir)
    return rows.select("player_id", "gameweek", *[F.round(c, 4).alias(n) for n, c in ft.consistency(["points", "minutes"]).items()])


_EWMA = "ew AS (SELECT player_id, gameweek, t, y AS y30, y AS y50 FROM o WHERE t = 0 UNION ALL SELECT o.player_id, o.gameweek, o.t, 0.3e0 * o.y + 0.7e0 * w.y30, 0.5e0 * o.y + 0.5e0 * w.y50 FROM ew w JOIN o ON o.player_id = w.player_id AND o.t = w.t + 1)"


@query(f"WITH RECURSIVE {S.OBS}, {_EWMA} SELECT player_id, gameweek, round(y30, 6) AS points_ewma_30, round(y50, 6) AS points_ewma_50 FROM ew")
def ewma_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.with_ewma(weekly(spark, sf_dir), ["points"])
    return rounded(out.select("player_id", "gameweek", "points_ewma_30", "points_ewma_50"), ["points_ewma_30", "points_ewma_50"])


@query(f"WITH {S.GW} SELECT player_id, gameweek, round(coalesce(avg(points) OVER (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 6) AS rolling, lag(points) OVER (PARTITION BY player_id ORDER BY gameweek) AS last_value FROM gw")
def rolling_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("player_id", "gameweek", F.round(ft.rolling_baseline(), 6).alias("rolling"), ft.last_value().alias("last_value"))


@query(f"WITH RECURSIVE {S.OBS}, {_EWMA} SELECT o.player_id, o.gameweek, round(coalesce(w.y30, 0), 6) AS ewma FROM o LEFT JOIN ew w ON w.player_id = o.player_id AND w.t = o.t - 1")
def ewma_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("player_id", "gameweek", F.round(ft.ewma_baseline(), 6).alias("ewma"))


@query(f"""WITH {S.GW}, {_AT}, f AS (SELECT player_id, gameweek, minutes, avg(points) OVER {_FRAME(5)} AS base, round({_SLOPE(5)}, 9) AS slope FROM a)
SELECT player_id, gameweek, round(greatest(0, base * CASE WHEN minutes < 60 THEN 0.7e0 ELSE 1e0 END * CASE WHEN slope > 0.5 THEN 1.1e0 WHEN slope < -0.5 THEN 0.9e0 ELSE 1e0 END), 6) AS form FROM f""")
def form_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form forecast made after each gameweek, for the next."""
    w = gk.in_order()
    rows = weekly(spark, sf_dir).withColumn("__at", F.row_number().over(w))
    slope = F.round(ft.trends(["points"], [5])["points_trend_5"], 9)
    return rows.select("player_id", "gameweek", F.round(ft.form_forecast(F.avg("points").over(w.rowsBetween(-4, 0)), F.col("minutes"), slope), 6).alias("form"))


_STATS = f"""f AS (SELECT player_id, gameweek, avg(points) OVER {_FRAME(5)} AS p, avg(xG) OVER {_FRAME(5)} AS g, avg(xA) OVER {_FRAME(5)} AS x, stddev_samp(minutes) OVER {_FRAME(5)} / (avg(minutes) OVER {_FRAME(5)} + 1e-6) AS cv, {_SLOPE(5)} AS slope FROM a)"""


@query(f"""WITH {S.GW}, {_AT}, {_STATS} SELECT player_id, gameweek, round(greatest(0, 0.3e0 * p + 1.5e0 * g + 1.5e0 * x + coalesce(2e0 / (1 + cv), 0) + coalesce(greatest(0, slope), 0)), 6) AS signal
FROM f QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY gameweek DESC) = 1""")
def stats_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's score from its latest features."""
    last = ft.latest(ft.features(weekly(spark, sf_dir), alphas=[0.3]))
    return last.select("player_id", "gameweek", F.round(ft.stats_signal(F.col), 6).alias("signal"))


_AHEAD_ROWS = f"""last AS (SELECT player_id, max(gameweek) AS gameweek, arg_max(points, gameweek) AS points FROM gw GROUP BY ALL),
r AS (SELECT player_id, gameweek, points, 0 AS ahead FROM gw UNION ALL SELECT player_id, gameweek + i, points, i FROM last, (VALUES (1), (2)) v(i))"""


@query(f"""WITH {S.GW}, {_AHEAD_ROWS}, f AS (SELECT *, avg(points) OVER {_FRAME(3)} AS a, stddev_samp(points) OVER {_FRAME(5)} AS b, lag(points, 2) OVER (PARTITION BY player_id ORDER BY gameweek) AS c FROM r)
SELECT player_id, gameweek, ahead, round(a, 6) AS points_rolling_3_mean, round(b, 6) AS points_rolling_5_std, CAST(c AS DOUBLE) AS points_lag_2 FROM f WHERE ahead > 0""")
def future_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ft.future_features(weekly(spark, sf_dir), 2, columns=["points"])
    return rounded(out.select("player_id", "gameweek", "ahead", "points_rolling_3_mean", "points_rolling_5_std", "points_lag_2"), ["points_rolling_3_mean", "points_rolling_5_std"])


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gameweeks with gaps: minutes divisible by 7 and points of 3 count as unknown."""
    w = weekly(spark, sf_dir)
    return w.select("player_id", "gameweek", F.when(F.col("minutes") % 7 != 0, F.col("minutes")).cast("double").alias("minutes"), F.when(F.col("points") != 3, F.col("points")).cast("double").alias("points"))


_GAPPY = f"{S.GW}, g AS (SELECT player_id, gameweek, CAST(CASE WHEN minutes % 7 <> 0 THEN minutes END AS DOUBLE) AS minutes, CAST(nullif(points, 3) AS DOUBLE) AS points FROM gw)"


@query(f"WITH {_GAPPY} SELECT player_id, gameweek, round(coalesce(minutes, (SELECT avg(minutes) FROM g)), 6) AS minutes, round(coalesce(points, (SELECT avg(points) FROM g)), 6) AS points FROM g")
def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.impute(gappy(spark, sf_dir), ["minutes", "points"]), ["minutes", "points"])


@query(f"WITH {_GAPPY} SELECT player_id, gameweek, round(coalesce(minutes, (SELECT quantile_cont(minutes, 0.5) FROM g)), 6) AS minutes, round(coalesce(points, (SELECT quantile_cont(points, 0.5) FROM g)), 6) AS points FROM g")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.impute(gappy(spark, sf_dir), ["minutes", "points"], "median"), ["minutes", "points"])


@query(f"WITH {_GAPPY} SELECT player_id, gameweek, last_value(minutes IGNORE NULLS) OVER w AS minutes, last_value(points IGNORE NULLS) OVER w AS points FROM g WINDOW w AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def impute_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.impute(gappy(spark, sf_dir), ["minutes", "points"], "forward_fill")


@query(f"WITH {_GAPPY} SELECT player_id, gameweek, coalesce(minutes, 0) AS minutes, coalesce(points, 0) AS points FROM g")
def impute_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.impute(gappy(spark, sf_dir), ["minutes", "points"], "zero")


@query(f"WITH {_GAPPY} SELECT c AS \"column\", n AS rows, m AS missing, round(m * 100e0 / n, 6) AS percent, m * 100e0 / n > 20 AS too_many FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) AS n, count(*) - count({c}) AS m FROM g" for c in ("player_id", "gameweek", "minutes", "points")) + ")")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.quality_report(gappy(spark, sf_dir), most_missing=20.0), ["percent"])


@query(f"WITH {S.PF} SELECT fixture_id, TRY_CAST(t AS DOUBLE) AS number, CASE position WHEN 'GK' THEN 'GK' WHEN 'DEF' THEN 'DEF' WHEN 'FWD' THEN 'FWD' ELSE 'MID' END AS position FROM (SELECT fixture_id, position, CASE WHEN minutes % 3 = 0 THEN 'n/a' ELSE minutes::VARCHAR END AS t FROM pf)")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text that is no number becomes null; long names of positions become short ones."""
    rows = tables.player_fixture(spark, sf_dir)
    text = F.when(F.col("minutes") % 3 == 0, "n/a").otherwise(F.col("minutes").cast("string"))
    long_name = F.when(F.col("position") == "GK", "Goalkeeper").when(F.col("position") == "DEF", "2").when(F.col("position") == "FWD", "Forward").otherwise("unknown")
    return rows.select("fixture_id", readers.number(text).alias("number"), readers.position(long_name).alias("position"))


@query(f"WITH {S.SIGNAL} SELECT event_id, player_id, gameweek, availability, minutes_risk, confidence, round(availability * (1 - minutes_risk), 6) AS adjustment FROM sig")
def news_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("news_text")
    return tables.news_snapshots(spark, sf_dir).select("event_id", "player_id", "gameweek", news.availability(t).alias("availability"), news.minutes_risk(t).alias("minutes_risk"), news.confidence(t).alias("confidence"), F.round(news.adjustment(t), 6).alias("adjustment"))


_CATEGORY = "CASE WHEN availability <= 0.1 THEN 'unavailable' WHEN availability <= 0.6 THEN 'doubtful' WHEN minutes_risk >= 0.5 THEN 'rotation' WHEN availability >= 0.85 AND availability < 1 AND minutes_risk <= 0.1 THEN 'positive' ELSE 'neutral' END"


@query(f"WITH {S.SIGNAL} SELECT event_id, {_CATEGORY} AS category FROM sig")
def news_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("news_text")
    return tables.news_snapshots(spark, sf_dir).select("event_id", news.category(news.availability(t), news.minutes_risk(t)).alias("category"))


_WORD = "CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.STATUS_WORDS.items()) + " END"


@query(f"WITH {S.NEWS} SELECT event_id, concat_ws('. ', nullif(trim(news_text), ''), CASE WHEN {_WORD} IS NOT NULL AND NOT contains(lower(news_text), {_WORD}) THEN 'Status: ' || {_WORD} END, CASE WHEN chance < 1 THEN CAST(trunc(chance * 100) AS INT)::VARCHAR || '% chance of playing' END) AS text FROM news WHERE trim(news_text) <> '' OR status <> 'a'")
def snapshot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.news_snapshots(spark, sf_dir).filter((F.trim("news_text") != "") | (F.col("status") != "a"))
    return rows.select("event_id", news.snapshot_text(F.col("news_text"), F.col("status"), F.col("chance")).alias("text"))


@query(f"WITH {S.NEWS}, c AS (SELECT status, count(*) AS n FROM news GROUP BY ALL) SELECT status, n, row_number() OVER (ORDER BY n DESC, status) AS rank, CAST(coalesce(list_position(['i', 's', 'u', 'd', 'n'], status), 6) AS BIGINT) AS place FROM c")
def status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.status_report(tables.news_snapshots(spark, sf_dir))


@query(f"""WITH {S.NEWS}, {S.PF}, n AS (SELECT player_id, arg_max(status, event_id) AS status, arg_max(news_text, event_id) AS news_text FROM news GROUP BY ALL), p AS (SELECT player_id, CAST(sum(points) AS BIGINT) AS total_points FROM pf GROUP BY ALL)
SELECT player_id, status, news_text, total_points, row_number() OVER (PARTITION BY status ORDER BY total_points DESC, player_id) AS rank FROM n JOIN p USING (player_id) WHERE trim(news_text) <> '' OR status <> 'a' QUALIFY status <> 'a' OR row_number() OVER (PARTITION BY status ORDER BY total_points DESC, player_id) <= 15""")
def flagged_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players with news by status, best scorers first; of the available ones the first fifteen."""
    last = tables.news_snapshots(spark, sf_dir).groupBy("player_id").agg(F.max_by("status", "event_id").alias("status"), F.max_by("news_text", "event_id").alias("news_text"))
    total = tables.player_fixture(spark, sf_dir).groupBy("player_id").agg(F.sum("points").alias("total_points"))
    return readers.flagged(last.join(total, "player_id"))


@query(f"""WITH {_TEAM_FIXTURES}, s AS (SELECT gameweek, team_h AS team, team_a AS opponent, TRUE AS home FROM tf UNION ALL SELECT gameweek, team_a, team_h, FALSE FROM tf),
d AS (SELECT team, gameweek, avg(CASE WHEN home THEN greatest(1e0, opponent % 5 + 0.5e0) ELSE least(5e0, opponent % 5 + 1.5e0) END) AS difficulty FROM s GROUP BY ALL)
SELECT team, gameweek, round(difficulty, 6) AS difficulty, round(greatest(0, least(1, (6 - difficulty) / 5)), 6) AS advantage FROM d""")
def fixture_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty and advantage of each club's fixtures in a gameweek; a club's rating is its number modulo 5, plus 1."""
    t = tables.team_fixtures(spark, sf_dir)
    sides = t.select("gameweek", F.explode(F.array(F.struct(F.col("team_h").alias("team"), F.col("team_a").alias("opponent"), F.lit(True).alias("home")), F.struct(F.col("team_a").alias("team"), F.col("team_h").alias("opponent"), F.lit(False).alias("home")))).alias("s")).select("gameweek", "s.*")
    d = sides.groupBy("team", "gameweek").agg(F.collect_list(F.col("opponent") % 5 + 1).alias("ratings"), F.collect_list("home").alias("homes")).withColumn("d", fx.difficulty(F.col("ratings"), F.col("homes")))
    return d.select("team", "gameweek", F.round("d", 6).alias("difficulty"), F.round(fx.advantage(F.col("d")), 6).alias("advantage"))


@query(f"""WITH {_TEAM_FIXTURES}, s AS (SELECT team_h AS team FROM tf WHERE gameweek <= 7 UNION ALL SELECT team_a FROM tf WHERE gameweek <= 7)
SELECT team, count(*) AS games, round(greatest(0, least(1, (count(*) / 2e0 - 1) / 2)), 6) AS congestion FROM s GROUP BY ALL""")
def fixture_congestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.team_fixtures(spark, sf_dir).filter("gameweek <= 7")
    games = t.select(F.explode(F.array("team_h", "team_a")).alias("team")).groupBy("team").agg(F.count("*").alias("games"))
    return games.withColumn("congestion", F.round(fx.congestion(F.col("games")), 6))


@query("WITH d AS (SELECT event_id, 0.5e0 + (event_id % 51) / 10e0 AS difficulty FROM events), c AS (SELECT *, least(5e0, greatest(1e0, difficulty)) AS x FROM d) SELECT event_id, round(CASE WHEN x < 2 THEN 0.8e0 + 0.1e0 * (x - 1) WHEN x < 3 THEN 0.9e0 + 0.1e0 * (x - 2) WHEN x < 4 THEN 1e0 + 0.2e0 * (x - 3) ELSE 1.2e0 + 0.3e0 * (x - 4) END, 6) AS factor FROM c")
def fixture_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "events").select("event_id", F.round(fx.noise_factor(0.5 + (F.col("event_id") % 51) / 10.0), 6).alias("factor"))


@query(f"WITH {S.XP} SELECT player_id, gameweek, round(xpts, 6) + 0.0 AS xpts FROM xp")
def xpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return en.with_expected_points(weekly(spark, sf_dir)).select("player_id", "gameweek", (F.round("xpts", 6) + 0.0).alias("xpts"))


@query(f"WITH {S.GW},{S.FACTORS} SELECT player_id, gameweek, {S.rounded(['home_factor', 'away_factor', 'opponent_factor'])} FROM fac")
def venue_and_opponent(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weekly(spark, sf_dir)
    out = w.withColumns(en.venue_factors(w)).withColumn("opponent_factor", en.opponent_factor(w))
    return rounded(out.select("player_id", "gameweek", "home_factor", "away_factor", "opponent_factor"), ["home_factor", "away_factor", "opponent_factor"])


@query(f"WITH {S.GW}, a AS (SELECT player_id, gameweek, avg(CAST(minutes > 0 AS INT)) OVER (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS s FROM gw) SELECT player_id, gameweek, round(CASE WHEN s IS NULL THEN 1 WHEN s = 0 THEN 0.05e0 ELSE s END, 6) AS availability FROM a")
def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select("player_id", "gameweek", F.round(gk.availability(), 6).alias("availability"))


@query(f"WITH {S.ENRICHED} SELECT player_id, gameweek, {S.steady(['enr_mean', 'enr_var', 'enr_down'])} FROM enr")
def enriched_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steady(en.enriched(weekly(spark, sf_dir)).select("player_id", "gameweek", "enr_mean", "enr_var", "enr_down"), ["enr_mean", "enr_var", "enr_down"])


@query(f"WITH {S.ENRICHED}, n AS (SELECT player_id, gameweek, count(*) AS n FROM pf GROUP BY ALL) SELECT e.player_id, e.gameweek, n % 3 AS n, round(CASE WHEN n % 3 = 0 THEN 0e0 ELSE enr_mean * (n % 3) END + 1e-9, 6) AS mean, round(CASE WHEN n % 3 = 0 THEN 0.1e0 ELSE enr_var * (n % 3) END + 1e-9, 6) AS var, round(CASE WHEN n % 3 = 0 THEN 0e0 ELSE enr_down * sqrt(n % 3) END + 1e-9, 6) AS downside FROM enr e JOIN n ON n.player_id = e.player_id AND n.gameweek = e.gameweek")
def dgw_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of one fixture scaled to the gameweek's number of fixtures (here modulo 3)."""
    e = en.enriched(weekly(spark, sf_dir)).withColumn("n", F.col("n_fixtures") % 3)
    return steady(e.select("player_id", "gameweek", "n", scale_by_fixtures(F.col("enr_mean"), F.col("enr_var"), F.col("enr_down"), F.col("n")).alias("s")).select("player_id", "gameweek", "n", "s.*"), ["mean", "var", "downside"])


@query(f"WITH {S.XP} SELECT player_id::VARCHAR AS group_id, gameweek::INT AS time_idx, position, team::VARCHAR AS team, 3e0 AS fixture_difficulty, was_home::DOUBLE AS is_home, round(xpts, 6) + 0.0 AS xPts, round(least(1e0, greatest(0e0, minutes / 90e0)), 6) AS mins_frac, 0e0 AS news_sentiment, points::DOUBLE AS actual_points FROM xp")
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = en.panel(weekly(spark, sf_dir))
    return rounded(out, ["xPts", "mins_frac"]).withColumn("xPts", F.col("xPts") + 0.0)


@query(f"""WITH {S.GW}, n AS (SELECT player_id, gameweek, row_number() OVER (PARTITION BY player_id ORDER BY gameweek) - 1 AS i, count(*) OVER (PARTITION BY player_id) AS n FROM gw),
f AS (SELECT DISTINCT player_id, n, unnest(range(0, 1 + CAST(floor((n - 12) / 3e0) AS BIGINT))) AS fold FROM n WHERE n >= 12)
SELECT n.player_id, n.gameweek, fold, CASE WHEN i < fold * 3 + 10 THEN 'train' ELSE 'test' END AS role FROM f JOIN n ON n.player_id = f.player_id AND i BETWEEN fold * 3 AND fold * 3 + 11""")
def rolling_cv_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.folds(weekly(spark, sf_dir).select("player_id", "gameweek"), train=10, test=2, step=3).select("player_id", "gameweek", F.col("fold").cast("long").alias("fold"), "role")


@query(f"WITH {S.GW}, n AS (SELECT *, count(*) FILTER (minutes > 0) OVER (PARTITION BY player_id) AS n FROM gw) SELECT player_id, gameweek, points, minutes FROM n WHERE minutes > 0 OR n < 2")
def played_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gk.played(weekly(spark, sf_dir)).select("player_id", "gameweek", "points", "minutes")


@query(f"""WITH {S.GW}, h AS (SELECT player_id, gameweek, coalesce(list(CAST(points AS DOUBLE)) OVER w, []) AS a, coalesce(list(CAST(points AS DOUBLE)) FILTER (minutes > 0) OVER w, []) AS p FROM gw WINDOW w AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT player_id, gameweek, CASE WHEN len(p) >= 2 THEN p ELSE a END AS u FROM h)
SELECT player_id, gameweek, round(coalesce(list_avg(u[-5:]), 0) + 1e-9, 6) AS mean FROM u""")
def played_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last five gameweeks played before each."""
    rows = weekly(spark, sf_dir).select("player_id", "gameweek", gk.played_before().alias("past"))
    last = F.slice("past", F.greatest(F.lit(1), F.size("past") - 4), 5)
    mean = F.when(F.size(last) > 0, F.aggregate(last, F.lit(0.0), lambda a, b: a + b) / F.size(last)).otherwise(0.0)
    return steady(rows.select("player_id", "gameweek", mean.alias("mean")), ["mean"])


@query(f"""WITH {S.GW}, b AS (SELECT points, coalesce(avg(points) OVER (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS mean FROM gw)
SELECT count(*) AS n, round(avg((mean - points) ** 2) + 1e-9, 6) AS mse, round(avg(CAST(least(4, floor(mean / 2)) = least(4, floor(points / 2e0)) AS DOUBLE)) + 1e-9, 6) AS state_accuracy FROM b""")
def state_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the rolling baseline tells points, and their state of five by steps of two points."""
    state = lambda c: F.least(F.lit(4), F.floor(F.col(c) / 2))
    rows = weekly(spark, sf_dir).select(F.col("points").alias("truth"), ft.rolling_baseline().alias("mean"))
    return steady(metrics.state_metrics(rows.withColumns({"state": state("mean"), "true_state": state("truth")})), ["mse", "state_accuracy"])


@query(f"""WITH {S.GW}, b AS (SELECT points, coalesce(avg(points) OVER w, 0) AS mean, row_number() OVER (PARTITION BY player_id ORDER BY gameweek) - 13 AS fold FROM gw WINDOW w AS (PARTITION BY player_id ORDER BY gameweek ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT fold, count(*) AS n, round(sqrt(avg((mean - points) ** 2)) + 1e-9, 6) AS rmse, round(avg(abs(mean - points)) + 1e-9, 6) AS mae FROM b WHERE fold >= 0 GROUP BY fold""")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling baseline's errors by fold."""
    rows = weekly(spark, sf_dir).select("player_id", "gameweek", F.col("points").alias("actual"), ft.rolling_baseline().alias("predicted"))
    tests = ft.folds(rows, train=12, test=1, step=1).filter("role = 'test'")
    return steady(regressors.fold_metrics(tests.withColumn("fold", F.col("fold").cast("long"))), ["rmse", "mae"])
