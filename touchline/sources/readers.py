"""Readers for season files, live feeds and news, and their writers. Files are read with given schemas; text that is no number becomes null."""

from __future__ import annotations

import copy
import json
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchline import fixed

# Column names of season files and of the live history, and what they are called here.
SEASON_NAMES = {"total_points": "points", "goals_scored": "goals", "expected_goals": "xG", "expected_assists": "xA", "GW": "gameweek", "round": "gameweek"}
SEASON_COLUMNS = [
    "gameweek", "points", "minutes", "starts", "goals", "assists", "xG", "xA", "bonus", "bps", "clean_sheets", "goals_conceded", "saves", "yellow_cards", "red_cards", "own_goals", "penalties_missed", "penalties_saved", "influence", "creativity", "threat", "ict_index",
    "was_home", "opponent_team", "expected_goals_conceded", "xP", "value", "selected", "transfers_in", "transfers_out",
]
BOOTSTRAP = "elements array<struct<id:bigint,web_name:string,team:bigint,element_type:int,now_cost:int,total_points:double,minutes:double,form:string,news:string,status:string,chance_of_playing_this_round:double,chance_of_playing_next_round:double,news_added:string>>, teams array<struct<id:bigint,name:string>>, events array<struct<id:bigint,is_current:boolean,is_next:boolean,finished:boolean>>, fixtures array<struct<id:bigint,event:bigint,team_h:bigint,team_a:bigint>>"
FIXTURES = "id bigint, event bigint, kickoff_time string, team_h bigint, team_a bigint, team_h_difficulty int, team_a_difficulty int"
NEWS = "player_id bigint, news_text string, status string, chance_this double, chance_next double, ts string"


def valid_season(season: str) -> bool:
    """Whether a season is written like 2023-24."""
    m = re.fullmatch(r"(\d{4})-(\d{2})", season)
    return bool(m) and (int(m[1]) + 1) % 100 == int(m[2])


def number(c: Column | str) -> Column:
    """As DOUBLE; what is no number, and NaN, is null."""
    c = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.when(~F.isnan(c), c)


def truth(c: Column | str) -> Column:
    text = F.lower((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when(text.isin("true", "1", "1.0"), 1.0).when(text.isin("false", "0", "0.0"), 0.0)


def rename_and_merge(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; where several come to one name, the first that isn't null counts, from left to right."""
    by_name: dict[str, list[str]] = {}
    for c in df.columns:
        by_name.setdefault(names.get(c, c), []).append(c)
    return df.select([F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(n) for n, cs in by_name.items()])


def position(c: Column | str) -> Column:
    """GK, DEF, MID or FWD; MID for what isn't known."""
    names = F.create_map(*[F.lit(x) for pair in fixed.POSITION_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("MID"))


def season_rows(spark: SparkSession, paths: str | list[str], season: str) -> DataFrame:
    """Player-fixture rows of a season's CSV files: element, name, team, position and the statistics, in this order where they exist.

    Paths are tried by Spark's own reader, so any store will do; a byte-order mark before the first name is dropped.
    """
    if not valid_season(season):
        raise ValueError(f"a season is written like 2023-24, not {season!r}")
    raw = spark.read.csv(paths, header=True, encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    rows = rename_and_merge(raw, SEASON_NAMES)
    stats = [c for c in SEASON_COLUMNS if c in rows.columns]
    out = rows.select(
        F.lit(season).alias("season"), F.col("element").try_cast("long").alias("player_id"), *[c for c in ("name", "team") if c in rows.columns], position("position").alias("position") if "position" in rows.columns else F.lit("MID").alias("position"),
        *[(truth(c) if c == "was_home" else number(c)).alias(c) for c in stats], (F.col("fixture").try_cast("long") if "fixture" in rows.columns else F.lit(None).cast("long")).alias("fixture_id"),
    )
    return out.withColumn("gameweek", F.col("gameweek").cast("long")).filter("player_id is not null and gameweek is not null")


def player_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A season's table of players as it stands: every column as text, a byte-order mark before the first name dropped."""
    raw = spark.read.csv(paths, header=True, encoding="UTF-8")
    return raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])


def write_season(rows: DataFrame, path: str) -> None:
    """As Parquet by season and gameweek: a scan of one gameweek reads its folder alone. Gameweeks that are written again replace the old ones."""
    rows.repartition("season", "gameweek").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "gameweek").parquet(path)


def players_of(rows: DataFrame, key: str = "player_id", order: Iterable[str] = ("gameweek", "fixture_id")) -> DataFrame:
    """One row per player: name, team and position of the first row and the last price (tenths)."""
    at = F.struct(*order)
    firsts = [F.min_by(c, at).alias(c) for c in ("name", "team", "position") if c in rows.columns]
    return rows.groupBy(key).agg(*firsts, *([F.max_by("value", at).alias("price_tenths")] if "value" in rows.columns else []))


def bootstrap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOOTSTRAP).json(path, multiLine=True)


def bootstrap_players(boot: DataFrame, *, unknown_team: str | None = None) -> DataFrame:
    """Players with their club's name and availability. Without ``unknown_team`` players of unlisted clubs drop out."""
    e = boot.select(F.explode("elements").alias("e")).select("e.*")
    teams = boot.select(F.explode("teams").alias("t")).select(F.col("t.id").alias("team"), F.col("t.name").alias("team_name"))
    joined = e.join(teams, "team", "inner" if unknown_team is None else "left")
    chance = F.coalesce(F.col("chance_of_playing_next_round") / 100, F.lit(1.0))
    return joined.select(F.col("id").alias("player_id"), F.col("web_name").alias("name"), F.coalesce("team_name", F.lit(unknown_team)).alias("team"), position("element_type").alias("position"), F.col("now_cost").alias("price_tenths"), (F.col("now_cost") / 10).alias("price"), F.col("total_points").alias("points"), "minutes", number("form").alias("form"), "news", "status", chance.alias("availability"))


def current_gameweek(boot: DataFrame) -> DataFrame:
    """One row: the current gameweek, or the next, or the one after the last that ended, or 1."""
    e = boot.select(F.explode("events").alias("e")).select("e.*")
    return e.agg(F.coalesce(F.min(F.when(F.col("is_current"), F.col("id"))), F.min(F.when(F.col("is_next"), F.col("id"))), F.max(F.when(F.col("finished"), F.col("id"))) + 1, F.lit(1)).alias("gameweek"))


def histories(spark: SparkSession, path: str) -> DataFrame:
    """Player histories, one JSON document per player: {"player_id": .., "history": [..]}; statistics come as numbers or text."""
    names = [*SEASON_NAMES, *SEASON_COLUMNS]
    kind = ",".join(f"`{c}`:string" for c in dict.fromkeys(names) if c != "gameweek")
    h = spark.read.schema(f"player_id bigint, history array<struct<{kind}>>").json(path, multiLine=True).select("player_id", F.explode("history").alias("h")).select("player_id", "h.*")
    rows = rename_and_merge(h, SEASON_NAMES)
    return rows.select("player_id", F.col("gameweek").try_cast("long").alias("gameweek"), *[(truth(c) if c == "was_home" else number(c)).alias(c) for c in SEASON_COLUMNS if c in rows.columns and c != "gameweek"])


def with_history(players: DataFrame, history: DataFrame, *, before: int | None = None) -> DataFrame:
    """Players with their history before a gameweek; a player without any gets one row of zeros at gameweek 0."""
    past = history if before is None else history.filter(F.col("gameweek") < before)
    past = past.withColumn("__seen", F.lit(1))
    joined = players.join(past.select([c for c in past.columns if c == "player_id" or c not in players.columns]), "player_id", "left")
    numbers = [c for c in past.columns if c not in ("player_id", "__seen") and c not in players.columns]
    return joined.select(*[F.when(F.col("__seen").isNull(), F.lit(0)).otherwise(F.col(c)).cast(past.schema[c].dataType).alias(c) if c in numbers else F.col(c) for c in joined.columns if c != "__seen"])


def fixtures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FIXTURES).json(path, multiLine=True)


def collect_news(boot: DataFrame, gameweek: int) -> DataFrame:
    """Snapshots of all players with a text or a status other than available."""
    e = boot.select(F.explode("elements").alias("e")).select("e.*")
    rows = e.select(F.lit(gameweek).alias("gameweek"), F.col("id").alias("player_id"), F.coalesce("news", F.lit("")).alias("news_text"), F.coalesce("status", F.lit("a")).alias("status"), (F.col("chance_of_playing_this_round") / 100).alias("chance_this"), (F.col("chance_of_playing_next_round") / 100).alias("chance_next"), F.coalesce("news_added", F.lit("")).alias("ts"))
    return rows.filter((F.trim("news_text") != "") | (F.col("status") != "a"))


def write_news(snapshots: DataFrame, path: str) -> None:
    """As JSON by gameweek; collecting a gameweek again replaces it."""
    snapshots.repartition("gameweek").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gameweek").json(path)


def read_news(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{NEWS}, gameweek int").json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON, a line for each row, nested as they are and with their nulls; results there before are replaced."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def season_totals(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` players with the most points of a season, ties to the smaller id."""
    total = rows.groupBy("player_id").agg(F.sum("points").alias("total_points"))
    return total.orderBy(F.desc("total_points"), "player_id").limit(most)


def status_report(snapshots: DataFrame) -> DataFrame:
    """How many players have each status, and each status's place in the report: injured, suspended, unavailable, doubtful, not in squad, others."""
    place = F.array_position(F.array(*map(F.lit, "isudn")), F.col("status"))
    counted = snapshots.groupBy("status").agg(F.count("*").alias("n"))
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "status")).cast("long")).withColumn("place", F.when(place == 0, 6).otherwise(place).cast("long"))


def flagged(players: DataFrame, *, most_available: int = 15) -> DataFrame:
    """``players`` has player_id, status, news_text and total_points; those with news, ranked by points within their status."""
    news = players.filter((F.trim("news_text") != "") | (F.col("status") != "a"))
    ranked = news.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("total_points"), "player_id")).cast("long"))
    return ranked.filter((F.col("status") != "a") | (F.col("rank") <= most_available)).select("player_id", "status", "news_text", "total_points", "rank")


DEFAULTS = {"budget": fixed.BUDGET, "club_cap": fixed.CLUB_CAP, "features": {"windows": [3, 5, 10], "lags": [1, 2, 3], "alphas": [0.3, 0.5], "trends": [5, 10]}, "backtest": {"first": 6, "last": 38, "least_history": 5, "least_players": 50}, "news": dict(fixed.NEWS_LIMITS), "fusion": {"default_alpha": fixed.DEFAULT_ALPHA, "floor": fixed.ALPHA_FLOOR, "step": fixed.ALPHA_STEP, "history": fixed.ALPHA_HISTORY}}


class Config:
    """Nested settings with dotted names, over a copy of the defaults; keys that are whole numbers are numbers again after JSON."""

    def __init__(self, changes: dict | None = None):
        self.values = copy.deepcopy(DEFAULTS)
        self._merge(self.values, changes or {})

    def _merge(self, into: dict, changes: dict) -> None:
        for k, v in changes.items():
            k = int(k) if isinstance(k, str) and k.isdigit() else k
            if isinstance(v, dict):
                held = into.get(k)
                into[k] = held if isinstance(held, dict) else {}
                self._merge(into[k], v)
            else:
                into[k] = copy.deepcopy(v)

    def get(self, name: str, default=None):
        at = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value) -> None:
        *path, last = name.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w") as out:
            json.dump(self.values, out, indent=2)

    @classmethod
    def load(cls, path: str) -> Config:
        with open(path) as text:
            return cls(json.load(text))
