"""Player-fixture rows out of the star-schema test tables, which hold no match data of their own.

Every column is a fixed expression of ``events``, so that SQL can compute the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEWS = {"error": "Ruled out for 3 weeks", "click": "Doubtful for Saturday", "view": "Rotation risk", "signup": "Back in training", "purchase": ""}
STATUS = ["a", "a", "d", "i", "s", "u"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position_of(player: Column) -> Column:
    m = player % 15
    return F.when(m < 2, "GK").when(m < 7, "DEF").when(m < 12, "MID").otherwise("FWD")


def price_tenths_of(player: Column) -> Column:
    return 40 + (player * 7) % 41


def player_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per player and fixture."""
    player, event = F.col("user_id"), F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    happened = lambda kind: (F.col("event_type") == kind).cast("long")
    return table(spark, sf_dir, "events").select(
        player.alias("player_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").__add__(1).alias("gameweek"), event.alias("fixture_id"),
        position_of(player).alias("position"), (player % 20).alias("team"), price_tenths_of(player).alias("price_tenths"),
        F.floor(F.col("value") / 12).cast("long").alias("points"), F.when(k < 15, 0).otherwise(F.least(k, F.lit(90))).cast("long").alias("minutes"),
        happened("purchase").alias("goals"), happened("signup").alias("assists"), happened("view").alias("clean_sheets"), happened("error").alias("yellow_cards"),
        (k % 4).alias("bonus"), (k % 5).alias("saves"), (k % 3).alias("goals_conceded"), ((k % 10) / 10.0).alias("xG"), ((k % 7) / 10.0).alias("xA"), (k % 6).cast("double").alias("xP"),
        (event % 2).alias("was_home"), ((player + event) % 20 + 1).alias("opponent_team"), (40 + k % 5).alias("value"),
    )


def news_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: gameweek, player_id, news_text, status, chance (0 to 1 or null)."""
    k = F.get_json_object("props", "$.k").cast("long")
    text = F.create_map(*[F.lit(x) for pair in NEWS.items() for x in pair])[F.col("event_type")]
    chance = F.when(k % 5 == 0, F.lit(None).cast("double")).otherwise((k % 5) / 4.0)
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("player_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").__add__(1).alias("gameweek"),
        text.alias("news_text"), F.element_at(F.array(*map(F.lit, STATUS)), (k % 6 + 1).cast("int")).alias("status"), chance.alias("chance"),
    )


def team_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures between clubs: fixture_id, gameweek, team_h, team_a (two different clubs of 0 to 19)."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").filter(e % 25 == 0).select(
        e.alias("fixture_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").__add__(1).alias("gameweek"), (u % 20).alias("team_h"), ((u + 1 + e % 19) % 20).alias("team_a"),
    )
