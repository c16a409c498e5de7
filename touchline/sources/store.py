"""Tables kept by player, so that what goes along a player's series needs no exchange.

Rows lie in buckets of their player's hash, sorted by player and gameweek, and in a folder per season. Windows, folds and joins by
player over such a table find their rows together (joins by player and gameweek too, where ``spark.sql.requireAllClusterKeysForCoPartition`` is off); a season's filter, or a join with few seasons, reads those folders alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, name: str, *, buckets: int = 64, season_col: str = "season", season: str = "all") -> None:
    """Write ``rows`` as the table ``name``, or replace in it the seasons that ``rows`` has. Tables that are joined share ``buckets``. Rows without a season column are of ``season``."""
    spark = rows.sparkSession
    rows = rows if season_col in rows.columns else rows.withColumn(season_col, F.lit(season))
    # dealt by the buckets' own hash, so each task writes whole buckets: one file for each bucket and season
    dealt = rows.repartition(buckets, "player_id").sortWithinPartitions(season_col, "player_id", "gameweek")
    writer = dealt.write.format("parquet").bucketBy(buckets, "player_id").sortBy("player_id", "gameweek").partitionBy(season_col)
    if not spark.catalog.tableExists(name):
        writer.saveAsTable(name)
        return
    # an insert into a table heeds the session's setting alone
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        dealt.select(*spark.table(name).columns).write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(setting, before)


def load(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
