"""News as a stream: snapshots that arrive as files are kept, newest first, by gameweek and player.

An addition to the batch readers: it does continuously what collecting a gameweek again does by hand.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from touchline.functions import news

SNAPSHOT = "gameweek int, player_id bigint, news_text string, status string, chance_this double, chance_next double, ts timestamp"


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the JSON lines that appear below ``path``."""
    return spark.readStream.schema(SNAPSHOT).json(path)


def newest(rows: DataFrame) -> DataFrame:
    """The last snapshot of each gameweek and player; ties to the larger text."""
    order = Window.partitionBy("gameweek", "player_id").orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("news_text"))
    return rows.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


def upsert(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Merge a stream of snapshots into the table at ``path``, of which each batch rewrites only the gameweeks it touches.

    A batch that runs again gives the same table: the newest of what is there and what came is kept.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.filter("gameweek is not null and player_id is not null")
        weeks = [r[0] for r in batch.select("gameweek").distinct().collect()]  # a season has 38
        if not weeks:
            return
        try:
            held = spark.read.parquet(path).filter(F.col("gameweek").isin(weeks)).select(*batch.columns)
            # read whole before its folders are replaced
            both = newest(held.unionByName(batch)).checkpoint()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            both = newest(batch)
        both.repartition("gameweek").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gameweek").parquet(path)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def availability_by_window(stream: DataFrame, *, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Mean availability that texts report by window of event time; rows later than ``late`` are left out."""
    rows = stream.withWatermark("ts", late)
    return rows.groupBy(F.window("ts", length)).agg(F.avg(news.availability(F.col("news_text"))).alias("availability"), F.count("*").alias("n")).select("window.start", "window.end", "availability", "n")
