"""Tiers of a live source, and tables by player whose windows and joins need no exchange."""

import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import features
from touchline.plans.series import weekly
from touchline.sources import live, store


def file(folder, player, rounds, raw=None):
    folder.mkdir(exist_ok=True)
    (folder / f"{player}.json").write_text(raw if raw is not None else json.dumps({"history": [{"round": r, "total_points": r + player, "minutes": 90, "was_home": r % 2 == 0, "value": None} for r in rounds]}))


@pytest.fixture()
def tiers(tmp_path):
    near, cache, mirror = tmp_path / "near", tmp_path / "cache", tmp_path / "mirror"
    file(near, 1, [1, 2])
    file(near, 2, [], raw="{ broken")
    file(cache, 1, [9])
    file(cache, 2, [3])
    file(mirror, 3, [4, 5, 6])
    file(mirror, 4, [], raw='{"detail": "not found"}')
    return [str(near), str(cache), f"file://{mirror}", str(tmp_path / "nowhere")]


@pytest.mark.parametrize("files_per_task", [1, 64])
def test_tiers_fall_back_and_failures_are_rows(spark, tiers, files_per_task):
    df = live.histories(spark, tiers, players=[1, 2, 3, 4, 5], files_per_task=files_per_task)
    assert df.rdd.getNumPartitions() == (5 if files_per_task == 1 else 1)
    rows = {(r["player_id"], r["round"], r["total_points"], r["tier"]) for r in df.filter("error is null").collect()}
    assert rows == {(1, 1, 2.0, 0), (1, 2, 3.0, 0), (2, 3, 5.0, 1), (3, 4, 7.0, 2), (3, 5, 8.0, 2), (3, 6, 9.0, 2)}
    bad = {r["player_id"]: r["error"] for r in live.failures(df).collect()}
    assert set(bad) == {4, 5} and "no history" in bad[4] and bad[5].count(";") == 3


def test_all_files_of_the_tiers_are_found(spark, tiers):
    assert {r["player_id"] for r in live.histories(spark, tiers).collect()} == {1, 2, 3, 4}
    assert live.histories(spark, tiers[-1:]).count() == 0
    with pytest.raises(Exception, match="tiers"):
        live.histories(spark, []).count()


def test_failed_players_keep_their_old_series(spark, tiers):
    held = spark.createDataFrame([(1, 7, 70.0), (4, 7, 74.0), (6, 1, 1.0)], "player_id long, round int, total_points double")
    got = live.refreshed(held, live.histories(spark, tiers, players=[1, 3, 4]))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 2.0), (1, 2, 3.0), (3, 4, 7.0), (3, 5, 8.0), (3, 6, 9.0), (4, 7, 74.0), (6, 1, 1.0)]


@pytest.fixture()
def table(spark):
    spark.sql("DROP TABLE IF EXISTS by_player")
    store.save(weekly(spark, "/root/testdata/sf0.001"), "by_player", buckets=4, season="2023-24")
    store.save(weekly(spark, "/root/testdata/sf0.001").limit(50).withColumn("season", F.lit("2024-25")), "by_player", buckets=4)
    yield "by_player"
    spark.sql("DROP TABLE by_player")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_and_joins_over_a_table_by_player_take_no_exchange(spark, table):
    rows = store.load(spark, table).filter("season = '2023-24'")
    assert rows.count() == weekly(spark, "/root/testdata/sf0.001").count()
    by_player = Window.partitionBy("player_id").orderBy("gameweek")
    last = rows.groupBy("player_id").agg(F.max("gameweek").alias("last"))
    # as large tables are joined: without broadcasts, and by what both sides are dealt by
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        wide = features.features(rows.drop("season"))
        assert "Exchange" not in plan(wide)
        held = wide.cache()
        held.count()
        both = rows.withColumn("before", F.lag("points").over(by_player)).join(last, "player_id")
        assert "Exchange" not in plan(both) and both.count() == rows.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
    plain = features.features(weekly(spark, "/root/testdata/sf0.001"))
    assert "Exchange" in plan(plain) and held.select(*plain.columns).exceptAll(plain).count() == 0
    held.unpersist()


def test_seasons_are_read_and_replaced_alone(spark, table):
    one = store.load(spark, table).filter("season = '2024-25'")
    assert one.count() == 50 and "PartitionFilters: [isnotnull(season" in plan(one)
    few = spark.createDataFrame([("2024-25", 1)], "season string, wanted int")
    pruned = store.load(spark, table).join(F.broadcast(few.filter("wanted = 1")), "season")
    assert "dynamicpruning" in plan(pruned).lower() and pruned.count() == 50
    before = store.load(spark, table).filter("season = '2023-24'").count()
    store.save(one.limit(7).checkpoint(), table, buckets=4)
    assert before > 300 and store.load(spark, table).filter("season = '2024-25'").count() == 7 and store.load(spark, table).filter("season = '2023-24'").count() == before
