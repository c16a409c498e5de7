import json

import pytest
from pyspark.sql import functions as F

from touchline.api import MODELS, SquadPlanner
from touchline.operators import squad as sq
from touchline.plans.series import weekly
from touchline.sources.readers import Config
from touchline.streaming import news


@pytest.fixture(scope="module")
def rows(spark):
    return weekly(spark, "/root/testdata/sf0.01").filter("gameweek <= 14").checkpoint()


@pytest.mark.parametrize("model", sorted(MODELS))
def test_every_model_forecasts_every_player(rows, model):
    got = SquadPlanner(rows).forecast(model)
    assert got.count() == rows.select("player_id").distinct().count() and got.filter("mean is null or mean < 0 or var is null").count() == 0


def test_planner_gives_a_legal_squad(spark, rows):
    plan = SquadPlanner(rows, Config({"budget": 70.0}))
    chosen = plan.squad(risk=0.5)
    known = plan.candidates(plan.forecast())
    r = sq.validate(chosen.join(known, ["problem", "player_id", "position"]), budget=70.0).first()
    assert r["quota_ok"] and r["formation_ok"] and r["budget_ok"] and r["club_ok"]


def test_clubs_without_fixtures_are_not_chosen_for_their_forecast(spark, rows):
    games = spark.createDataFrame([(t, t + 1) for t in range(0, 18, 2)], "team_h long, team_a long")
    got = SquadPlanner(rows).forecast(fixtures=games)
    assert got.filter("team >= 18 and mean != 0").count() == 0 and got.filter("n_fixtures = 1").count() > 0


def snapshot(week, player, text, ts):
    return json.dumps({"gameweek": week, "player_id": player, "news_text": text, "status": "d", "ts": ts})


def test_stream_keeps_the_newest_snapshots(spark, tmp_path):
    feed, table, marks = tmp_path / "feed", str(tmp_path / "table"), str(tmp_path / "marks")
    feed.mkdir()
    (feed / "a.json").write_text("\n".join([snapshot(1, 7, "Doubtful", "2024-01-01T10:00:00"), snapshot(1, 7, "Ruled out", "2024-01-02T10:00:00"), snapshot(2, 7, "", "2024-01-03T10:00:00")]))
    news.upsert(news.snapshots(spark, str(feed)), table, marks).awaitTermination()
    (feed / "b.json").write_text("\n".join([snapshot(1, 7, "Late and old", "2023-12-31T10:00:00"), snapshot(1, 8, "Fit", "2024-01-05T10:00:00"), json.dumps({"player_id": 9})]))
    news.upsert(news.snapshots(spark, str(feed)), table, marks).awaitTermination()
    got = {(r["gameweek"], r["player_id"]): r["news_text"] for r in spark.read.parquet(table).collect()}
    assert got == {(1, 7): "Ruled out", (1, 8): "Fit", (2, 7): ""}


def test_windowed_availability_drops_what_comes_too_late(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    rows = news.availability_by_window(news.snapshots(spark, str(feed)))
    (feed / "a.json").write_text("\n".join([snapshot(1, 1, "Ruled out", "2024-01-01T10:00:00"), snapshot(1, 2, "", "2024-01-01T11:00:00"), snapshot(1, 3, "", "2024-01-09T10:00:00")]))
    name = "availability"
    query = rows.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "m")).start()
    query.processAllAvailable()
    (feed / "b.json").write_text(snapshot(1, 4, "Ruled out", "2024-01-01T12:00:00"))
    query.processAllAvailable()
    query.stop()
    assert [(r["availability"], r["n"]) for r in spark.table(name).filter(F.col("start") < "2024-01-05").collect()] == [(0.5, 2)]
