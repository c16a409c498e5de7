import json

import pytest
from pyspark.sql import functions as F

from touchline.operators import gameweek as gk
from touchline.operators import quality
from touchline.sources import readers as rd

BOOT = {
    "elements": [
        {"id": 1, "web_name": "A", "team": 1, "element_type": 1, "now_cost": 45, "total_points": 10, "minutes": 90, "form": "2.5", "news": "", "status": "a", "chance_of_playing_next_round": None},
        {"id": 2, "web_name": "B", "team": 9, "element_type": 4, "now_cost": 101, "total_points": 3, "minutes": 9, "form": "x", "news": " Knock ", "status": "d", "chance_of_playing_next_round": 75, "chance_of_playing_this_round": 50},
        {"id": 3, "web_name": "C", "team": 1, "element_type": 3, "now_cost": 60, "news": None, "status": "u"},
    ],
    "teams": [{"id": 1, "name": "Reds"}],
    "events": [{"id": 1, "is_current": False, "is_next": False, "finished": True}, {"id": 2, "is_current": False, "is_next": True, "finished": False}],
}


@pytest.fixture()
def boot(spark, tmp_path):
    path = tmp_path / "boot.json"
    path.write_text(json.dumps(BOOT))
    return rd.bootstrap(spark, str(path))


def test_players_of_the_live_feed(boot):
    rows = {r["player_id"]: r for r in rd.bootstrap_players(boot, unknown_team="Unknown").collect()}
    assert rows[1]["team"] == "Reds" and rows[1]["price"] == 4.5 and rows[1]["availability"] == 1.0 and rows[1]["position"] == "GK" and rows[1]["form"] == 2.5
    assert rows[2]["team"] == "Unknown" and rows[2]["availability"] == 0.75 and rows[2]["form"] is None
    assert {r["player_id"] for r in rd.bootstrap_players(boot).collect()} == {1, 3}


@pytest.mark.parametrize("events, found", [(BOOT["events"], 2), ([{"id": 4, "is_current": True, "is_next": False, "finished": False}], 4), ([{"id": 7, "is_current": False, "is_next": False, "finished": True}], 8), ([], 1)])
def test_current_gameweek(spark, tmp_path, events, found):
    path = tmp_path / "b.json"
    path.write_text(json.dumps(BOOT | {"events": events}))
    row = rd.current_gameweek(rd.bootstrap(spark, str(path))).first()
    assert row["gameweek"] == found


def test_news_are_collected_written_and_replaced(spark, boot, tmp_path):
    path = str(tmp_path / "news")
    rd.write_news(rd.collect_news(boot, 3), path)
    rd.write_news(rd.collect_news(boot, 4), path)
    rd.write_news(rd.collect_news(boot, 3).filter("player_id = 2"), path)
    got = {(r["gameweek"], r["player_id"]) for r in rd.read_news(spark, path).collect()}
    assert got == {(3, 2), (4, 2), (4, 3)}
    row = rd.read_news(spark, path).filter("gameweek = 4 and player_id = 2").first()
    assert row["chance_this"] == 0.5 and row["chance_next"] == 0.75


CSV = "﻿element,name,position,GW,round,total_points,minutes,was_home,fixture,value,xP\n7,Ann,GKP,1,,5,90,True,11,45,1.5\n7,Ann,GKP,1,,2,n/a,False,12,46,\n8,Bo,Midfielder,,2,1,30,True,13,50,0.5\n,x,DEF,2,,1,1,True,14,50,1\n"


def test_season_files(spark, tmp_path):
    (tmp_path / "gw.csv").write_text(CSV, encoding="utf-8")
    rows = rd.season_rows(spark, str(tmp_path / "gw.csv"), "2023-24")
    got = sorted((r["player_id"], r["gameweek"], r["fixture_id"], r["points"], r["minutes"], r["was_home"], r["position"]) for r in rows.collect())
    assert got == [(7, 1, 11, 5.0, 90.0, 1.0, "GK"), (7, 1, 12, 2.0, None, 0.0, "GK"), (8, 2, 13, 1.0, 30.0, 1.0, "MID")]
    week = gk.per_gameweek(rows).filter("player_id = 7").first()
    assert (week["n_fixtures"], week["points"], week["minutes"], week["xP"], week["value"], week["points_norm"]) == (2, 7.0, 90.0, 1.5, 46.0, 3.5)
    player = rd.players_of(rows).filter("player_id = 7").first()
    assert (player["name"], player["position"], player["price_tenths"]) == ("Ann", "GK", 46.0)
    path = str(tmp_path / "season")
    rd.write_season(rows, path)
    plan = spark.read.parquet(path).filter("gameweek = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and spark.read.parquet(path).filter("gameweek = 1").count() == 2
    with pytest.raises(ValueError):
        rd.season_rows(spark, path, "2023-25")


@pytest.mark.parametrize("season, fine", [("2023-24", True), ("1999-00", True), ("2023-25", False), ("23-24", False), ("2023-2024", False)])
def test_season_names(season, fine):
    assert rd.valid_season(season) is fine


def test_histories_fill_in_for_players_without_one(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.json").write_text(json.dumps({"player_id": 1, "history": [{"round": 1, "total_points": 6, "minutes": 90, "expected_goals": "0.45", "was_home": True}, {"round": 2, "total_points": 1, "minutes": 10, "expected_goals": "bad"}]}))
    h = rd.histories(spark, str(tmp_path / "h"))
    assert [(r["gameweek"], r["points"], r["xG"], r["was_home"]) for r in h.orderBy("gameweek").collect()] == [(1, 6.0, 0.45, 1.0), (2, 1.0, None, None)]
    players = spark.createDataFrame([(1, "A"), (2, "B")], "player_id long, name string")
    got = sorted((r["player_id"], r["gameweek"], r["points"]) for r in rd.with_history(players, h, before=2).collect())
    assert got == [(1, 1, 6.0), (2, 0, 0.0)]


def test_settings(tmp_path):
    a = rd.Config({"news": {"doubtful": 0.35}, "boost": {"0": 10}})
    assert a.get("news.doubtful") == 0.35 and a.get("news.unavailable") == 0.1 and a.get("boost") == {0: 10} and a.get("no.such", 5) == 5
    a.set("features.windows", [2])
    a.save(str(tmp_path / "sub" / "c.json"))
    b = rd.Config.load(str(tmp_path / "sub" / "c.json"))
    assert b.values == a.values and rd.Config().get("features.windows") == [3, 5, 10]


def test_fixture_counts_default(spark):
    players = spark.createDataFrame([(1, 1), (2, 2)], "player_id long, team long")
    games = spark.createDataFrame([(1, 3), (3, 1)], "team_h long, team_a long")
    assert {r["player_id"]: r["n_fixtures"] for r in gk.upcoming_counts(players, games).collect()} == {1: 2, 2: 0}
    assert {r["player_id"]: r["n_fixtures"] for r in gk.upcoming_counts(players, games, absent=1).collect()} == {1: 2, 2: 1}


def test_quality(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (1, 2, float("nan"), "x"), (2, 1, 4.0, None)], "player_id long, gameweek long, a double, b string")
    got = {r["column"]: (r["missing"], r["too_many"]) for r in quality.quality_report(df).collect()}
    assert got == {"player_id": (0, False), "gameweek": (0, False), "a": (1, False), "b": (2, True)}
    assert quality.missing_percent(df).first()[0] == pytest.approx(25.0) and quality.missing_columns(df, ["a", "z"]) == ["z"]
    fill = lambda m: [r["a"] for r in quality.impute(df, ["a"], m).orderBy("player_id", "gameweek").collect()]
    assert fill("mean") == [1.0, 2.5, 4.0] and fill("median") == [1.0, 2.5, 4.0] and fill("zero") == [1.0, 0.0, 4.0] and fill("forward_fill") == [1.0, 1.0, 4.0] and fill("unheard of") == fill("mean")
    assert quality.impute(df.limit(0), ["a"]).count() == 0 and df.filter(F.col("a").isNull()).count() == 0


def test_metadata_and_results_come_back(spark, tmp_path):
    (tmp_path / "p.csv").write_text("﻿id,first_name\n007,Ann\n8,\n", encoding="utf-8")
    assert [tuple(r) for r in rd.player_metadata(spark, str(tmp_path / "p.csv")).orderBy("id").collect()] == [("007", "Ann"), ("8", None)]
    rows = spark.createDataFrame([("a", {"mean": 1.5}), ("b", None)], "strategy string, told map<string,double>")
    for _ in range(2):
        rd.write_results(rows, str(tmp_path / "out"))
    assert sorted(spark.read.schema(rows.schema).json(str(tmp_path / "out")).collect()) == sorted(rows.collect())


def test_played_rows_or_all(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 9), (1, 3, 90), (2, 1, 0), (2, 2, 9), (3, 1, None)], "player_id long, gameweek long, minutes long")
    assert sorted((r[0], r[1]) for r in gk.played(df).collect()) == [(1, 2), (1, 3), (2, 1), (2, 2), (3, 1)]
    got = {(r[0], r[1]): r["x"] for r in df.select("*", gk.played_before("gameweek").alias("x")).collect()}
    assert got == {(1, 1): [], (1, 2): [1.0], (1, 3): [1.0, 2.0], (2, 1): [], (2, 2): [1.0], (3, 1): []}
