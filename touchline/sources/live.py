"""Player histories as a data source: one JSON file per player, looked for in several places in turn.

``spark.read.format("player_history")`` after ``register(spark)``. Options: ``tiers``, folders separated by ``;`` in the order in which they
are tried (a local copy, a cache, a mirror; any file system that pyarrow opens), ``players``, ids separated by commas (without it every
``<id>.json`` of the tiers), and ``files_per_task``. A player whose file no tier has, or has whole, gives one row with ``error`` and no values, so one bad
file fails neither its task nor the others', and ``refreshed`` keeps that player's old series.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "player_id long, round int, total_points double, minutes double, was_home boolean, opponent_team int, kickoff_time string, value double, tier int, error string"
#: Fields of a record as the feed names them.
FIELDS = {"round": int, "total_points": float, "minutes": float, "was_home": bool, "opponent_team": int, "kickoff_time": str, "value": float}


def opened(folder: str):
    """A file system and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def listed(folder: str) -> set[int]:
    """Ids of the players whose files a tier has; none where the folder is missing or can't be listed."""
    from pyarrow import fs

    try:
        system, path = opened(folder)
        files = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    except OSError:
        return set()
    return {int(stem) for f in files if f.path.endswith(".json") and (stem := PurePosixPath(f.path).stem).isdigit()}


def records(raw: bytes) -> list[tuple]:
    """Values of a file's records; ValueError where it isn't a history."""
    found = json.loads(raw)
    rows = found.get("history") if isinstance(found, dict) else None
    if not isinstance(rows, list):
        raise ValueError("no history in the file")
    return [tuple(None if r.get(c) is None else kind(r[c]) for c, kind in FIELDS.items()) for r in rows]


class Files(InputPartition):
    def __init__(self, players: list[int]):
        self.players = players


class HistoryReader(DataSourceReader):
    def __init__(self, tiers: list[str], players: list[int] | None, files_per_task: int):
        self.tiers, self.players, self.files_per_task = tiers, players, files_per_task

    def partitions(self) -> list[Files]:
        ids = sorted(set(self.players) if self.players is not None else set().union(*map(listed, self.tiers)))
        return [Files(ids[i : i + self.files_per_task]) for i in range(0, len(ids), self.files_per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        systems = [opened(t) for t in self.tiers]
        for player in partition.players:
            said = []
            for n, (system, path) in enumerate(systems):
                try:
                    with system.open_input_file(f"{path.rstrip('/')}/{player}.json") as f:
                        rows = records(f.read())
                except (OSError, ValueError, TypeError, AttributeError) as e:
                    said.append(f"{self.tiers[n]}: {type(e).__name__}: {e}"[:200])
                    continue
                yield from ((player, *r, n, None) for r in rows)
                break
            else:
                yield (player, *[None] * (len(FIELDS) + 1), "; ".join(said))


class PlayerHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "player_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        tiers = [t for t in self.options.get("tiers", "").split(";") if t]
        if not tiers:
            raise ValueError("option tiers names at least one folder")
        players = self.options.get("players")
        return HistoryReader(tiers, None if players is None else [int(x) for x in players.split(",") if x.strip()], int(self.options.get("files_per_task", "64")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlayerHistory)


def histories(spark: SparkSession, tiers: list[str], *, players: list[int] | None = None, files_per_task: int = 64) -> DataFrame:
    register(spark)
    reader = spark.read.format("player_history").option("tiers", ";".join(tiers)).option("files_per_task", files_per_task)
    return (reader if players is None else reader.option("players", ",".join(map(str, players)))).load()


def refreshed(held: DataFrame, read: DataFrame) -> DataFrame:
    """``held`` with the series of every player that was read whole replaced by what was read; the others' stay, failed ones among them."""
    new = read.filter("error is null").select(*held.columns)
    return held.join(new.select("player_id").distinct(), "player_id", "left_anti").select(*held.columns).unionByName(new)


def failures(read: DataFrame) -> DataFrame:
    return read.filter("error is not null").select("player_id", "error")
