"""Searches that meet every row in blocks: rows are dealt into shards, each shard meets all queries after its rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shards_for(rows: int, per_shard: int) -> int:
    return max(1, math.ceil(rows / per_shard))


def search_shards(rows: DataFrame, queries: DataFrame, shards: int, key: str, search: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``rows`` and ``queries`` share their columns, ``key`` among them. Each shard comes to ``search`` on its own as batches with
    column ``tag``: its rows first (0), then every query (1), which it can take batch by batch.

    Queries are copied once for each shard, which is the whole of the work that grows with both tables.
    """
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("tag", F.lit(1))
    together = dealt(rows, shards, key).withColumn("tag", F.lit(0)).unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "tag", key)
    return together.mapInPandas(one_by_one(search), schema)


def search_each(rows: DataFrame, shards: int, key: str, search: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Each shard of ``rows`` comes to ``search`` on its own; no copies of queries are shuffled, as ``search`` has its own way to them."""
    return dealt(rows, shards, key).repartition(shards, "shard").sortWithinPartitions("shard", key).mapInPandas(one_by_one(search), schema)


def dealt(rows: DataFrame, shards: int, key: str) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def one_by_one(search: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``search`` for each shard of a sorted partition."""

    def by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ahead: list[pd.DataFrame] = []

        def pieces() -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, part in pdf.groupby("shard", sort=False):
                    yield part

        source = pieces()

        def one(first: pd.DataFrame) -> Iterator[pd.DataFrame]:
            shard = first["shard"].iloc[0]
            yield first
            for part in source:
                if part["shard"].iloc[0] != shard:
                    ahead.append(part)
                    return
                yield part

        first = next(source, None)
        while first is not None:
            run = one(first)
            yield from search(run)
            for _ in run:
                pass
            first = ahead.pop() if ahead else next(source, None)

    return by_shard


def best(found: DataFrame, k: int, by_query: str, score: str, key: str) -> DataFrame:
    """The ``k`` best of each query over all shards, ties to the smaller key; adds rank from 1."""
    order = Window.partitionBy(by_query).orderBy(F.desc(score), F.col(key))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
