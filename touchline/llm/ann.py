"""Approximate nearest neighbours by a permutation index.

Pivots are vectors drawn from the table (``pivots`` of them, the smallest by a hash: the bounded sample that the index is
fitted on). A vector is stood for by its ``prefix`` nearest pivots in order. In each shard the vectors are posted in
pivot inverted files with the place at which the pivot stands; a query walks the files of its own pivots and sums the
footrule distance (absolute differences of places, an absent pivot standing at place ``prefix``; of two vectors it is
the sum of both weights less twice their lesser one, a weight being ``prefix`` less the place). The candidates with
the smallest footrule, ``share`` of the shard whatever its size but more than ``k``, are ranked again by their exact
cosine on the original vectors.

Every vector is indexed; the best of all shards are merged by (score, id). Defined results: vectors that are null,
empty, zero or hold null or non-finite components, and rows with a null id, take no part; fewer candidates than
``k`` give them all; ties go to the smaller id; a query that repeats (id and vector) is asked once, one id with several vectors
once for each of them; candidates that repeat are found each; vectors of another length than most meet only their own kind (without
pivots of that length their own axes stand in).

Vectors without any structure are the worst case: in 64 independent dimensions the order of pivots tells little, so long prefixes
and three tenths of the shard are needed for the recall in small tables, and a query costs about as much as all products would. The fewer
dimensions the vectors really fill, the smaller ``share`` can be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import best, search_shards, shards_for


#: The part of a shard that is ranked exactly, set from recall measured with pruning on.
SHARE = 0.3


def candidate_count(rows: int, k: int, share: float = SHARE) -> int:
    return max(k + 1, math.ceil(share * rows))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: squares neither overflow nor vanish, and cosines stay the same to the bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


def places(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each (unit) vector in order."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Files:
    """One shard's pivot inverted files over vectors in the order of their ids: for each pivot a byte for each vector, ``prefix``
    less the pivot's place, 0 where it is absent. A quarter of all bytes isn't 0, so bytes take less room than posted pairs."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        vectors = scaled(vectors)
        self.ids, self.vectors, self.pivots = ids, vectors, pivots
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.prefix = min(prefix, len(pivots), 255)
        self.files = np.zeros((len(pivots), len(ids)), np.uint8)
        for at in range(0, len(ids), 1024):
            near = places(vectors[at : at + 1024] / self.norms[at : at + 1024, None], pivots, self.prefix)
            self.files[near, np.arange(at, at + len(near))[:, None]] = self.prefix - np.arange(self.prefix)

    def shared(self, near: np.ndarray) -> np.ndarray:
        """The footrule falls short of its largest value by twice this sum over the query's files: the lesser of both weights."""
        total, block, one = np.zeros(len(self.ids), np.uint16), np.empty(len(self.ids), np.uint8), np.empty(len(self.ids), np.uint8)
        together = max(1, 255 // self.prefix)  # as many as a byte holds
        for at in range(0, len(near), together):
            for i in range(at, min(at + together, len(near))):
                np.minimum(self.files[near[i]], np.uint8(self.prefix - i), out=block if i == at else one)
                if i > at:
                    np.add(block, one, out=block)
            total += block
        return total

    def candidates(self, near: np.ndarray, count: int, own: int | None = None) -> np.ndarray:
        """The ``count`` rows of the smallest footrule with another id than ``own``, ties to the smaller id."""
        others = np.flatnonzero(self.ids != own) if own is not None else np.arange(len(self.ids))
        return others[self._closest(self.shared(near)[others], count)]

    def _closest(self, shared: np.ndarray, count: int) -> np.ndarray:
        if count >= len(shared):
            return np.arange(len(shared))
        edge = np.partition(shared, len(shared) - count)[len(shared) - count]
        closer = np.flatnonzero(shared > edge)
        return np.concatenate([closer, np.flatnonzero(shared == edge)[: count - len(closer)]])

    def nearest(self, query: np.ndarray, own: int, rows: np.ndarray, k: int) -> list[tuple[int, float]]:
        rows = rows[self.ids[rows] != own]
        scores = (self.vectors[rows] * query).sum(1) / (self.norms[rows] * np.sqrt((query * query).sum()))
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return [(int(self.ids[rows[i]]), float(scores[i])) for i in order]


def search(rows: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, pivots: int = 256, prefix: int = 64, share: float = SHARE, per_shard: int = 8_192) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest of ``rows`` other than itself."""
    base, asked = usable(rows, id_col, vector_col), usable(queries, id_col, vector_col)
    asked = asked.withColumn("h", F.xxhash64("embedding").cast("string")).dropDuplicates(["vec_id", "h"])
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("embedding").toPandas()["embedding"].tolist()
    by_size: dict[int, np.ndarray] = {}
    for n in {len(v) for v in drawn}:
        unit = scaled(np.array([v for v in drawn if len(v) == n], float))
        by_size[n] = unit / np.sqrt((unit * unit).sum(1))[:, None]
    shards = shards_for(base.count(), per_shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        files: dict[int, Files] = {}
        for pdf in batches:
            out = []
            for tag, vec_id, v, h in zip(pdf["tag"], pdf["vec_id"], pdf["embedding"], pdf["h"]):
                if tag == 0:
                    held.setdefault(len(v), []).append((vec_id, v))
                    continue
                if held:
                    for n, pairs in held.items():
                        pivot = by_size.get(n, np.eye(n)[:pivots])
                        files[n] = Files(np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], float), pivot, prefix)
                    held = {}
                if own := files.get(len(v)):
                    query = scaled(np.array(v, float))
                    near = places((query / np.sqrt((query * query).sum()))[None, :], own.pivots, own.prefix)
                    out += [(vec_id, h, x, s) for x, s in own.nearest(query, vec_id, own.candidates(near[0], candidate_count(len(own.ids), k, share), vec_id), k)]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "h", "vec_id", "score"])

    found = search_shards(base.withColumn("h", F.lit(None).cast("string")), asked, shards, "vec_id", run, "query_id long, h string, vec_id long, score double")
    return best(found.withColumn("__q", F.struct("query_id", "h")), k, "__q", "score", "vec_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
