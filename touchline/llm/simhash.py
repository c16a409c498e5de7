"""SimHash near-duplicates through the pigeonring principle.

A text's fingerprint has the majority bit of the XXH64 hashes of its word shingles. The 64 bits lie on a ring of
``SEGMENTS`` segments. If two fingerprints differ in at most ``budget`` bits, then some chain of consecutive segments,
from its first segment on, stays within its proportional part of the budget at every length: with five segments and
four bits the first segment agrees, the first two differ by at most one bit, and so on. So each fingerprint is posted
under its segment i with every segment i+1 that is at most one bit away; fingerprints that meet under a key are the
candidates, the rest of the chain prunes them, and the full distance decides.

Rows with equal fingerprints are taken together first. A key's fingerprints are searched breadth first, each found one
leaving the list of the unreached, so a dense group of copies costs about its size and gives a spanning forest rather
than all its pairs; no link between different fingerprints is lost for the components. A key that too many fingerprints share is
extended along its chain. With four segments a key has at most 8192 owners, fingerprints whose own segments it holds, and of
every pair within the budget one is an owner of a key under which the other is posted. So there the owners alone are held and the others stream past
them, which bounds a task's memory however dense a group is.

Defined results: a null or blank text has fingerprint zero and links like any other; rows with a null id take part and
don't lower a component's id (a component of null ids alone has a null id); repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage
from .components import components

SEGMENTS = 5
#: Fingerprints posted at a time.
STEP = 5_000
#: Shingles whose bits are counted at a time, which bounds memory for very long texts.
BLOCK = 65_536


def bounds() -> list[tuple[int, int]]:
    """Lowest bit and width of each segment; the widths differ by one at most."""
    cuts = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def fingerprint(text: str | None, size: int = 4) -> int:
    """As an unsigned number. Bytes lower-case A-Z alone and split at ASCII white space alone."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(joined)]
    last = ends[size - 1 :] or [len(joined)]
    hashed, totals = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(last), BLOCK):
        some = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK], last[at : at + BLOCK])], ">u8")
        totals += np.unpackbits(some.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * totals > len(last)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, text_col: str = "text", size: int = 4) -> DataFrame:
    """``docs`` with ``fp``, the fingerprint as a signed BIGINT."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, size) for x in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(text_col))


def masks(width: int, most: int) -> list[int]:
    """Every choice of at most ``most`` of ``width`` bits."""
    return [sum(1 << b for b in some) for n in range(most + 1) for some in combinations(range(width), n)]


def _segment(fps: np.ndarray, i: int) -> np.ndarray:
    low, width = bounds()[i % SEGMENTS]
    return (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)


def posts(fps: np.ndarray, keys: np.ndarray | None, length: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints under keys of ``length`` segments: which segment comes first, and the chain's values, each fingerprint's own
    or as many bits away as the chain allows up to there. ``keys`` are those of one segment less; without them both first segments are posted."""
    if keys is None:
        fps, firsts = np.tile(fps, SEGMENTS), np.repeat(np.arange(SEGMENTS, dtype=np.uint64), len(fps))
        start = np.select([firsts == i for i in range(SEGMENTS)], [_segment(fps, i) for i in range(SEGMENTS)])
        keys, length = (firsts << np.uint64(60)) | start, 2
    first, used = (keys >> np.uint64(60)).astype(int), np.zeros(len(fps), int)
    slot = np.uint64(13 * (length - 1))
    out_keys, out_fps = [], []
    for i in range(SEGMENTS):
        mine = np.flatnonzero(first == i)
        if not len(mine):
            continue
        for n in range(length - 1):
            held = (keys[mine] >> np.uint64(13 * n)) & np.uint64(8191)
            used[mine] += np.bitwise_count(_segment(fps[mine], i + n) ^ held)
        width = bounds()[(i + length - 1) % SEGMENTS][1]
        for spent in np.unique(used[mine]):
            own = mine[used[mine] == spent]
            value = _segment(fps[own], i + length - 1)
            for flip in masks(width, length * budget // SEGMENTS - int(spent)):
                out_keys.append(keys[own] | ((value ^ np.uint64(flip)) << slot))
                out_fps.append(fps[own])
    return (np.concatenate(out_keys), np.concatenate(out_fps)) if out_keys else (keys[:0], fps[:0])


def _posted(length: int, budget: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wide = lambda x: x.to_numpy(np.int64).view(np.uint64)
        for pdf in batches:
            for at in range(0, len(pdf), STEP):
                part = pdf.iloc[at : at + STEP]
                keys, fps = posts(wide(part["fp"]), wide(part["key"]) if "key" in part else None, length, budget)
                if len(keys):
                    yield pd.DataFrame({"key": keys.view(np.int64), "fp": fps.view(np.int64), "own": owned(keys, fps) if length == SEGMENTS - 1 else False})

    return run


def chained(x: np.ndarray, first: int, budget: int) -> np.ndarray:
    """Whether differences ``x`` keep within the budget's part along the whole chain from segment ``first`` on."""
    total, fine = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for n in range(SEGMENTS):
        low, width = bounds()[(first + n) % SEGMENTS]
        total += np.bitwise_count((x >> np.uint64(low)) & np.uint64((1 << width) - 1))
        fine &= total * SEGMENTS <= (n + 1) * budget
    return fine


def forest(fps: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """Links that join exactly those of the distinct ``fps`` that paths of links join."""
    left, links = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(left ^ one) <= budget
            if near.any():
                queue.extend(left[near])
                links += [(int(one), int(y)) for y in left[near]]
                left = left[~near]
    return links


def _linked(budget: int, most: int):
    """Links among rows that come sorted by key. Of a key with more than ``most`` fingerprints the rows themselves come out (open),
    as soon as that is known; no more than that is held."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        key, spilling = None, False

        def frame(pairs: np.ndarray, open_: bool) -> pd.DataFrame:
            return pd.DataFrame(np.ascontiguousarray(pairs, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"]).assign(open=open_)

        def rows(k: int, fps: np.ndarray) -> pd.DataFrame:
            return frame(np.stack([np.full(len(fps), k, np.int64).view(np.uint64), fps], 1), True)

        def whole(k: int, fps: np.ndarray) -> Iterator[pd.DataFrame]:
            if len(fps) > most:
                yield rows(k, fps)
            elif len(fps) > 1 and (found := forest(fps, budget)):
                yield frame(found, False)

        for pdf in batches:
            if not len(pdf):
                continue
            keys, fps = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            if keys[0] != key:
                if held and not spilling:
                    yield from whole(key, np.concatenate(held))
                held, key, spilling = [], keys[0], False
            if spilling:
                yield rows(key, fps[: ends[0]])
            else:
                held.append(fps[: ends[0]])
                if sum(map(len, held)) > most:
                    yield rows(key, np.concatenate(held))
                    held, spilling = [], True
            if len(starts) > 1:
                if held and not spilling:
                    yield from whole(key, np.concatenate(held))
                inner = slice(1, -1)
                pairs = starts[inner][(ends - starts)[inner] == 2]
                x, y, first = fps[pairs], fps[pairs + 1], keys[pairs] >> 60
                fine = np.zeros(len(pairs), bool)
                for i in range(SEGMENTS):
                    here = first == i
                    fine[here] = chained(x[here] ^ y[here], i, budget)
                if fine.any():
                    yield frame(np.stack([x[fine], y[fine]], 1), False)
                for s, e in zip(starts[inner], ends[inner]):
                    if e - s > 2:
                        yield from whole(keys[s], fps[s:e])
                held, key, spilling = [fps[starts[-1] :]], keys[-1], False
        if held and not spilling:
            yield from whole(key, np.concatenate(held))

    return search


def owned(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """Whether each fingerprint's own first four segments are those of its key."""
    first, out = (keys >> np.uint64(60)).astype(int), np.ones(len(fps), bool)
    for i in range(SEGMENTS):
        here = first == i
        for n in range(SEGMENTS - 1):
            out[here] &= _segment(fps[here], i + n) == (keys[here] >> np.uint64(13 * n)) & np.uint64(8191)
    return out


#: Fingerprints that are compared with a key's owners at a time.
PASSING = 256


def _passing(budget: int):
    """Links among rows that come sorted by key, owners first: owners are held, the others pass by in blocks. Of the owners that
    one links to, one of each group that links already join is enough."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, owners, group = None, np.zeros(0, np.uint64), None

        def frame(pairs: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame(np.ascontiguousarray(pairs, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

        def close() -> Iterator[pd.DataFrame]:
            """Once all owners of a key are there: their own links."""
            nonlocal group
            if group is None and len(owners):
                found = forest(owners, budget)
                group = _groups(owners, found)
                if found:
                    yield frame(np.array(found, np.uint64))

        def pass_by(fps: np.ndarray) -> Iterator[pd.DataFrame]:
            for at in range(0, len(fps), PASSING):
                some = fps[at : at + PASSING]
                x, y = np.nonzero(np.bitwise_count(some[:, None] ^ owners[None, :]) <= budget)
                if len(x):
                    _, one = np.unique(x * len(owners) + group[y], return_index=True)
                    yield frame(np.stack([some[x[one]], owners[y[one]]], 1))

        for pdf in batches:
            if not len(pdf):
                continue
            keys, fps, own = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64), pdf["own"].to_numpy(bool)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if keys[s] != key:
                    yield from close()
                    key, owners, group = keys[s], np.zeros(0, np.uint64), None
                mine = own[s:e]
                owners = np.concatenate([owners, fps[s:e][mine]])
                if not mine.all() and len(owners):
                    yield from close()
                    yield from pass_by(fps[s:e][~mine])
        yield from close()

    return search


def _groups(owners: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    """A number for each owner, the same for those that links join."""
    place = {int(x): i for i, x in enumerate(owners)}
    up = list(range(len(owners)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in found:
        up[top(place[a])] = top(place[b])
    return np.array([top(i) for i in range(len(owners))], np.int64)


def links(fps: DataFrame, *, budget: int = 4, most: int = 16_384) -> DataFrame:
    """Links (a, b) between distinct fingerprints that leave the same components as all pairs within ``budget`` bits.

    A key that more than ``most`` fingerprints share is told apart by one more segment of the chain, and again. Tasks hold at most
    ``most`` fingerprints of a key, and of keys of four segments the owners, of which 8192 at most are different.
    """
    if not 0 <= budget < SEGMENTS:
        raise ValueError(f"the posted keys are complete for budgets of 0 to {SEGMENTS - 1} bits")
    rows, out = fps.select("fp").distinct(), None
    for length in range(2, SEGMENTS):
        last = length == SEGMENTS - 1
        keys = rows.mapInPandas(_posted(length, budget), "key long, fp long, own boolean").repartition("key")
        if last:
            here = cut_lineage(keys.sortWithinPartitions("key", F.desc("own"), "fp").mapInPandas(_passing(budget), "a long, b long"))
        else:
            found = cut_lineage(keys.sortWithinPartitions("key", "fp").mapInPandas(_linked(budget, most), "a long, b long, open boolean"))
            here = found.filter("not open").select("a", "b")
        out = here if out is None else out.unionByName(here)
        if last or found.filter("open").limit(1).count() == 0:
            break
        rows = found.filter("open").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    return out.distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` without its text, with ``fp`` and ``component_id``, the smallest id that a document reaches."""
    bounded_batches(docs.sparkSession)
    clash = [c for c in docs.columns if c in ("fp", "component_id")]
    rows = cut_lineage(fingerprints(docs.drop(*clash), text_col=text_col, size=size).drop(text_col))
    distinct = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(distinct, budget=budget))
    rooted = distinct.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


def hex_of(col: str):
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; rows that repeat it go too."""
    marked = docs.withColumn("__k", F.xxhash64(id_col, text_col)).withColumn("__i", F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    groups = near_duplicates(marked.select(F.col(id_col), F.col(text_col), "__k", "__i"), id_col=id_col, text_col=text_col, **how)
    order = F.struct(F.isnull(id_col), F.col(id_col), F.col("__k"))
    kept = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")).agg(F.min_by(F.struct("__k", "__i"), order).alias("kept")).select("kept.*")
    return marked.join(kept, ["__k", "__i"], "left_semi").dropDuplicates(["__k", "__i"]).drop("__k", "__i")
