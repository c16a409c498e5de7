"""Periodic runs of words, by comparing a text with itself at every lag.

A run is a stretch of consecutive words with smallest period q and length at least ``max(least, times * q)`` that no
neighbouring word extends keeping that period. For each lag p up to n / times the array of word ids is compared with
itself p places on; a run of period p is a stretch of equal places at least ``m = max(least - p, (times - 1) * p)`` long.
Such a stretch holds a multiple of ``m - GRAM + 1`` at which ``GRAM`` words in a row agree, so all lags of a text are compared in one
vectorised pass at those anchors (n log n of them), by rolling hashes that can only admit too much; the stretch around each anchor found is then
measured on the ids themselves. Its smallest period divides p, as the stretch has three periods or more, and anchors that a found run explains are
struck out at once, so a text that is one run costs no more than others.

Most texts are one task's work. A text of more than ``long_chars`` characters is dealt as ranges of lags to many tasks,
each with about the same number of anchors; their runs meet again by document.

Words are runs of other than ASCII white space. Defined results: a null, empty or blank text has no words and no runs;
rows that repeat give the same runs each; a null id is an id like any other; an empty table gives an empty result; columns of other names are left out
by ``periodic_runs`` and kept by ``collapse``. Memory: one text with a few arrays of 8 bytes a word, and ``ANCHORS`` anchors.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage

#: Words in a row that an anchor compares; a stretch is never shorter than twice as many with the least length of 24 and three periods.
GRAM = 8
#: Anchors compared at a time.
ANCHORS = 1 << 20
#: Ranges of lags of one text at most: a text has about as many anchors as words in each of them, so more copies of it would cost more than they save.
PARTS = 16
#: Multiplier of the rolling hashes (fixed value: an odd 64-bit number).
FACTOR = 0x9E3779B97F4A7C15
Run = tuple[int, int, int]  # start, length, period


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` (a power of two) ids in a row; equal rows have equal hashes."""
    h, width, factor = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1, FACTOR
    h ^= h >> np.uint64(29)
    while width < size:
        h = h[:-width] + h[width:] * np.uint64(factor)
        factor = factor * factor % (1 << 64)
        width *= 2
    return h


def lag_ranges(n: int, parts: int, times: int = 3) -> list[tuple[int, int]]:
    """Lags 1 to n / times as ranges (first, end) with about the same number of anchors, which fall as 1 / lag."""
    last = n // times
    edges = sorted({1, *(round(last ** (i / parts)) for i in range(1, parts)), last + 1})
    return list(zip(edges, edges[1:]))


def _reach(ids: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The stretch of places equal to those ``lag`` on, around ``at``: its first place and its end."""
    end, width = at, 64
    while end < len(ids) - lag:
        stop = min(end + width, len(ids) - lag)
        odd = np.flatnonzero(ids[end:stop] != ids[end + lag : stop + lag])
        if len(odd):
            end += int(odd[0])
            break
        end, width = stop, width * 4
    first, width = at, 64
    while first > 0:
        start = max(0, first - width)
        odd = np.flatnonzero(ids[start:first] != ids[start + lag : first + lag])
        if len(odd):
            first = start + int(odd[-1]) + 1
            break
        first, width = start, width * 4
    return first, end


def _smallest(ids: np.ndarray, start: int, end: int, lag: int) -> int:
    """The smallest period of a stretch that has period ``lag`` three times or more: a divisor of it."""
    small = [d for d in range(1, int(lag**0.5) + 1) if lag % d == 0]
    for d in [*small, *(lag // d for d in reversed(small))]:
        if d == lag or np.array_equal(ids[start : end - d], ids[start + d : end]):
            return d
    return lag


def runs_of(ids: np.ndarray, *, least: int = 24, times: int = 3, lags: tuple[int, int] | None = None) -> list[Run]:
    """Every run with a multiple of its period among ``lags`` (first, end), sorted by start and period; all runs without them.

    Runs whose period lies below the range may be found too, so ranges together give every run, some more than once."""
    if times < 3 or least < 2:
        raise ValueError("runs have at least three periods and two words")
    n = len(ids)
    first, end = lags or (1, n // times + 1)
    end = min(end, n // times + 1)
    if n < least or first >= end:
        return []
    every = np.arange(1, n // times + 1) if lags is None else np.arange(first, end)
    need = np.maximum(least - every, (times - 1) * every)
    # a stretch of m places has m - gram + 1 places in a row at which gram words agree
    gram = GRAM if need.min() >= GRAM else 1
    hashed = rolling(ids, gram)
    step = need - gram + 1
    count = np.maximum(0, -(-(len(hashed) - every) // step))
    found_at, found_lag = [], []
    upto = np.cumsum(count)
    begin = 0
    while begin < len(every):
        # at least one lag, and no more anchors than one lag or ANCHORS hold
        before = upto[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(upto, before + ANCHORS, side="right")))
        c = count[begin:stop]
        lag = np.repeat(every[begin:stop], c)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(c) - c, c)) * np.repeat(step[begin:stop], c)
        same = np.flatnonzero(hashed[at] == hashed[at + lag])
        found_at.append(at[same])
        found_lag.append(lag[same])
        begin = stop
    at, lag = np.concatenate(found_at), np.concatenate(found_lag)
    if not len(at):
        return []
    by_place = np.lexsort((lag, at))
    at, lag = at[by_place], lag[by_place]
    alive, found = np.ones(len(at), bool), set()
    for k in np.argsort(lag, kind="stable").tolist():
        if not alive[k]:
            continue
        p = int(lag[k])
        start, stop = _reach(ids, p, int(at[k]))
        stop += p
        lo, hi = np.searchsorted(at, [start, stop])
        if stop - start >= max(least, times * p):
            q = _smallest(ids, start, stop, p)
            found.add((start, stop - start, q))
        else:
            q = p
        # anchors inside at this lag, or at other multiples of a run's period, tell nothing new
        own, other = at[lo:hi], lag[lo:hi]
        told = (other == p) if q == p and stop - start < times * p else (other % q == 0)
        alive[lo:hi] &= ~(told & (own + other < stop))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length by period; ties to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of ``n`` words stay if of each run only its first period stays; a word goes if any run drops it."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


Plant = Callable[[int | None, list[bytes]], list[bytes]]


def as_is(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    return words


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of all documents (by the CRC of their id) go on periodically from some word on: known positives for a measurement."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _digest(words: list[bytes], runs: list[Run]) -> tuple:
    best = strongest(runs)
    text = b"".join(b"%d,%d,%d\n" % r for r in runs)
    keep = kept_words(len(words), runs)
    collapsed = b" ".join([w for w, k in zip(words, keep) if k] if runs else words)
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *told, hashlib.sha256(text).hexdigest(), hashlib.sha256(collapsed).hexdigest())


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUNS = "runs array<struct<start:long,length:long,period:long>>"


def _emitted(words: list[bytes], runs: list[Run], what: str) -> tuple:
    if what == "digest":
        return _digest(words, runs)
    if what == "text":
        keep = kept_words(len(words), runs)
        return (b" ".join([w for w, k in zip(words, keep) if k]).decode("utf-8", "replace") if runs else None,)
    return ([dict(zip(("start", "length", "period"), r)) for r in runs],)


OUT = {"digest": DIGEST, "text": "collapsed string", "runs": RUNS}


def _frame(rows: list[tuple], what: str, keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=keys + [c.split(" ")[0] for c in OUT[what].split(", ")], dtype=object)
    if what == "digest":
        out = out.astype({c: "Int64" for c in ("n_runs", "start", "length", "period", "exponent_milli")})
    return out.astype({c: "Int64" for c in keys})


def _whole(what: str, plant: Plant, least: int, times: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].astype("Int64"), pdf["text"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                words = plant(doc_id, split_words(text))
                rows.append((doc_id, *_emitted(words, runs_of(word_ids(words), least=least, times=times), what)))
            if rows:
                yield _frame(rows, what, ["doc_id"])

    return run


def _ranged(plant: Plant, least: int, times: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, doc_id, text, part, parts in zip(pdf["key"], pdf["doc_id"].astype("Int64"), pdf["text"], pdf["part"], pdf["parts"]):
                words = plant(None if pd.isna(doc_id) else int(doc_id), split_words(text))
                ranges = lag_ranges(len(words), int(parts), times)
                if part < len(ranges) and (found := runs_of(word_ids(words), least=least, times=times, lags=ranges[part])):
                    yield pd.DataFrame(found, columns=["start", "length", "period"]).assign(key=key)

    return run


def _rejoined(what: str, plant: Plant):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text, runs in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["runs"]):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                found = sorted(((r["start"], r["length"], r["period"]) for r in (runs if runs is not None else [])), key=lambda r: (r[0], r[2]))
                rows.append((doc_id, *_emitted(plant(doc_id, split_words(text)), found, what)))
            if rows:
                yield _frame(rows, what, ["doc_id"])

    return run


def _applied(docs: DataFrame, what: str, plant: Plant, least: int, times: int, long_chars: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    schema = f"doc_id long, {OUT[what]}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    short = rows.filter(size <= long_chars).mapInPandas(_whole(what, plant, least, times), schema)
    key = F.concat_ws(":", F.xxhash64("text"), F.hash("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("n")))
    large = rows.filter(size > long_chars).withColumn("key", key)
    parts = F.least(F.lit(PARTS), F.ceil(F.length("text") / F.lit(long_chars))).cast("int")
    dealt = large.dropDuplicates(["key"]).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = dealt.repartition("key", "part").mapInPandas(_ranged(plant, least, times), "start long, length long, period long, key string")
    # a run that several ranges find is the same row each time
    runs = cut_lineage(found.distinct().groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")))
    return short.unionByName(large.join(runs, "key", "left").select("doc_id", "text", "runs").mapInPandas(_rejoined(what, plant), schema))


def periodic_runs(docs: DataFrame, *, least: int = 24, times: int = 3, long_chars: int = 400_000) -> DataFrame:
    """doc_id and ``runs``, an array of (start, length, period) by start, then period, for each row of ``docs`` (doc_id, text)."""
    return _applied(docs, "runs", as_is, least, times, long_chars)


def digests(docs: DataFrame, *, plant: Plant = as_is, least: int = 24, times: int = 3, long_chars: int = 400_000) -> DataFrame:
    """doc_id, the number of runs, the strongest one, and hashes of all runs and of the words that collapsing them leaves."""
    return _applied(docs, "digest", plant, least, times, long_chars)


def collapse(docs: DataFrame, *, text_col: str = "text", least: int = 24, times: int = 3, collapsed_as: str = "collapsed") -> DataFrame:
    """``docs`` with ``collapsed``: the text with each run reduced to its first period, words one space apart; the text itself where it has no run."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def told(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            words = split_words(text)
            out.append(_emitted(words, runs_of(word_ids(words), least=least, times=times), "text")[0])
        return pd.Series(out, dtype=object)

    return docs.withColumn(collapsed_as, F.coalesce(told(text_col), F.col(text_col)))
