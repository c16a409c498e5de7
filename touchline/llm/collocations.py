"""Collocations by frequent phrases, with hashed buckets ahead of every exact count.

Pass k over the texts counts phrases of k words exactly and, in the same pass, adds up phrases of k + 1 words by
hash bucket. Before a phrase of k + 1 words is counted exactly its two parts of k words must be frequent (Apriori) and
its bucket must have reached the least count: both are looked up in bitmaps of ``1 << bits`` bits, which have the same size
whatever the input, so they can be broadcast. A bitmap can only admit too much, and what it admits is counted exactly,
so the counts of frequent phrases are exact at any size.

Phrases are split at their cuts by joins with the table of frequent phrases: parts of a frequent phrase are frequent.
Products are decimals of 38 digits, which hold 1000 * a * n for any corpus of up to 10**17 words.

Texts are lower-cased (A-Z alone), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words; no phrase crosses a
piece. Everything is counted by language. Defined results: a null text is empty; a null language is ``und``; rows that
repeat count each; an empty table gives an empty result; ties in score go to the more frequent, then by UTF-8 bytes.
Memory: the words of ``CHUNK`` words and one text, and two bitmaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage

#: Words that a task holds before it hands its counts on.
CHUNK = 1_000_000
LONGEST = 5
#: The end of a piece; the byte stands in no UTF-8 text.
EDGE = b"\xff"
PLAIN = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Multipliers of the phrase hashes (fixed values: odd 64-bit numbers).
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
UNKNOWN = "und"
#: Rows of language totals that may be broadcast.
FEW_LANGS = 10_000
COUNTS = "bucket int, lang string, phrase string, h long, n long"


def split_words(text: str | None) -> list[bytes]:
    """Words, with ``EDGE`` between pieces. Other control characters (\\x1c and the like) are part of words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).replace(EDGE, b" \xff ").split()


def phrase_hashes(words: np.ndarray, size: int, lang: int) -> np.ndarray:
    """A hash of every ``size`` words in a row, from the words' hashes."""
    n, factor = max(0, len(words) - size + 1), 1
    out = np.zeros(n, np.uint64)
    for i in range(size if n else 0):
        out += words[i : n + i] * np.uint64(factor)
        factor = factor * STEP % (1 << 64)
    out ^= np.uint64(lang)
    out *= np.uint64(MIX)
    return out ^ (out >> np.uint64(32))


class Bitmap:
    """``1 << bits`` bits, from rows (bucket number, bytes) as Spark's bitmap functions give them."""

    def __init__(self, rows: list, bits: int):
        self.held = np.zeros(max(1, (1 << bits) // 8), np.uint8)
        for number, part in rows:
            at = (number - 1) * 4096
            piece = np.frombuffer(part, np.uint8)[: len(self.held) - at]
            self.held[at : at + len(piece)] = piece
        self.mask = np.uint64((1 << bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def within(edges: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each place on hold no edge."""
    before = np.concatenate([[0], np.cumsum(edges)])
    return before[size:] == before[:-size] if len(before) > size else np.zeros(0, bool)


def distinct_phrases(ids: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct phrase among those that begin ``at``, and how often it does: told apart by ids, not by hashes."""
    key = ids[at]
    for i in range(1, size):
        key = key * (int(ids.max()) + 1) + ids[at + i]
        if i < size - 1:
            key = np.unique(key, return_inverse=True)[1]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return at[first], n


def _counted(size: int, bits: int, last: bool, frequent, admitted):
    """Rows of counts: phrases with their hash (bucket null), buckets of phrases that are one word longer (phrase null), and in the
    first pass all words of a language (both null)."""

    def chunk(lang: str, words: list[bytes]) -> Iterator[pd.DataFrame]:
        coded = pa.array(words, pa.large_binary()).dictionary_encode()
        ids, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)[ids]
        seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), 1)
        edges = ids == vocabulary.index(EDGE) if EDGE in vocabulary else np.zeros(len(ids), bool)
        own = phrase_hashes(hashed, size, seed)
        fine = within(edges, size)
        if size > 1:
            parts = frequent.value.has(phrase_hashes(hashed, size - 1, seed))
            fine = fine & parts[:-1] & parts[1:] & admitted.value.has(own)
        at = np.flatnonzero(fine)
        if size == 1:
            yield pd.DataFrame({"bucket": pd.Series([None], dtype="Int32"), "lang": lang, "phrase": None, "h": pd.Series([None], dtype="Int64"), "n": [len(at)]})
        if len(at):
            first, n = distinct_phrases(ids, at, size)
            told = [b" ".join([vocabulary[x] for x in row]).decode("utf-8", "surrogatepass") for row in ids[first[:, None] + np.arange(size)].tolist()]
            yield pd.DataFrame({"bucket": pd.Series([None] * len(n), dtype="Int32"), "lang": lang, "phrase": told, "h": (own[first] & np.uint64((1 << bits) - 1)).astype(np.int64), "n": n})
        if not last:
            longer = np.flatnonzero(fine[:-1] & fine[1:]) if len(fine) > 1 else at[:0]
            buckets, n = np.unique((phrase_hashes(hashed, size + 1, seed)[longer] & np.uint64((1 << bits) - 1)).astype(np.int32), return_counts=True)
            if len(n):
                yield pd.DataFrame({"bucket": buckets, "lang": None, "phrase": None, "h": pd.Series([None] * len(n), dtype="Int64"), "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[bytes]] = {}
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                words = held.setdefault(lang, [])
                words += split_words(text)
                words.append(EDGE)
                if len(words) >= CHUNK:
                    yield from chunk(lang, held.pop(lang))
            if sum(map(len, held.values())) >= 2 * CHUNK:
                for lang in list(held):
                    yield from chunk(lang, held.pop(lang))
        for lang, words in held.items():
            yield from chunk(lang, words)

    return run


def _bitmap(spark, places: DataFrame, bits: int):
    """``places`` (column ``at``) as a broadcast bitmap. At most 1 << bits bits come to the driver, in rows of 4096 bytes."""
    rows = places.groupBy(F.bitmap_bucket_number("at").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("part")).collect()
    # Spark numbers buckets from 1 and puts place 1 at bit 0, so places count from 1 here
    return spark.sparkContext.broadcast(Bitmap([(r["number"], bytes(r["part"])) for r in rows], bits))


def frequent_phrases(docs: DataFrame, *, least: int = 100, longest: int = LONGEST, bits: int = 22, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to ``longest`` words that occur at least ``least`` times in their language, as lang, size, phrase and f; and
    lang with n, all of its word occurrences."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang")).filter("text is not null")
    frequent, totals = None, None
    seen = admitted = None
    for size in range(1, longest + 1):
        last = size == longest
        counts = texts.mapInPandas(_counted(size, bits, last, seen, admitted), COUNTS)
        # a bucket's rows and a phrase's rows are summed in the same exchange
        every = F.col("bucket").isNull() & F.col("phrase").isNull()
        counts = cut_lineage(counts.groupBy("bucket", "lang", "phrase", "h").agg(F.sum("n").alias("n")).filter(every | (F.col("n") >= least)))
        if size == 1:
            totals = counts.filter(every).select("lang", "n")
        exact = counts.filter("phrase is not null")
        here = exact.select("lang", F.lit(size).alias("size"), "phrase", F.col("n").alias("f"))
        frequent = here if frequent is None else frequent.unionByName(here)
        if last:
            break
        seen = _bitmap(spark, exact.select((F.col("h") + 1).alias("at")), bits)
        admitted = _bitmap(spark, counts.filter("bucket is not null").select((F.col("bucket").cast("long") + 1).alias("at")), bits)
    return frequent, totals


def part(phrase, first, n):
    """``n`` words of an array from the ``first`` on, space-joined."""
    return F.array_join(F.slice(phrase, first, n), " ")


def scored(frequent: DataFrame, totals: DataFrame, *, shortest: int = 2) -> DataFrame:
    """lang, size, phrase, a, l, r, n, score of every frequent phrase of ``shortest`` words or more, by its lowest-scoring cut."""
    whole = frequent.filter(F.col("size") >= shortest).withColumn("w", F.split("phrase", " "))
    cuts = whole.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "size", "phrase", F.col("f").alias("a"), "k", part("w", F.lit(1), F.col("k")).alias("left"), part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = frequent.select("lang", "phrase", "f")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # a row for each language: sent to all tasks where their number is small, as a join by language alone would meet in few tasks
    cuts = cuts.join(F.broadcast(totals) if totals.limit(FEW_LANGS + 1).count() <= FEW_LANGS else totals, "lang")
    # a product of two counts has up to 34 digits, and with the factor 1000 up to 37
    wide = lambda c: F.col(c).cast("decimal(17,0)")
    cuts = cuts.withColumn("above", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)")).withColumn("below", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    lowest = cuts.groupBy("lang", "size", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    return lowest.select("lang", "size", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def maximal(found: DataFrame, *, shortest: int = 2, percent: int = 100) -> DataFrame:
    """``found`` without phrases that stand inside a longer one of it with at least ``percent`` / 100 of their count."""
    inner = found.filter(F.col("size") > shortest).select("lang", "a", "size", F.split("phrase", " ").alias("w")).withColumn("m", F.explode(F.sequence(F.lit(shortest), F.col("size") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1))).select("lang", part("w", F.col("i"), F.col("m")).alias("phrase"), F.col("a").alias("longer"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, *, least: int = 100, longest: int = LONGEST, bits: int = 22, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, size, phrase, a, l, r, n, score of all collocations."""
    frequent, totals = frequent_phrases(docs, least=least, longest=longest, bits=bits, text_col=text_col, lang_col=lang_col)
    return maximal(cut_lineage(scored(frequent, totals)))


def top_collocations(docs: DataFrame, *, k: int = 2000, **how) -> DataFrame:
    """The ``k`` best of each language, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = collocations(docs, **how).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
