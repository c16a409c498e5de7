"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

Each source has a weight that moves linearly from ``w_start`` to ``w_end`` over training time 0..1. The integral of
that schedule is its share of all words; a source gives at most ``repeats`` times its own words, and what exceeds that
is shared again by weight. A source's documents stand in the order of a hash; the words before a document are its
place in the source's cumulative demand, and inverting the integrated schedule there gives its training position.
Documents are finally sorted by position over ranges.

The prefix sums are taken in two levels (hash buckets of a source, then documents of a bucket), so a source that holds
a third of all rows is spread over thousands of groups. Only one row per source meets in one task.

Defined results: a null text has size 0 and takes nothing; null is a source of its own and comes last; repeated rows
count each for itself; an empty table gives an empty result; other columns are carried along unchanged, but for those of the names added
(size, source_size, target, taken, position, ordinal_words, and names that begin with two underscores).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, word_count

#: Bits of the MD5 hash of a document's id and text that order a source's documents; any engine can compute them.
HASH_BITS = 48
WORK = ["__key", "__h", "__bucket", "__before"]
#: What ``emit`` needs besides, under names of its own.
PLAN = {"quota": "__quota", "w_start": "__w_start", "w_end": "__w_end"}


def cycling_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by code point with null last; the schedules fall, stay level and rise in turn."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = (rank % 3 + 1).cast("double")
    tilt = (rank % 3 - 1) * 0.5
    return sources.withColumn("w_start", weight * (1 - tilt)).withColumn("w_end", weight * (1 + tilt))


def targets(sizes: DataFrame, weights: Callable[[DataFrame], DataFrame], repeats: int) -> DataFrame:
    """One row per source: ``source_size`` words; adds schedule and target.

    With sources in the order of cap over weight, the first at which the level of an even share of what is left stays
    below its own ratio sets the level for all after it; those before it stop at their caps.
    """
    rows = weights(sizes).withColumn("w", (F.col("w_start") + F.col("w_end")) / 2).withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "__key")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - before
    level = left / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", F.when(level <= F.col("ratio"), level))
    found = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("target", F.least("cap", F.coalesce(found, F.lit(float("inf"))) * F.col("w"))).withColumn("quota", F.round("target").cast("long"))


def invert(u: Column, start: Column, end: Column) -> Column:
    """The time at which a linear schedule has used up the share ``u`` of its integral."""
    rise = end - start
    root = F.sqrt(start * start + rise * (start + end) * u)
    return F.least(F.lit(1.0), F.when(rise == 0, u).otherwise(F.try_divide(root - start, rise)))


def mix(docs: DataFrame, *, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weights: Callable[[DataFrame], DataFrame] = cycling_weights, repeats: int = 3, bucket_bits: int = 12, keep_text: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, taken and position (that of the first copy; null if nothing is taken).

    ``taken`` counts repeats: whole copies, and for one document of each source a last copy that is cut short.
    """
    clash = [c for c in docs.columns if c in {"size", "source_size", "target", "taken", "position", "ordinal_words", *WORK, *PLAN.values()}]
    sized = docs.drop(*clash).withColumn("size", word_count(F.col(text_col)))
    sized = sized.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))).withColumn("__h", F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), text_col)), 1, HASH_BITS // 4), 16, 10).cast("long"))
    sized = sized.withColumn("__bucket", F.shiftrightunsigned("__h", HASH_BITS - bucket_bits).cast("int"))
    sized = sized if keep_text else sized.drop(text_col)
    by_bucket = sized.groupBy("__key", "__bucket", F.col(source_col).alias("source")).agg(F.sum("size").alias("bucket_size"))
    sources = by_bucket.groupBy("__key", "source").agg(F.sum("bucket_size").alias("source_size"))
    plan = targets(sources, weights, repeats).select("__key", "source_size", "target", *[F.col(c).alias(own) for c, own in PLAN.items()])
    prefix = F.sum("bucket_size").over(Window.partitionBy("__key").orderBy("__bucket")) - F.col("bucket_size")
    plan = by_bucket.select("__key", "__bucket", prefix.alias("__before")).join(plan, "__key")
    inside = Window.partitionBy("__key", "__bucket").orderBy("__h", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.join(plan, ["__key", "__bucket"]).withColumn("ordinal_words", F.col("__before") + F.sum("size").over(inside) - F.col("size"))
    whole = F.coalesce(F.floor(F.try_divide("__quota", "source_size")), F.lit(0)).cast("long")
    rest = F.col("__quota") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least("size", rest - F.col("ordinal_words")))
    rows = rows.withColumn("taken", taken.cast("long"))
    first = invert(F.try_divide("ordinal_words", "__quota"), F.col("__w_start"), F.col("__w_end"))
    return rows.withColumn("position", F.when(F.col("taken") > 0, first)).drop(*WORK)


def emit(mixed: DataFrame, *, text_col: str = "text") -> DataFrame:
    """One row per copy (``__copy`` from 0) that the mix takes, with its training position; the cut copy keeps its first words, one space apart."""
    copies = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.try_divide("taken", "size")).cast("int") - 1)))
    rows = mixed.filter("taken > 0").withColumn("__copy", copies)
    words = F.least(F.col("size"), F.col("taken") - F.col("__copy") * F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.split(F.regexp_replace(text_col, f"^[{SPACE}]+", ""), f"[{SPACE}]+"), F.lit(1), words), " ")
    rows = rows.withColumn(text_col, F.when(words < F.col("size"), cut).otherwise(F.col(text_col)))
    at = invert(F.try_divide(F.col("ordinal_words") + F.col("__copy") * F.col("source_size"), F.col("__quota")), F.col("__w_start"), F.col("__w_end"))
    return rows.withColumn("position", at)
