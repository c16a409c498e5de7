"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Three kinds of base spans (``assign``, ``access``, ``hex``) are found by pattern and always stay. Strings of mixed
letters and digits are candidates besides. The hash of every candidate is counted over the corpus by distinct owners
(the source) and distinct repositories (the document): one that several owners or many repositories carry is a widely
copied example, one that few of both carry looks like a live credential. Live-looking mixed strings become spans of kind ``token``.

Positions are code points; they follow from the lengths of the pieces between matches. Defined results: a null text is
empty; a null owner is one owner; rows that repeat give the same spans each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

# What each kind matches (Java syntax); lengths are the least that count.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIXED = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "token"]
LEAST_ASSIGNED = 6
#: Spans that are put in a row at a time.
BLOCK = 128
SPAN = "array<struct<start:int,kind:int,stop:int,value:string>>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(array: Column) -> Column:
    """A bound array as arrays of ``BLOCK`` elements, so that what grows step by step stays short."""
    n = F.ceil(F.size(array) / F.lit(BLOCK)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(array, i * BLOCK + 1, F.lit(BLOCK))), lambda x: F.size(x) > 0)


def _spans(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """Every match of ``pattern``, leftmost first and without overlap, with its place. Positions are summed in two levels."""
    matches, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        stop = start + F.length(x["m"])
        return F.struct(stop.alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), stop.alias("stop"), x["v"].alias("value")))).alias("out"))

    def block(acc: Column, rows: Column) -> Column:
        done = F.aggregate(rows, F.struct(acc["pos"].alias("pos"), F.array().cast(SPAN).alias("out")), step)
        return _bound(done, lambda d: F.struct(d["pos"].alias("pos"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    zipped = F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"))
    found = _bound(zipped, lambda rows: F.flatten(F.aggregate(_blocks(rows), F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out")), block)["out"]))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    assigned = F.filter(_spans(text, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    return F.array_sort(F.concat(assigned, _spans(text, "access", ACCESS), _spans(text, "hex", HEX)))


def mixed_spans(text: Column, base: Column) -> Column:
    """Strings with a digit, a capital and a small letter that touch no base span."""

    def odd(s: Column) -> Column:
        v = s["value"]
        return v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")

    def free(rows: Column, parts: Column) -> Column:
        # both come by start, so a block of strings meets few blocks of base spans; of those the spans near it are picked once for all of its strings
        reaches = lambda x: (x["start"] < F.element_at(rows, -1)["stop"]) & (x["stop"] > F.element_at(rows, 1)["start"])
        near = F.filter(F.flatten(F.transform(F.filter(parts, reaches), lambda x: x["rows"])), reaches)
        return _bound(near, lambda n: F.filter(rows, lambda s: ~F.exists(n, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"]))))

    def part(rows: Column) -> Column:
        return F.struct(rows.alias("rows"), F.element_at(rows, 1)["start"].alias("start"), F.array_max(F.transform(rows, lambda s: s["stop"])).alias("stop"))

    parts = _bound(base, lambda b: F.transform(_blocks(b), part))
    return _bound(parts, lambda p: _bound(F.filter(_spans(text, "token", MIXED), odd), lambda spans: F.flatten(F.transform(_blocks(spans), lambda rows: free(rows, p)))))


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def row_key(id_col: str, text_col: str, owner_col: str) -> Column:
    """Rows with the same key have the same candidates."""
    return F.struct(F.xxhash64(id_col, text_col, owner_col, F.isnull(id_col), F.isnull(owner_col)).alias("a"), F.hash(text_col, id_col).alias("b"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", few_owners: int = 2, few_repositories: int = 10) -> DataFrame:
    """One row per document: id, key, base spans, all spans, and how many are live-looking or widely copied."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col, owner_col).alias("key"), F.coalesce(F.concat(F.lit("o"), F.col(owner_col)), F.lit("n")).alias("owner"), F.col(text_col).alias("__text"), base_spans(text).alias("base"))
    found = found.select("doc_id", "key", "owner", "base", mixed_spans(F.coalesce("__text", F.lit("")), F.col("base")).alias("mixed"))
    digest = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.sha2(s["value"], 256).alias("value")))
    found = cut_lineage(found.withColumn("base", digest("base")).withColumn("mixed", digest("mixed")))
    each = found.filter("size(base) + size(mixed) > 0").select("key", "doc_id", "owner", F.explode(F.concat("base", "mixed")).alias("s")).distinct()
    owned = each.groupBy(F.col("s.value").alias("value"), "owner", "doc_id").agg(F.lit(1).alias("x")).groupBy("value", "owner").agg(F.count("*").alias("repositories")).groupBy("value").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    judged = each.join(owned.withColumn("live", (F.col("owners") <= few_owners) & (F.col("repositories") <= few_repositories)), F.col("s.value") == F.col("value"))
    token = KINDS.index("token")
    per_row = judged.groupBy("key").agg(
        F.collect_set(F.when(F.col("live") & (F.col("s.kind") == token), F.col("s"))).alias("added"),
        F.collect_set(F.when(F.col("live"), F.struct("s.start", "s.stop"))).alias("live"),
        F.collect_set(F.when(~F.col("live") & (F.col("s.kind") != token), F.struct("s.start", "s.stop"))).alias("copied"),
    )
    out = found.join(per_row, "key", "left")
    every = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return out.select("doc_id", "key", "base", every.alias("every"), F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"), F.coalesce(F.size("copied"), F.lit(0)).cast("long").alias("n_copied"))


def digest_columns(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(F.col("every")).alias("spans"), "n_live", "n_copied")


def redact(docs: DataFrame, *, mark: str = "[SECRET]", **columns: str) -> DataFrame:
    """``docs`` with every span of the scan replaced by ``mark``; spans that overlap or touch make one mark."""
    id_col, text_col, owner_col = columns.get("id_col", "doc_id"), columns.get("text_col", "text"), columns.get("owner_col", "source")
    spans = scan(docs, **columns).filter("size(every) > 0").select(F.col("key").alias("__key"), F.col("every").alias("__spans")).dropDuplicates(["__key"])
    rows = docs.withColumn("__key", row_key(id_col, text_col, owner_col)).join(spans, "__key", "left")

    def block(acc: Column, some: Column) -> Column:
        # finding a place in a text takes time by its length, so a block's spans look for theirs in the block's part of it
        def inside(part: Column) -> Column:
            def step(own: Column, s: Column) -> Column:
                gap = F.substring(part, own["pos"] - acc["pos"] + 1, F.greatest(F.lit(0), s["start"] - own["pos"]))
                covered = (s["start"] <= own["pos"]) & own["any"]
                return F.struct(F.greatest(own["pos"], s["stop"]).alias("pos"), F.lit(True).alias("any"), F.when(covered, own["out"]).otherwise(F.concat(own["out"], gap, F.lit(mark))).alias("out"))

            done = F.aggregate(some, F.struct(acc["pos"].alias("pos"), acc["any"].alias("any"), F.lit("").alias("out")), step)
            return _bound(done, lambda d: F.struct(d["pos"].alias("pos"), d["any"].alias("any"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

        last = F.array_max(F.transform(some, lambda s: s["stop"]))
        return _bound(F.substring(F.col(text_col), acc["pos"] + 1, F.greatest(F.lit(0), last - acc["pos"])), inside)

    start = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("any"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(_blocks(F.col("__spans")), start, block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), acc["pos"] + 1, F.length(text_col))))
    return rows.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(done)).drop("__key", "__spans")
