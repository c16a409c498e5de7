"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words, normalised, go into one automaton whose states are classes of phrases that end at the same places of the
items. A document's words stream through it; the automaton always knows the longest suffix read that stands in
some item. Where that is a window long (``window`` words, or a whole item of fewer) the words of the match are hit. A
state's link chain tells the window that ends there, and each window knows its items.

An automaton takes at most ``shard_words`` words of items beside its last item, which bounds what is broadcast. Items
beyond that go into further automata; every document streams through each in turn, and what it hits is merged by row, so
any number of items gives the same result as one automaton would.

Words are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased. Defined results: null and
blank texts have no words, hit nothing and are clean; an item without words is no window; items with equal ids count once; an
item with a null id marks words but is not counted; repeated documents are judged each; without items every document
is clean; an empty table gives an empty result. Documents' other columns are kept by ``clean`` and ``marked``, whatever their names, but for
the columns that these add.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut_lineage

#: Words of items in one automaton, which takes about 0.6 KB for each of them.
SHARD_WORDS = 200_000
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
JAVA_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ADDED = ["n_words", "hit_spans", "hit_items"]
#: Other bytes become spaces and A-Z lower case, so that splitting gives the words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


class Automaton:
    """Generalised suffix automaton over words. State 0 is the start; ``longest`` is the length of a state's longest phrase."""

    def __init__(self, window: int):
        self.window = window
        self.following: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.words: dict[bytes, int] = {}
        self.items: list[tuple[str | None, list[int]]] = []

    def add(self, name: str | None, words: list[bytes]) -> None:
        own = [self.words.setdefault(w, len(self.words)) for w in words]
        if not own:
            return
        self.items.append((name, own))
        last = 0
        for w in own:
            last = self._extended(last, w)

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.longest.append(length)
        self.link.append(link)
        self.following.append(following)
        return len(self.link) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of the phrases of ``q`` that come from ``p`` and shorter ones, as those now end at more places."""
        clone = self._state(self.longest[p] + 1, self.link[q], dict(self.following[q]))
        self.link[q] = clone
        while p >= 0 and self.following[p].get(w) == q:
            self.following[p][w] = clone
            p = self.link[p]
        return clone

    def _extended(self, last: int, w: int) -> int:
        q = self.following[last].get(w)
        if q is not None:  # an earlier item has this phrase
            return q if self.longest[q] == self.longest[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.longest[last] + 1, 0, {}), last
        while p >= 0 and w not in self.following[p]:
            self.following[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.following[p][w]
            self.link[new] = q if self.longest[q] == self.longest[p] + 1 else self._split(p, q, w)
        return new

    def close(self) -> None:
        """Find each state's window and the items of each window.

        ``ending[v]`` is the state of the last ``window`` words of v's phrases, -1 if those are shorter; ``short[v]`` has (length, key)
        of every shorter item that is a suffix of them; keys lead to item names."""
        order = sorted(range(1, len(self.link)), key=self.longest.__getitem__)
        self.ending = [-1] * len(self.link)
        for v in order:
            if self.longest[v] >= self.window:
                up = self.ending[self.link[v]]
                self.ending[v] = up if up >= 0 else v
        whole: dict[int, list[tuple[int, int]]] = {}
        self.names: dict[int, set[str]] = {}
        for name, own in self.items:
            v, keys = 0, []
            for w in own:
                v = self.following[v][w]
                if self.ending[v] >= 0:
                    keys.append(self.ending[v])
            if len(own) < self.window:
                # the same item text always ends in the same state; its key lies beyond the states
                key = len(self.link) + v * self.window + len(own)
                if (len(own), key) not in whole.setdefault(v, []):
                    whole[v].append((len(own), key))
                keys.append(key)
            for key in keys:
                names = self.names.setdefault(key, set())
                if name is not None:
                    names.add(name)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for v in order:
            self.short[v] = self.short[self.link[v]] + tuple(whole.get(v, ()))
        self.has_short = bool(whole)
        del self.items

    def matched(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """The stretches (first word, end) of ``words`` that windows cover, in order and apart, and the keys of those windows."""
        following, link, longest, ending, short = self.following, self.link, self.longest, self.ending, self.short
        window, has_short = self.window, self.has_short
        spans: list[list[int]] = []
        keys: set[int] = set()
        v = length = 0
        for i, w in enumerate(map(self.words.get, words)):
            if w is None:
                v = length = 0
                continue
            to = following[v].get(w)
            if to is None:
                while v >= 0 and (to := following[v].get(w)) is None:
                    v = link[v]
                if v < 0:
                    v = length = 0
                    continue
                length = longest[v]
            v, length = to, length + 1
            if length >= window:
                keys.add(ending[v])
                first = i + 1 - length
            elif has_short and short[v]:
                fit = [(n, key) for n, key in short[v] if n <= length]
                if not fit:
                    continue
                keys.update(key for _, key in fit)
                first = i + 1 - max(n for n, _ in fit)
            else:
                continue
            if length >= window and has_short and short[v]:
                keys.update(key for n, key in short[v] if n <= length)
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append([first, i + 1])
        return [(a, b) for a, b in spans], keys

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """The covered stretches and the names of the items whose windows occur."""
        spans, keys = self.matched(words)
        return spans, sorted(set().union(*(self.names[k] for k in keys))) if keys else []


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches put together where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dealt(items: DataFrame, shard_words: int, *, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``items`` as shard, name and text, and the number of shards. A running sum in two levels (256 buckets of a hash, then items of a bucket)
    deals them, so a shard has at most ``shard_words`` words beside its last item and no task sums all items."""
    rows = items.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    # words stand apart, so a text has no more of them than this
    rows = rows.withColumn("size", F.ceil((F.length("text") + 1) / 2)).withColumn("h", F.xxhash64("name", "text")).withColumn("bucket", F.pmod("h", F.lit(256)).cast("int"))
    total = int(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    if total <= shard_words:
        return rows.select(F.lit(0).alias("shard"), "name", "text"), 1
    sums = rows.groupBy("bucket").agg(F.sum("size").alias("all"))
    sums = sums.select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("before"))
    upto = F.sum("size").over(Window.partitionBy("bucket").orderBy("h", "name", "text")) - F.col("size")
    placed = rows.withColumn("upto", upto).join(sums, "bucket")
    return cut_lineage(placed.select(F.floor((F.col("before") + F.col("upto")) / F.lit(shard_words)).cast("int").alias("shard"), "name", "text")), total // shard_words + 1


def automaton(rows: list, window: int) -> Automaton:
    """Of (name, text) rows; their order doesn't matter to what it matches."""
    out = Automaton(window)
    for name, text in rows:
        out.add(name, split_words(text))
    out.close()
    return out


#: The automaton that a worker used last.
_BUILT: dict[str, Automaton] = {}


FOUND = "n_words long, spans array<int>, items array<string>"


def _streamed(spark: SparkSession, some: list[tuple[str | None, str]], window: int):
    """A column function: what one shard's items hit in a text."""
    shared = spark.sparkContext.broadcast(some)
    which = uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        # a worker builds an automaton once and keeps its last one
        if which not in _BUILT:
            _BUILT.clear()
            _BUILT[which] = automaton(shared.value, window)
        own = _BUILT[which]
        for texts in batches:
            rows = []
            for text in texts:
                words = split_words(text)
                spans, names = own.hits(words)
                rows.append((len(words), [x for span in spans for x in span], names))
            yield pd.DataFrame({"n_words": pd.Series([r[0] for r in rows], dtype="int64"), "spans": pd.Series([r[1] for r in rows], dtype=object), "items": pd.Series([r[2] for r in rows], dtype=object)})

    return found


def joined_spans(flat: Column) -> Column:
    """Stretches that several shards found, put together where they overlap or touch."""

    @F.pandas_udf("array<int>")
    def join(spans: pd.Series) -> pd.Series:
        return pd.Series([[x for s in merged(list(zip(v[0::2], v[1::2]))) for x in s] for v in spans], dtype=object)

    return join(flat)


def marked(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with n_words, ``hit_spans`` (first word, end, first word, end, ...) and ``hit_items`` (names as sorted strings)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    dealt_items, shards = dealt(items, shard_words, id_col=item_id, text_col=item_text)
    rows = docs.drop(*[c for c in docs.columns if c in ADDED])

    def of(k: int):
        # the words of one shard have a bound, so its items can pass through the driver
        return _streamed(spark, [(r["name"], r["text"]) for r in dealt_items.filter(F.col("shard") == k).select("name", "text").collect()], window)

    if shards == 1:
        out = rows.withColumn("__m", of(0)(text_col))
        return out.withColumns(dict(zip(ADDED, (F.col("__m.n_words"), F.col("__m.spans"), F.col("__m.items"))))).drop("__m")
    # row numbers are written with the rows, so every pass over a shard, and its reruns, see the same ones
    rows = cut_lineage(rows.withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for k in range(shards):
        hit = rows.select("__row", of(k)(text_col).alias("__m")).filter("size(__m.items) + size(__m.spans) > 0").select("__row", "__m.spans", "__m.items")
        hit = cut_lineage(hit)
        found = hit if found is None else found.unionByName(hit)
    by_row = found.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("__s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__i"))
    out = rows.join(by_row, "__row", "left")
    n_words = F.coalesce(F.regexp_count(text_col, F.lit(JAVA_WORD)), F.lit(0)).cast("long")
    none = F.array()
    return out.withColumns(dict(zip(ADDED, (n_words, joined_spans(F.coalesce("__s", none.cast("array<int>"))), F.coalesce("__i", none.cast("array<string>")))))).drop("__row", "__s", "__i")


def hit_words() -> Column:
    """The words in ``hit_spans``: ends less starts."""
    n = F.size("hit_spans")
    at = F.sequence(F.lit(1), n)
    return F.when(n > 0, F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: acc + F.when(i % 2 == 0, F.element_at("hit_spans", i)).otherwise(-F.element_at("hit_spans", i)))).otherwise(F.lit(0).cast("long"))


def digests(docs: DataFrame, items: DataFrame, *, window: int = 10) -> DataFrame:
    """doc_id, its words, how many of them are hit, by how many items, and a hash of these."""
    found = marked(docs.select("doc_id", "text"), items, window=window).withColumn("n_hit", hit_words())
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without(text: str | None, flat, least: int) -> str | None:
    """``text`` without the stretches of at least ``least`` words, each from its first word's start to its last one's end."""
    if text is None or flat is None or not len(flat):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    long = [(a, b) for a, b in zip(flat[0::2], flat[1::2]) if b - a >= least]
    if not long:
        return text
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for a, b in long:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return (b"".join(out) + raw[at:]).decode("utf-8", "replace")


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = 10, least_span: int = 0, most_coverage: float = 0.5, **how) -> DataFrame:
    """``docs`` without documents of which more than ``most_coverage`` of the words are hit, and, in the others, without hit stretches
    of at least ``least_span`` words; adds n_words, hit_spans, hit_items and keeps the rest of the columns."""
    found = marked(docs, items, text_col=text_col, window=window, **how)
    kept = found.filter(hit_words() <= F.col("n_words") * most_coverage)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s, least_span) for t, s in zip(texts, spans)], dtype=object)

    return kept.withColumn(text_col, cut(F.col(text_col), F.col("hit_spans")))
