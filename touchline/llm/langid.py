"""Language identification by known words first, then by ever shorter character n-grams.

A word that the model knows is scored by its log frequency in each language. An unknown word is scored by the
longest character n-grams of it (five down to one) that the model knows, by their mean. The counts come from labelled rows: at most
``sample_docs`` of them (a documented bound; the choice is by a hash of id and text, which no score sees).

The model holds sparse rows: for a word or n-gram the languages that have it, each by how much less likely it is there than
in the likeliest one (``MOST`` nats at most), and nothing for languages that lack it, which stand at ``MOST``. It keeps every word and
n-gram that its language has at least ``least`` times in the sample; nothing else bounds it but the sample of labelled rows, so what one language's
rows teach does not depend on how many others there are.

Defined results: a null text and a text without any letter give ``und`` with score 0; ties between languages go to the
smaller code; labels may be null (such rows teach nothing); with no labelled rows every text is ``und``.
"""

from __future__ import annotations

import functools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, bounded_sample, cut_lineage, id_crc

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: A word tells at most so much against a language (in nats), so one odd word can't decide a text.
MOST = 5.0
#: Unknown words whose scores a Python worker remembers before it starts anew.
REMEMBERED = 100_000


@dataclass
class Model:
    """Row i of the words (size 0) and n-grams (size n) has the entries ``starts[i]`` up to ``starts[i + 1]``: languages, and how
    much each one gains over a language that lacks it. ``grams`` has those of each size in the order of their rows, a line each."""

    langs: list[str]
    grams: list[str]
    starts: np.ndarray
    lang: np.ndarray
    gain: np.ndarray

    @functools.cached_property
    def places(self) -> list[dict[str, int]]:
        """The row of each word and n-gram by size; built where the model is used."""
        out, n = [], 0
        for lines in self.grams:
            own = lines.split("\n") if lines else []
            out.append(dict(zip(own, range(n, n + len(own)))))
            n += len(own)
        return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, Counter] = defaultdict(Counter)
    for pdf in batches:
        for text, lang in zip(pdf["text"], pdf["lang"]):
            found[lang].update(LETTERS.findall(text.lower()))
    for lang, counts in ((k, v) for k, v in found.items() if v):
        yield pd.DataFrame({"lang": lang, "gram": list(counts), "n": list(counts.values())})


def train(docs: DataFrame, *, id_col: str = "doc_id", sample_docs: int = 30_000, least: int = 3) -> Model:
    """``docs`` has an id, text and lang; rows with a null text or lang teach nothing."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), "text", "lang").filter("text is not null and lang is not null")
    sample = bounded_sample(rows, sample_docs, by=["id", "text"]).select("text", "lang")
    vocabulary = sample.mapInPandas(_counts, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit("<"), F.col("gram"), F.lit(">"))

    def pieces(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.struct(F.lit(n).alias("size"), F.substring(padded, i, n).alias("gram")))

    by_gram = vocabulary.select("lang", "n", F.explode(F.concat(*[pieces(n) for n in range(1, LONGEST + 1)])).alias("p")).filter(F.length("p.gram") == F.col("p.size")).groupBy("lang", "p.size", "p.gram").agg(F.sum("n").alias("n"))
    every = cut_lineage(vocabulary.select("lang", F.lit(0).alias("size"), "gram", "n").unionByName(by_gram))
    totals = every.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    return _model(every.filter(F.col("n") >= least).select("lang", F.col("size").cast("tinyint").alias("size"), "gram", "n").toArrow().to_pandas(), totals.toArrow().to_pandas())


def _model(kept: pd.DataFrame, totals: pd.DataFrame) -> Model:
    langs = sorted(totals["lang"].unique())
    total = {(x, k): n for x, k, n in zip(totals["lang"], totals["size"], totals["total"])}
    kept = kept.sort_values(["size", "gram", "lang"], ignore_index=True)
    new = ((kept["size"] != kept["size"].shift()) | (kept["gram"] != kept["gram"].shift())).to_numpy()
    at, n = np.cumsum(new) - 1, int(new.sum())
    lang = kept["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    of = np.array([total[x, k] for x, k in zip(kept["lang"], kept["size"])], float)
    told = np.log(kept["n"].to_numpy(float) / (of + 1))
    best = np.full(n, -np.inf)
    np.maximum.at(best, at, told)
    gain = MOST + np.maximum(told - best[at], -MOST)
    firsts = kept[new]
    grams = ["\n".join(firsts.loc[firsts["size"] == k, "gram"]) for k in range(LONGEST + 1)]
    return Model(langs, grams, np.searchsorted(at, np.arange(n + 1)), lang.astype(np.int32), gain.astype(np.float32))


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in a row, and the ranges' lengths."""
    n = ends - starts
    return np.arange(n.sum()) + np.repeat(starts - np.cumsum(n) + n, n), n


class Scorer:
    """Scores texts; words that the model lacks are scored once by their n-grams and then remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.ends = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64)
        self.lang, self.gain, self.used = np.zeros(4 * REMEMBERED, np.int32), np.zeros(4 * REMEMBERED, np.float32), 0

    def parts(self, word: str) -> list[int]:
        """The longest n-grams of the word that the model knows."""
        padded, all_places = f"<{word}>", self.model.places
        for n in range(min(LONGEST, len(padded)), 0, -1):
            places = all_places[n]
            if found := [k for i in range(len(padded) - n + 1) if (k := places.get(padded[i : i + n])) is not None]:
                return found
        return []

    def learn(self, words: list[str]) -> None:
        """Remember the gains of words that the model lacks: the mean over their parts, none without any."""
        m = self.model
        parts = [self.parts(w) for w in words]
        sizes = np.array([len(p) for p in parts])
        rows = np.array([k for p in parts for k in p], np.int64)
        each, n = ranges(m.starts[rows], m.starts[rows + 1])
        word = np.repeat(np.repeat(np.arange(len(words)), sizes), n)
        keys, back = np.unique(word * len(m.langs) + m.lang[each], return_inverse=True)
        sums = np.bincount(back, m.gain[each], len(keys))
        word = keys // len(m.langs)
        if self.used + len(keys) > len(self.lang):
            room = max(2 * len(self.lang), self.used + len(keys))
            self.lang, self.gain = np.resize(self.lang, room), np.resize(self.gain, room)
        own = slice(self.used, self.used + len(keys))
        self.lang[own], self.gain[own] = keys % len(m.langs), sums / sizes[word]
        new = slice(len(self.at), len(self.at) + len(words))
        edges = self.used + np.searchsorted(word, np.arange(len(words) + 1))
        self.starts[new], self.ends[new] = edges[:-1], edges[1:]
        self.at.update(zip(words, range(new.start, new.stop)))
        self.used += len(keys)

    def one(self, text: str | None) -> tuple[str, float]:
        m = self.model
        counts = Counter(LETTERS.findall(text.lower())) if text else {}
        if not m.langs or not any(any(map(str.isalpha, w)) for w in counts):
            return UNKNOWN, 0.0
        words = list(counts)
        total = np.zeros(len(m.langs))
        known = list(map(m.places[0].get, words))
        if None in known:
            lacking = [w for w, k in zip(words, known) if k is None]
            for i in range(0, len(lacking), REMEMBERED):
                some = lacking[i : i + REMEMBERED]
                if new := [w for w in some if w not in self.at]:
                    if len(self.at) + len(new) > REMEMBERED:
                        self.forget()
                        new = some
                    self.learn(new)
                at = np.fromiter(map(self.at.get, some), np.int64, len(some))
                total += self.gains(self.starts[at], self.ends[at], self.lang, self.gain, some, counts)
            words, known = [w for w, k in zip(words, known) if k is not None], [k for k in known if k is not None]
        if known:
            at = np.array(known)
            total += self.gains(m.starts[at], m.starts[at + 1], m.lang, m.gain, words, counts)
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return m.langs[best], float(odds[best] / odds.sum())

    def gains(self, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray, gain: np.ndarray, words: list[str], counts: Counter) -> np.ndarray:
        each, n = ranges(starts, ends)
        return np.bincount(lang[each], gain[each] * np.repeat(np.fromiter(map(counts.get, words), float, len(words)), n), len(self.model.langs))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of each whole text and its share of the likelihood."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.one(x) for x in texts], columns=["lang", "score"])

    return docs.withColumn("__l", scored(text_col)).withColumn(lang_as, F.col("__l.lang")).withColumn(score_as, F.col("__l.score")).drop("__l")


def held_out(col: str = "doc_id"):
    return id_crc(col) % 5 == 0


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Train on the rows that aren't held out; predict every row."""
    model = train(docs.filter(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
