"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton in folded text.

Folding lower-cases, takes look-alike letters of other scripts and accents to plain ones, and takes digits and signs
that stand for letters inside a word to those letters (i, l, 1, ! and | fall together). The lexicon is learnt: the weight
of a folded word, or of a word's beginning (written with a star), is a cautious log ratio of its occurrences in toxic and
in clean labelled rows. A hit counts when it is a whole word, or the start of one for a beginning, outside every
exception phrase; of hits with one start the heaviest counts. Exception phrases are a few fixed ones and those learnt: a
lexicon word with a neighbour that by the same labelled rows is no sign of toxicity (its log ratio isn't over 0 even with two standard errors added). The summed weights, alone and by length, go through a
logistic curve fitted on the same labelled rows, so the score lies between 0 and 1. Length is the number of words, or a
sixth of the letters if that is more, as in scripts without spaces.

At most ``sample_docs`` labelled rows teach (a documented bound, chosen by a hash of the id, which no score sees), which bounds the lexicon and the phrases too. Defined results: null and empty texts score as a text without hits; rows of ``labels`` with a
null id or label teach nothing; repeated labels of a document count once, the larger label holding.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded_batches, bounded_sample, cut_lineage, id_crc

# Letters of other scripts and the plain letters that they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ո": "n", "ս": "u",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "đ": "d",
}
# Digits and signs that stand for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
# Phrases in which a lexicon word is harmless, whatever the labelled rows know of them.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "clown fish", "idiot proof", "loser of the match", "pathetic fallacy"]

INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
TABLE = str.maketrans(LOOK_ALIKES) | INVISIBLE
JOINED = str.maketrans({"l": "i"})
STANDS = str.maketrans(STAND_INS)
INSIDE = re.compile(r"[0134578@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[013457]+(?!\w)")
MARKS = re.compile("[̀-ͯ]+")
WORDS = re.compile(r"[^\W\d_]+")
SPACED_WORDS = re.compile(WORD)
LETTERS_A_WORD = 6
#: Lengths of the beginnings that may enter the lexicon.
BEGINNINGS = (4, 5, 6, 7)


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(TABLE)
    return INSIDE.sub(lambda m: m[0].translate(STANDS), text).translate(JOINED)


def entries(folded: str) -> Counter:
    """A text's words and with a star their beginnings, with how often each occurs."""
    out = Counter(WORDS.findall(folded))
    for w, n in list(out.items()):
        for size in BEGINNINGS:
            if len(w) > size:
                out[f"{w[:size]}*"] += n
    return out


def _word_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By word and label: its documents, and their sum of log2(1 + occurrences). The empty word carries the documents."""
    found = (Counter(), Counter())
    mass = (Counter(), Counter())
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            found[toxic][""] += 1
            for word, n in entries(fold(text)).items():
                found[toxic][word] += 1
                mass[toxic][word] += math.log2(1 + n)
    for toxic in (y for y in (0, 1) if found[y]):
        yield pd.DataFrame({"word": list(found[toxic]), "toxic": toxic, "n": list(found[toxic].values()), "mass": [mass[toxic][w] for w in found[toxic]]})


def _side(col: str, toxic: int) -> Column:
    return F.sum(F.when(F.col("toxic") == toxic, F.col(col)).otherwise(0))


def learn_lexicon(labelled: DataFrame, *, least_docs: int = 5, least_weight: float = 1.5) -> dict[str, float]:
    """``labelled`` has text and toxic (0 or 1). An entry's weight is the log ratio of its damped occurrences per toxic and per
    clean document, less two standard errors; it enters with enough toxic documents and weight."""
    counts = labelled.mapInPandas(_word_docs, "word string, toxic int, n long, mass double").groupBy("word").agg(_side("n", 1).alias("bad"), _side("n", 0).alias("good"), _side("mass", 1).alias("bad_mass"), _side("mass", 0).alias("good_mass"))
    counts = cut_lineage(counts.filter((F.col("bad") >= least_docs) | (F.col("word") == "")))
    whole = counts.filter("word = ''").first()
    bad, good = (int(whole["bad"]), int(whole["good"])) if whole else (0, 0)
    ratio = F.log((F.col("bad_mass") + 0.5) / (bad + 1.0)) - F.log((F.col("good_mass") + 0.5) / (good + 1.0))
    weight = ratio - 2 * F.sqrt(1 / F.col("bad") + 1 / (F.col("good") + 0.5))
    kept = counts.filter(F.col("word") != "").filter(F.col("bad") >= least_docs).select("word", F.round(weight, 9).alias("w")).filter(F.col("w") >= least_weight)
    return {r["word"]: r["w"] for r in kept.orderBy(F.desc("w"), "word").collect()}


def phrases(folded: str, lexicon: dict[str, float]) -> set[str]:
    """Each lexicon word of a text with its neighbour to the left and to the right, where one space lies between."""
    found = [m.span() for m in WORDS.finditer(folded)]
    out = set()
    for i, (a, b) in enumerate(found):
        word = folded[a:b]
        if word in lexicon or any(f"{word[:n]}*" in lexicon for n in BEGINNINGS if n < len(word)):
            if i and folded[found[i - 1][1] : a] == " ":
                out.add(folded[found[i - 1][0] : b])
            if i + 1 < len(found) and folded[b : found[i + 1][0]] == " ":
                out.add(folded[a : found[i + 1][1]])
    return out


def learn_exceptions(labelled: DataFrame, lexicon: dict[str, float], *, least_docs: int = 5) -> list[str]:
    """Phrases that speak against toxicity or at least not for it, in enough clean documents."""
    if not lexicon:
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                found[("", toxic)] += 1
                found.update((p, toxic) for p in phrases(fold(text), lexicon))
        if found:
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["phrase", "toxic", "n"])

    counts = labelled.mapInPandas(run, "phrase string, toxic int, n long").groupBy("phrase").agg(_side("n", 1).alias("bad"), _side("n", 0).alias("good"))
    counts = cut_lineage(counts.filter((F.col("good") >= least_docs) | (F.col("phrase") == "")))
    whole = counts.filter("phrase = ''").first()
    bad, good = (int(whole["bad"]), int(whole["good"])) if whole else (0, 0)
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    fine = ratio + 2 * F.sqrt(1 / (F.col("bad") + 1) + 1 / (F.col("good") + 0.5)) <= 0
    return sorted(r["phrase"] for r in counts.filter(F.col("phrase") != "").filter(fine).select("phrase").collect())


def automaton(lexicon: dict[str, float], exceptions: list[str] = []):  # noqa: B006  never changed
    """Each entry carries its length and its weights as a word and as a beginning; exception phrases carry neither."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, weight in lexicon.items():
        stem = word.rstrip("*")
        held = found.get(stem, (0, None, None))
        found.add_word(stem, (len(stem), weight if stem == word else held[1], weight if stem != word else held[2]))
    for phrase in [*map(fold, EXCEPTIONS), *exceptions]:
        found.add_word(phrase, (len(phrase), None, None))
    found.make_automaton()
    return found


def length(folded: str) -> float:
    return max(1, len(SPACED_WORDS.findall(folded)), sum(map(str.isalpha, folded)) / LETTERS_A_WORD)


def features(matcher, text: str | None) -> tuple[float, float]:
    """Log of the summed weights of a text's hits, and of that sum per hundred words."""
    folded = fold(text)
    hits: dict[int, tuple[int, float]] = {}
    harmless = []
    for end, (size, whole, beginning) in matcher.iter(folded):
        start = end + 1 - size
        if start == 0 or not folded[start - 1].isalnum():
            closed = end + 1 == len(folded) or not folded[end + 1].isalnum()
            if whole is None and beginning is None:
                harmless += [(start, end)] * closed
            elif (weight := whole if closed else beginning) is not None:
                hits[start] = max(hits.get(start, (0, 0.0)), (end, weight), key=lambda x: x[1])
    total = sum(w for s, (e, w) in hits.items() if not any(a <= s and e <= b for a, b in harmless))
    return (math.log1p(total), math.log1p(100 * total / length(folded))) if total else (0.0, 0.0)


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; one class alone gives its own side."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(beta)), x.T @ (y - p) - 0.05 * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out(col: str = "doc_id"):
    return id_crc(col) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = 30_000) -> tuple[dict[str, float], list[str], list[float]]:
    """The lexicon, the learnt exception phrases and the curve's coefficients, from labelled rows that aren't held out."""
    bounded_batches(docs.sparkSession)
    told = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # the sample bounds what is broadcast: about sample_docs ids with a label each, under a megabyte; texts don't shuffle
    told = bounded_sample(told, sample_docs, by=["doc_id"])
    rows = cut_lineage(docs.select("doc_id", "text").filter(~held_out()).join(F.broadcast(told), "doc_id").select("text", "toxic"))
    lexicon = learn_lexicon(rows)
    exceptions = learn_exceptions(rows, lexicon)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = automaton(lexicon, exceptions)
        for pdf in batches:
            yield pd.DataFrame([(*features(matcher, t), y) for t, y in zip(pdf["text"], pdf["toxic"])], columns=["a", "b", "toxic"])

    seen = rows.mapInPandas(measured, "a double, b double, toxic int").groupBy(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), "toxic").count().toPandas().sort_values(["a", "b", "toxic"])
    if seen.empty:
        return lexicon, exceptions, [0.0, 0.0, 0.0]
    each = seen.loc[seen.index.repeat(seen["count"])]
    return lexicon, exceptions, _fit(each[["a", "b"]].to_numpy(), each["toxic"].to_numpy(float)).tolist()


def score(docs: DataFrame, lexicon: dict[str, float], exceptions: list[str], curve: list[float], *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = automaton(lexicon, exceptions)
        for texts in batches:
            z = np.array([features(matcher, t) for t in texts]).reshape(-1, 2) @ np.array(curve[1:]) + curve[0]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    bounded_batches(docs.sparkSession)
    return docs.withColumn("score", scored(text_col)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled rows that aren't held out; score every row."""
    return score(docs.select("doc_id", "text"), *train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
