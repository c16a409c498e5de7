import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from touchline.llm import langid, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op10_langid(spark, sf).join(docs, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all() and got["score"].between(0, 1).all()
    test = got[got["held_out"] & got["lang"].notna()]
    assert (test["lang"] == test["lang_pred"]).mean() >= 0.99


@pytest.fixture(scope="module")
def model(spark):
    texts = {"en": "the cat sat on the mat and the dog ran", "de": "der hund und die katze auf der matte", "fr": "le chat et le chien sur le tapis"}
    return langid.train(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts.items())], "doc_id long, text string, lang string"), least=1)


@pytest.mark.parametrize("text, lang", [("the mat", "en"), ("Die Katze", "de"), ("le chien", "fr"), ("chienne chatte", "fr"), ("hunde katzen", "de"), (None, "und"), ("", "und"), ("123 !? _", "und"), ("² ½ Ⅷ", "und")])
def test_words_first_then_their_parts(model, text, lang):
    assert langid.Scorer(model).one(text)[0] == lang


def plain(rows, texts):
    """The rule from plain counts of (text, lang) rows, without model, sparse rows or memory."""
    from collections import Counter

    counts = {}
    for t, lang in rows:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            for size, gram in [(0, w)] + [(n, f"<{w}>"[i : i + n]) for n in range(1, 6) for i in range(len(w) + 3 - n)]:
                counts.setdefault((lang, size), Counter())[gram] += 1
    langs, sums = sorted({k[0] for k in counts}), {k: sum(v.values()) for k, v in counts.items()}

    def row(size, gram):
        told = {x: math.log(counts[x, size][gram] / (sums[x, size] + 1)) for x in langs if counts.get((x, size), {}).get(gram)}
        return {x: max(-5.0, told[x] - max(told.values())) if x in told else -5.0 for x in langs} if told else None

    for text in texts:
        total = dict.fromkeys(langs, 0.0)
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            found = [row(0, w)] if row(0, w) else []
            for n in range(5, 0, -1):
                if not found:
                    found = [r for i in range(len(w) + 3 - n) if (r := row(n, f"<{w}>"[i : i + n]))]
            for r in found:
                for x in langs:
                    total[x] += r[x] / len(found)
        odds = {x: math.exp(v - max(total.values())) for x, v in total.items()}
        best = max(langs, key=lambda x: (odds[x], [-ord(c) for c in x]))
        yield best, odds[best] / sum(odds.values())


def test_predictions_equal_plain_counting(spark, docs):
    few = docs.filter("length(text) < 1500 and lang is not null").orderBy("doc_id").limit(60)
    rows = [(r["text"], r["lang"]) for r in few.collect()]
    scorer = langid.Scorer(langid.train(few, least=1))
    texts = [r[0] for r in docs.filter("text is not null and length(text) between 30 and 400").orderBy("doc_id").select("text").limit(25).collect()] + ["unheard zzz wörds", "qqq"]
    for text, (lang, score) in zip(texts, plain(rows, texts)):
        assert scorer.one(text) == (lang, pytest.approx(score, abs=1e-4))


def test_forgetting_changes_nothing(model, monkeypatch):
    whole = langid.Scorer(model).one("alpha beta gamma delta epsilon zeta the")
    monkeypatch.setattr(langid, "REMEMBERED", 4)
    small = langid.Scorer(model)
    assert [small.one("alpha beta gamma delta epsilon zeta the") for _ in range(3)] == [(whole[0], pytest.approx(whole[1]))] * 3


def test_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(spark, odd).collect()}
    assert langid.identify(spark, odd).count() == odd.count() and {(2, "und"), (3, "und"), (4, "und"), (8, "und")} <= got
    assert langid.identify(spark, none).count() == 0
    unlabelled = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(spark, unlabelled).collect()} == {"und"}


def test_labels_of_held_out_rows_teach_nothing(spark, docs):
    turned = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 'xx' else lang end as lang")
    a, b = (sorted(map(tuple, langid.identify(spark, x).collect())) for x in (docs, turned))
    assert a == b


def test_other_languages_leave_what_a_language_taught_as_it_was(spark):
    base = [(i, t, l) for i, (t, l) in enumerate([("the quick brown fox and the dog", "en"), ("der schnelle braune fuchs und der hund", "de"), ("le renard brun et le chien", "fr"), ("el zorro y el perro", "es")] * 5)]
    others = [(1000 + 2 * i + j, " ".join(chr(0x4E00 + 30 * i + k) * 2 for k in range(12)), f"x{i}") for i in range(400) for j in range(2)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, many = langid.train(frame(base)), langid.train(frame(base + others))
    assert len(many.langs) == 404

    def told(m):
        out = {}
        for size, places in enumerate(m.places):
            for gram, k in places.items():
                for at in range(m.starts[k], m.starts[k + 1]):
                    out[size, gram, m.langs[m.lang[at]]] = float(m.gain[at])
        return out

    a, b = told(few), told(many)
    shared = {k for k in a if k[1] not in ("<", ">")}
    assert shared and {k: b.get(k) for k in shared} == {k: a[k] for k in shared}
