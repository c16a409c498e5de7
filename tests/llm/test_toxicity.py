import math
import random
import re
import zlib

import pytest

from touchline.llm import queries, toxicity


@pytest.mark.parametrize("text, folded", [("IDI0T", "idiot"), ("іdіоt", "idiot"), ("1d!ot", "idiot"), ("cl0wn 2024 x", "ciown 2024 x"), ("ÉLÈVE", "eieve"), ("m​oron", "moron"), ("5 apples, 10 pears", "5 appies, 10 pears"), (None, "")])
def test_folding(text, folded):
    assert toxicity.fold(text) == folded


def test_exceptions_and_word_ends():
    m = toxicity.automaton({"trash": 4.0, "idiot": 5.0, "mor*": 2.0})
    f = lambda t: toxicity.features(m, t)[0] > 0
    assert f("you trash") and f("TRA5H!") and not f("put it in the trash can") and f("in the trash can, you trash") and not f("trashy") and f("moron") and not f("tumor") and not f("") and not f(None)


def test_length_normalises():
    m = toxicity.automaton({"idiot": 5.0})
    assert toxicity.features(m, "idiot " * 2)[1] > toxicity.features(m, "idiot " * 2 + "fine word " * 200)[1]


def test_length_in_any_script():
    assert toxicity.length("one two\nthree\tfour") == 4 and toxicity.length("") == 1 and toxicity.length("漢字" * 300) == 100
    m = toxicity.automaton({"idiot": 5.0})
    assert toxicity.features(m, "idiot\n" + "fine\n" * 200) == toxicity.features(m, "idiot " + "fine " * 200)


def naive(lexicon, exceptions, text):
    """The rule by looking at every place of the folded text for every entry."""
    folded = toxicity.fold(text)
    closed = lambda a, b: (a == 0 or not folded[a - 1].isalnum()) and (b == len(folded) or not folded[b].isalnum())
    harmless = [(a, a + len(p)) for p in exceptions for a in range(len(folded)) if folded.startswith(p, a) and closed(a, a + len(p))]
    best = {}
    for entry, w in lexicon.items():
        stem = entry.rstrip("*")
        for a in range(len(folded)):
            if folded.startswith(stem, a) and (a == 0 or not folded[a - 1].isalnum()):
                b = a + len(stem)
                if closed(a, b) == (stem == entry) and w > best.get(a, (0, 0))[1]:
                    best[a] = (b, w)
    total = sum(w for a, (b, w) in best.items() if not any(x <= a and b <= y for x, y in harmless))
    return (math.log1p(total), math.log1p(100 * total / max(1, len(re.findall(r"[^\x20\x09-\x0D]+", folded)), sum(c.isalpha() for c in folded) / 6))) if total else (0.0, 0.0)


def test_the_automaton_equals_naive_matching(docs):
    rng = random.Random(3)
    texts = [r["text"] for r in docs.filter("text is not null and length(text) < 2000").orderBy("doc_id").select("text").limit(60).collect()]
    folded = sorted({w for t in texts for w in toxicity.WORDS.findall(toxicity.fold(t))})
    lexicon = {w: 1 + rng.random() for w in rng.sample(folded, 60)} | {f"{w[:n]}*": 1 + rng.random() for w in rng.sample(folded, 60) for n in [4] if len(w) > 4}
    exceptions = sorted({p for t in texts for p in toxicity.phrases(toxicity.fold(t), lexicon)})[::3]
    assert exceptions
    m = toxicity.automaton(lexicon, exceptions)
    for t in texts + ["", "x", *lexicon, *exceptions, "trash can"]:
        assert toxicity.features(m, t) == pytest.approx(naive(lexicon, [*exceptions, *map(toxicity.fold, toxicity.EXCEPTIONS)], t))


def test_the_lexicon_equals_plain_counting(spark, docs, small):
    rows = [(r["text"], r["toxic"]) for r in docs.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").filter("text is not null").select("text", "toxic").collect()]
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"), least_docs=2, least_weight=0.5)
    n = [sum(y == k for _, y in rows) for k in (0, 1)]
    df, mass = {}, {}
    for t, y in rows:
        found = toxicity.WORDS.findall(toxicity.fold(t))
        found += [f"{w[:k]}*" for w in found for k in (4, 5, 6, 7) if len(w) > k]
        for w in set(found):
            df.setdefault(w, [0, 0])[y] += 1
            mass.setdefault(w, [0.0, 0.0])[y] += math.log2(1 + found.count(w))
    want = {w: math.log((mass[w][1] + 0.5) / (n[1] + 1)) - math.log((mass[w][0] + 0.5) / (n[0] + 1)) - 2 * math.sqrt(1 / b + 1 / (g + 0.5)) for w, (g, b) in df.items() if b >= 2}
    want = {w: x for w, x in want.items() if x >= 0.5}
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w], abs=1e-8) for w in want)


def test_harmless_phrases_are_learnt(spark):
    rows = [("you idiot there", 1)] * 200 + [("a fine village idiot stands", 0)] * 60 + [("words of peace", 0)] * 2000
    df = spark.createDataFrame(rows, "text string, toxic int")
    lexicon = toxicity.learn_lexicon(df)
    exceptions = toxicity.learn_exceptions(df, lexicon)
    assert toxicity.fold("village idiot") in exceptions and toxicity.fold("you idiot") not in exceptions
    m = toxicity.automaton(lexicon, exceptions)
    assert toxicity.features(m, "the village idiot")[0] < toxicity.features(m, "the idiot")[0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    got = queries.op7_toxicity(spark, sf).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    test = got[got["held_out"]]
    caught, clean = test[test["toxic"] == 1]["predicted"], test[test["toxic"] == 0]["predicted"]
    assert caught.mean() >= 0.85 and clean.mean() <= 0.01


def test_rare_toxic_words_enter(spark):
    rows = [("common insult here", 1)] * 1000 + [("fine words here", 0)] * 6000 + [("vrakling here", 1)] * 10 + [("seldom here", 1)] * 4
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert {toxicity.fold("insult"), toxicity.fold("vrakling")} <= set(lexicon) and "seidom" not in lexicon and "here" not in lexicon


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (6, 0), (7, None), (None, 1), (9, 1), (3, 0), (5, 1)], "doc_id long, toxic int")
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(none, labels).count() == 0 and len({r["score"] for r in toxicity.classify(odd, labels.limit(0)).collect()}) == 1


def test_labels_of_held_out_rows_teach_nothing(spark, docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    a, b = (sorted(map(tuple, toxicity.classify(docs, x).collect())) for x in (labels, turned))
    assert a == b
