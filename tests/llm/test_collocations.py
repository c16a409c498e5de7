"""Collocations against SQL and against plain counting with exact integers."""

from collections import Counter

import numpy as np
import pytest

from touchline.llm import collocations, queries

from ..oracle import check

LANGS = {"en": "the cat sat on the mat", "xx": "a b a b c"}


def plain(rows, least, longest=5, k=2000):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        run = []
        for w in [*collocations.split_words(text), collocations.EDGE]:
            if w != collocations.EDGE:
                run.append(w.decode())
                continue
            totals[lang] += len(run)
            for n in range(1, longest + 1):
                counts.update((lang, *run[i : i + n]) for i in range(len(run) - n + 1))
            run = []
    cand = {p: n for p, n in counts.items() if n >= least and len(p) > 2}
    out = []
    for (lang, *w), a in cand.items():
        cuts = [(1000 * a * totals[lang] // (counts[(lang, *w[:c])] * counts[(lang, *w[c:])]), c) for c in range(1, len(w))]
        score, c = min(cuts)
        hidden = any(q[0] == lang and len(q) > len(w) + 1 and n >= a and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1)) for q, n in cand.items())
        if not hidden:
            out.append((lang, " ".join(w), a, counts[(lang, *w[:c])], counts[(lang, *w[c:])], totals[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:k]
        ranked += [(lang, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def test_query_equals_its_sql(spark):
    check(queries.op11_collocations, queries.COLLOCATIONS_SQL, spark, "/root/testdata/sf0.01")


@pytest.mark.parametrize("bits", [4, 22])
def test_equals_plain_counting_however_small_the_bitmaps(spark, docs, bits):
    rows = [(r["text"], r["lang"]) for r in docs.limit(60).select("text", "lang").collect()]
    found = collocations.top_collocations(spark.createDataFrame(rows, "text string, lang string"), least=12, bits=bits)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 12)


def test_pieces_overlaps_and_inner_phrases(spark):
    rows = [("a a a a. a b\nB c, A\tB", "x"), ("A b; c d e f g c d e f g", None), (None, "x"), ("", "y"), (" .,;", "y"), ("d e", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    found = sorted(tuple(r) for r in collocations.top_collocations(df, least=2).collect())
    assert found == plain(rows, 2)
    assert {(r[0], r[2]): r[3] for r in found}[("x", "a a")] == 3 and ("und", "c d e f g") in {(r[0], r[2]) for r in found}
    assert ("und", "c d") not in {(r[0], r[2]) for r in found} and ("und", "d e") in {(r[0], r[2]) for r in found}


def test_a_scores_product_beyond_64_bits(spark):
    frequent = spark.createDataFrame([("x", 1, "p", 4 * 10**12), ("x", 1, "q", 5 * 10**12), ("x", 2, "p q", 3 * 10**12)], "lang string, size int, phrase string, f long")
    totals = spark.createDataFrame([("x", 9 * 10**16)], "lang string, n long")
    assert collocations.scored(frequent, totals).first()["score"] == 1000 * 3 * 10**12 * 9 * 10**16 // (4 * 10**12 * 5 * 10**12)


def test_chunks_and_many_languages(spark, monkeypatch):
    rows = [(f"common words here w{i % 7} . tail", f"l{i % 23}" if i % 4 else "hot") for i in range(2000)]
    monkeypatch.setattr(collocations, "CHUNK", 50)
    run = collocations._counted(1, 10, False, None, None)
    import pandas as pd

    out = pd.concat(run(iter([pd.DataFrame({"text": [r[0] for r in rows[i : i + 100]], "lang": [r[1] for r in rows[i : i + 100]]}) for i in range(0, 2000, 100)])))
    assert out[out["phrase"] == "common"]["n"].sum() == 2000 and out[out["phrase"].isna() & out["bucket"].isna()]["n"].sum() == 10_000


def test_bitmap_and_windows():
    rows = [(1, bytes([0b101] + [0] * 4095)), (3, bytes([0, 1] + [0] * 4094))]
    told = collocations.Bitmap(rows, 17)
    assert np.flatnonzero(told.has(np.arange(1 << 17, dtype=np.uint64))).tolist() == [0, 2, 2 * 32768 + 8]
    assert collocations.within(np.array([0, 1, 0, 0], bool), 2).tolist() == [False, False, True]
    assert collocations.within(np.array([0], bool), 2).tolist() == []


def test_odd_rows(spark, odd, none):
    found = collocations.top_collocations(odd, least=3)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    told = {(r["lang"], r["phrase"]): r["a"] for r in found.collect()}
    assert told[("la", "lorem ipsum dolor lorem ipsum")] == 59_999
    assert collocations.top_collocations(none).count() == 0
