"""Decontamination against SQL and against plain search of every window."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import decontaminate, queries

from ..oracle import check


def plain(words, items, window):
    hit, names = set(), set()
    for name, own in items:
        n = min(window, len(own))
        wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in wanted:
                hit.update(range(i, i + n))
                names |= {name} - {None}
    return hit, sorted(names)


def built(items, window):
    out = decontaminate.Automaton(window)
    for name, own in items:
        out.add(name, own)
    out.close()
    return out


WORDS = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(st.lists(WORDS, max_size=7), st.lists(st.sampled_from([b"a", b"b", b"c", b"z"]), max_size=50), st.integers(1, 6))
def test_the_automaton_equals_plain_search(texts, words, window):
    items = [(None if i == 4 else f"i{i % 5}", own) for i, own in enumerate(texts)]
    spans, names = built(items, window).hits(words)
    hit, expected = plain(words, items, window)
    assert {i for a, b in spans for i in range(a, b)} == hit and names == expected
    assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_long_items_that_share_passages():
    rng = random.Random(4)
    shared = [b"%d" % rng.randrange(30) for _ in range(60)]
    items = [(str(i), [b"%d" % rng.randrange(30) for _ in range(20)] + shared[i : i + 25] + [b"%d" % rng.randrange(30) for _ in range(20)]) for i in range(30)]
    words = [b"%d" % rng.randrange(30) for _ in range(50)] + shared + items[3][1] + [b"x"] + items[7][1][5:14]
    spans, names = built(items, 10).hits(words)
    hit, expected = plain(words, items, 10)
    assert {i for a, b in spans for i in range(a, b)} == hit and names == expected and len(names) > 10


def test_query_equals_its_sql(spark, small):
    check(queries.op13_decontamination, queries.DECONTAMINATION_SQL, spark, small)
    found = queries.op13_decontamination(spark, small)
    assert found.filter("contaminated").count() > 0 and found.filter("not contaminated").count() > 0


@pytest.mark.parametrize("shard_words", [40, 300, 10**6])
def test_any_number_of_automata_gives_the_same(spark, small, docs, shard_words):
    items = spark.read.parquet(f"{small}/benchmark.parquet").unionByName(spark.createDataFrame([(900, "the"), (901, "and, the"), (None, "of the"), (902, ""), (903, None)], "item_id long, text string"))
    kept = docs.limit(80)
    found = decontaminate.marked(kept, items, shard_words=shard_words).collect()
    rows = [(None if r["item_id"] is None else str(r["item_id"]), decontaminate.split_words(r["text"])) for r in items.collect()]
    assert len(found) == 80 and set(docs.columns) < set(found[0].asDict())
    for r in found:
        words = decontaminate.split_words(r["text"])
        hit, names = plain(words, rows, 10)
        flat = r["hit_spans"]
        assert {i for a, b in zip(flat[0::2], flat[1::2]) for i in range(a, b)} == hit and r["hit_items"] == names and r["n_words"] == len(words)


def test_shards_have_their_bound(spark, small):
    items = spark.range(3000).selectExpr("id as item_id", "repeat('word ', 1 + id % 40) as text")
    dealt, n = decontaminate.dealt(items, 5_000, id_col="item_id", text_col="text")
    sizes = [r["s"] for r in dealt.groupBy("shard").agg({"text": "count"}).withColumnRenamed("count(text)", "s").collect()]
    most = max(r["w"] for r in dealt.selectExpr("shard", "ceil((length(text) + 1) / 2) as size").groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "w").collect())
    assert sum(sizes) == 3000 and most <= 5_000 + 101 and n == dealt.agg({"shard": "max"}).first()[0] + 1


def test_texts_without_spans():
    text = "Keep, THIS part: one two—three four! And rest."
    words = decontaminate.split_words(text)
    assert words == [b"keep", b"this", b"part", b"one", "two—three".encode(), b"four", b"and", b"rest"]
    assert decontaminate.without(text, [3, 6], 1) == "Keep, THIS part: ! And rest." and decontaminate.without(text, [3, 6], 4) == text
    assert decontaminate.without(text, [0, 1, 7, 8], 1) == ", THIS part: one two—three four! And ." and decontaminate.without(None, [], 1) is None


def test_clean_by_coverage_and_span(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, passage), (2, "short item")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, passage), (2, f"{filler} {passage.upper()}. {filler}"), (3, f"a short item {filler}"), (4, filler), (5, None), (6, "")], "doc_id long, text string")
    kept = {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, items, least_span=3).collect()}
    assert set(kept) == {2, 3, 4, 5, 6} and kept[2] == f"{filler} . {filler}" and kept[3] == f"a short item {filler}" and kept[5] is None
    assert {r["doc_id"]: r["text"] for r in decontaminate.clean(docs, items).collect()}[3] == f"a  {filler}"


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox"), (1, "naïve café"), (None, "orphan row"), (2, None), (3, "lorem ipsum dolor lorem ipsum dolor lorem ipsum dolor lorem")], "item_id long, text string")
    rows = decontaminate.marked(odd, items).collect()
    assert len(rows) == odd.count() and all(r["size"] == "theirs" for r in rows)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[5]["hit_spans"] == [0, 179_998] and by_id[5]["hit_items"] == ["3"] and by_id[7]["hit_items"] == by_id[1]["hit_items"] == ["1"]
    assert by_id[None]["hit_items"] == [] and by_id[None]["hit_spans"] == [1, 3] and by_id[2]["n_words"] == 0
    assert decontaminate.marked(none, items).count() == 0
    told = decontaminate.digests(odd, items.limit(0)).collect()
    assert not any(r["contaminated"] or r["n_hit"] or r["n_items"] for r in told)
