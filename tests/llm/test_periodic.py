"""Periodic runs against plain search of every stretch."""

import hashlib
import random
import time
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import periodic, queries


def plain_runs(words, least=24, times=3):
    """Maximal stretches for every period from the definition, kept where no smaller period fits them."""
    n, found = len(words), set()
    for p in range(1, n // times + 1):
        start = 0
        while start < n - p:
            end = start
            while end < n - p and words[end] == words[end + p]:
                end += 1
            if end > start:
                s, e = start, end + p
                smallest = next(q for q in range(1, p + 1) if all(words[i] == words[i + q] for i in range(s, e - q)))
                if smallest == p and e - s >= max(least, times * p):
                    found.add((s, e - s, p))
            start = max(end, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def ids(words):
    return periodic.word_ids(list(words))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=90), st.integers(1, 9), st.integers(0, 60), st.lists(st.sampled_from("abc"), max_size=30))
def test_equals_plain_search(head, p, tail, rest):
    words = head + [(head + ["c"])[i % min(p, len(head) + 1)] for i in range(tail)] + rest
    assert periodic.runs_of(ids(words)) == plain_runs(words)


@pytest.mark.parametrize("seed", range(40))
def test_nested_and_broken_runs(seed):
    rng = random.Random(seed)
    inner = [rng.choice("abcd") for _ in range(rng.randint(1, 12))] * rng.randint(1, 9)
    outer = (inner + [rng.choice("xyz") for _ in range(rng.randint(0, 5))]) * rng.randint(1, 6)
    words = [rng.choice("abcdxyz") for _ in range(rng.randint(0, 20))] + outer + [rng.choice("abcd") for _ in range(rng.randint(0, 20))]
    if rng.random() < 0.5:
        words[rng.randrange(len(words))] = "?"
    assert periodic.runs_of(ids(words)) == plain_runs(words)
    for least, times in ((6, 3), (10, 4), (30, 5)):
        assert periodic.runs_of(ids(words), least=least, times=times) == plain_runs(words, least, times)


@pytest.mark.parametrize("parts", [1, 2, 5, 17])
def test_ranges_of_lags_find_the_same_runs(parts):
    rng = random.Random(parts)
    for _ in range(10):
        words = [rng.choice("ab") for _ in range(40)] + [rng.choice("abc") for _ in range(rng.randint(1, 30))] * rng.randint(2, 12)
        ranges = periodic.lag_ranges(len(words), parts)
        assert [x for a, b in ranges for x in range(a, b)] == list(range(1, len(words) // 3 + 1))
        assert set().union(*(periodic.runs_of(ids(words), lags=r) for r in ranges)) == set(plain_runs(words))


def test_the_bounds_of_a_run():
    assert periodic.runs_of(ids("ab" * 12)) == [(0, 24, 2)] and periodic.runs_of(ids("ab" * 11 + "a")) == []
    assert periodic.runs_of(ids("abcdefghij" * 3)) == [(0, 30, 10)] and periodic.runs_of(ids("abcdefghij" * 3)[:29]) == []
    assert periodic.runs_of(ids("a" * 23)) == [] and periodic.runs_of(ids("a" * 24)) == [(0, 24, 1)]
    assert periodic.runs_of(ids("")) == periodic.runs_of(ids("a")) == []


def test_a_text_of_one_word_and_one_without_repeats_take_no_quadratic_time():
    began = time.process_time()
    assert periodic.runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    assert periodic.runs_of(np.arange(300_000)) == []
    assert periodic.runs_of(np.zeros(300_000, np.int64), lags=(1_000, 100_001)) == [(0, 300_000, 1)]
    noise = np.random.default_rng(1).integers(0, 3, 300_000)
    assert all(length >= 24 for _, length, _ in periodic.runs_of(noise))
    assert time.process_time() - began < 60


def test_strongest_and_kept():
    assert periodic.strongest([(5, 30, 10), (0, 24, 8), (40, 31, 10)]) == (40, 31, 10) and periodic.strongest([(9, 24, 8), (5, 30, 10)]) == (5, 30, 10) and periodic.strongest([]) is None
    assert periodic.kept_words(10, [(2, 6, 2)]).tolist() == [True] * 4 + [False] * 4 + [True] * 2


def expected(doc_id, text):
    words = periodic.planted(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest(),
    )


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def test_query_equals_plain_search_on_short_texts(spark, small, docs):
    """Texts of up to 600 words, as plain search takes cubic time; the query itself runs on all."""
    found = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, small).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert set(found) == {r["doc_id"] for r in rows}
    some = [r for r in rows if len((r["text"] or "").split()) <= 600]
    assert len(some) > len(rows) / 2 and sum(found[r["doc_id"]][1] > 0 for r in some) > 3
    for r in some:
        assert found[r["doc_id"]] == expected(*r)


def test_odd_rows_and_long_texts_dealt_by_lags(spark, odd, none):
    whole = sorted((tuple(r) for r in periodic.digests(odd.select("doc_id", "text")).collect()), key=key)
    dealt = sorted((tuple(r) for r in periodic.digests(odd.select("doc_id", "text"), long_chars=30).collect()), key=key)
    assert whole == dealt and len(whole) == odd.count()
    by_id = {r[0]: r for r in whole}
    assert by_id[5][1:6] == (1, 0, 180_000, 3, 60_000_000) and by_id[2][1:6] == (0, None, None, None, None) and None in by_id
    assert by_id[2][7] == hashlib.sha256(b"").hexdigest()
    assert periodic.digests(none).count() == periodic.periodic_runs(none).count() == periodic.collapse(none).count() == 0


def test_collapse_keeps_columns_and_texts_without_runs(spark, odd):
    rows = {(r["doc_id"], r["text"]): r for r in periodic.collapse(odd).collect()}
    assert set(odd.columns) < set(next(iter(rows.values())).asDict())
    for (doc_id, text), r in rows.items():
        assert r["collapsed"] == ("lorem ipsum dolor" if doc_id == 5 else text) and r["size"] == "theirs"
    runs = {r["doc_id"]: r["runs"] for r in periodic.periodic_runs(odd).collect()}
    assert [tuple(x) for x in runs[5]] == [(0, 180_000, 3)] and runs[1] == []
