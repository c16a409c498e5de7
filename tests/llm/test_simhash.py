import itertools

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm import queries, simhash


def plain_fingerprint(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, budget=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= budget:
            parent[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, f"{fps[i]:016x}", least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, name):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op9_simhash(spark, f"/root/testdata/{name}").select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == plain_components(rows)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_every_close_pair_meets_under_a_key_and_in_a_chain(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    a, b = np.uint64(x), np.uint64(y)

    def keys(v, length):
        if length == 2:
            return set(simhash.posts(np.array([v]), None, 2, 4)[0].tolist())
        shorter = np.array(sorted(keys(v, length - 1)), np.uint64)
        return set(simhash.posts(np.full(len(shorter), v), shorter, length, 4)[0].tolist())

    # they meet, and still do when keys are extended along the chain
    assert all(keys(a, n) & keys(b, n) for n in (2, 3, 4))
    assert any(simhash.chained(np.array([a ^ b]), i, 4)[0] for i in range(simhash.SEGMENTS))


@pytest.mark.parametrize("most", [16_384, 20, 3])
def test_links_equal_all_pairs(spark, most):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(x) ^ int(sum(1 << int(b) for b in rng.choice(63, k, replace=False))) for x in base for k in (1, 2, 4, 5)]
    fps = [int(x) for x in base] + near
    # a dense ball: every fingerprint within two bits of one centre
    fps += [int(base[0]) ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(12), 2)]
    found = {tuple(sorted((r["a"], r["b"]))) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), most=most).collect()}
    wide = lambda v: v & (2**64 - 1)
    assert all((wide(a) ^ wide(b)).bit_count() <= 4 for a, b in found)
    parts = lambda pairs: components(sorted(set(fps)), pairs)
    assert parts(found) == parts({(a, b) for a, b in itertools.combinations(sorted(set(fps)), 2) if (wide(a) ^ wide(b)).bit_count() <= 4})


def components(nodes, pairs):
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(label[a], label[b])
            moved |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_budgets_that_the_keys_do_not_cover_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), budget=5)


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = simhash.near_duplicates(odd).select("doc_id", simhash.hex_of("fp"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and len({r["doc_id"] for r in kept.collect()}) == kept.count() == len({c for *_, c in plain_components(rows)})
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_a_chain_of_near_copies_is_one_component(spark):
    import pandas as pd

    from touchline.llm.components import components as grow

    n = 300
    links = spark.createDataFrame(pd.DataFrame({"a": range(n), "b": range(1, n + 1)}))
    assert {r["root"] for r in grow(links).collect()} == {0} and grow(links).count() == n + 1


def test_a_dense_ball_is_linked_whole_with_few_fingerprints_held(spark):
    """A centre, all that differ from it in one or two bits, and some of three: far more under one key than the bound."""
    from touchline.llm import simhash as sh

    centre = 0x0123456789ABCDEF
    ball = [centre] + [centre ^ m for m in sh.masks(24, 2)[1:]] + [centre ^ m ^ (1 << 63) for m in sh.masks(64, 1)[1:]]
    far = [centre ^ 0xFF ^ (0xFF << k) for k in range(8, 48, 8)]
    fps = sorted({*ball, *far})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    every = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in sh.components(sh.links(every, most=50)).collect()}
    expected: dict = {}
    left, n = set(fps), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            one = todo.pop()
            expected[one] = n
            near = [x for x in left if (x ^ one).bit_count() <= 4]
            left.difference_update(near)
            todo += near
    classes: dict = {}
    for x, s in zip(fps, signed):
        classes.setdefault(expected[x], set()).add(roots.get(s, s))
    assert all(len(v) == 1 for v in classes.values()) and len({next(iter(v)) for v in classes.values()}) == len(classes)


def test_owners_of_a_key_are_bounded_and_others_pass():
    from touchline.llm import simhash as sh

    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 2_000, np.uint64)
    keys, out = sh.posts(fps, None, 2, 4)
    for length in (3, 4):
        keys, out = sh.posts(out[:4_000], keys[:4_000], length, 4)
    own = sh.owned(keys, out)
    assert own.any() and not own.all()
    for k in np.unique(keys[own])[:50]:
        assert len(np.unique(out[own & (keys == k)])) <= 8192
    import pandas as pd

    base = np.uint64(0x1111222233334444)
    first = [base, base ^ np.uint64(1 << 60)]
    others = [base ^ np.uint64(m) for m in (3, 1 << 5, (1 << 60) | 1, 0xFFFF)]
    pdf = pd.DataFrame({"key": 7, "fp": np.array(first + others, np.uint64).view(np.int64), "own": [True] * 2 + [False] * 4})
    found = pd.concat(sh._passing(4)(iter([pdf.iloc[:1], pdf.iloc[1:4], pdf.iloc[4:], pdf.assign(key=8, own=True).iloc[:2]])))
    pairs = {(np.int64(a).astype(np.uint64), np.int64(b).astype(np.uint64)) for a, b in found.to_numpy()}
    linked = {frozenset((int(a), int(b))) for a, b in pairs}
    assert frozenset(map(int, first)) in linked and len({x for p in linked for x in p}) == 5 and int(others[3]) not in {x for p in linked for x in p}
