import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from touchline.llm import packing, queries

try:
    import public_tokenizers
    from tokenizers import Tokenizer

    EXACT = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
except ImportError:
    EXACT = None


@pytest.mark.skipif(EXACT is None, reason="the public tokenizers aren't installed")
@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_exact_round_trip(spark, name):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text").collect()}
    check(queries.op8_packing(spark, f"/root/testdata/{name}").toPandas(), texts)


def check(got, texts, size=2048):
    for doc, part in got.sort_values("start").groupby("doc_id"):
        ids = np.array([*EXACT.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (part["doc_tokens"] == len(ids)).all() and part["start"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and part["length"].sum() == len(ids) and (part["length"] > 0).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part["start"], part["length"])] == part["ids_crc32"].tolist()
    assert set(got["doc_id"]) == set(texts)
    padding = 0
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["length"])[:-1]] and (used := part["length"].sum()) <= size
        padding += 0 if used & (used - 1) == 0 else size - used
    assert padding == 0


@pytest.mark.skipif(EXACT is None, reason="the public tokenizers aren't installed")
@pytest.mark.parametrize("text", ["<|endoftext|> in the text", "a b c\r\n\t  d", "x" * 40_000, "😀" * 3000 + "\x00", "Ünï ½ ² Ⅷ ٣ हिन्दी 한국어", " \n" * 500])
def test_ids_are_those_of_the_library(text):
    assert packing.public_encoder()(text) == EXACT.encode(text, add_special_tokens=False).ids


def test_first_fit():
    tree = packing.FirstFit(4, 10)
    assert [tree.place(n) for n in (7, 6, 3, 4, 10, 1)] == [0, 1, 0, 1, 2, 3]


def test_first_fit_decreasing_equals_a_plain_loop():
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 100, 300).tolist()
    tree, free = packing.FirstFit(300, 100), []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        free[at:] = [100, *free[at + 1 :]] if at == len(free) else free[at:]
        free[at] -= n
        assert tree.place(n) == at


@pytest.mark.parametrize("lengths", [[], [1], [2048], [2049, 5, 2047], [4096 * 3 + 17, 1, 1], [1000] * 7])
def test_pack_keeps_every_token(lengths):
    found = packing.pack(lengths, 2048)
    for doc, n in enumerate(lengths):
        own = sorted((s, k) for row in found for d, s, k in row if d == doc)
        assert [s for s, _ in own] == [0, *np.cumsum([k for _, k in own])[:-1]] and sum(k for _, k in own) == n
    assert all((u := sum(p[2] for p in row)) == 2048 or u & (u - 1) == 0 for row in found)


def test_odd_rows(odd, none):
    got = packing.pack_documents(odd).toPandas()
    whole = got.groupby("doc_id", dropna=False)["length"].sum()
    assert whole[2] == 1 and whole[3] == 1 and got["doc_id"].isna().any()
    eight = got[got["doc_id"] == 8]
    assert eight["length"].sum() == 2 * eight["doc_tokens"].iloc[0]
    assert packing.pack_documents(none).count() == 0


def test_groups_are_bounded(docs):
    many = packing.pack_documents(docs, group_chars=50_000).toPandas()
    assert (many["sequence_id"] // 2**32).nunique() > 3 and many.groupby("doc_id")["length"].sum().sum() == packing.pack_documents(docs).toPandas()["length"].sum()


def test_repeated_rows_are_dealt_alike_however_they_come(spark):
    rows = [(1, "the same words again")] * 700 + [(2, "other words"), (2, "other words"), (None, None), (None, None), (3, "single")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (1, 7):
        out = packing.pack_documents(df.repartition(n), group_chars=2_000).drop("row_id")
        found.append(sorted(map(str, out.collect())))
        assert out.filter("doc_id = 1").agg(F.sum("length")).first()[0] == 700 * out.filter("doc_id = 1").first()["doc_tokens"]
        assert out.filter("doc_id = 1").select(F.shiftright("sequence_id", 32)).distinct().count() > 1
    assert found[0] == found[1]
