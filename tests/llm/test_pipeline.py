"""The five stages, each against what it was given."""

import numpy as np
import pytest

import corpus_pipeline as cp

from .test_packing import EXACT
from .test_simhash import plain_components


@pytest.fixture(scope="module")
def steps(spark, small):
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    out.append(docs.toPandas())
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, small).checkpoint()
        out.append(docs.toPandas())
    return out


def test_stages_are_named_and_keep_the_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["language ID", "SimHash near-dedup", "secret scans", "mixing", "packing"] and cp.ORACLE_SQL is None
    assert all(list(s.columns) == cp.COLUMNS for s in steps[:-1])


def test_clean_documents_pass_the_language_stage(steps):
    assert set(steps[1]["doc_id"]) >= set(steps[0][steps[0]["text"].str.len() > 100]["doc_id"]) and set(steps[1]["doc_id"]) <= set(steps[0]["doc_id"])


def test_one_document_of_each_group_stays(steps):
    rows = list(steps[1][["doc_id", "text"]].itertuples(index=False, name=None))
    assert sorted(steps[2]["doc_id"]) == sorted({c for *_, c in plain_components(rows)})


def test_secrets_are_gone_and_nothing_else(steps):
    from .test_secrets import plain

    before, after = steps[2].set_index("doc_id")["text"], steps[3].set_index("doc_id")["text"]
    assert set(before.index) == set(after.index)
    for i, t in before.items():
        if plain(t)[4]:
            assert "[SECRET]" in after[i]
        elif "[SECRET]" not in after[i]:
            assert after[i] == t
    assert (steps[3]["n_chars"] == steps[3]["text"].str.len()).all()


def test_the_mix_draws_on_every_source(steps):
    assert set(steps[4]["source"].dropna()) == set(steps[3]["source"].dropna()) and set(steps[4]["doc_id"]) <= set(steps[3]["doc_id"]) and steps[4]["doc_id"].value_counts().max() <= 3


@pytest.mark.skipif(EXACT is None, reason="the public tokenizers aren't installed")
def test_all_tokens_are_packed(steps):
    tokens = sum(len(x.ids) + 1 for x in EXACT.encode_batch([t or "" for t in steps[4]["text"]], add_special_tokens=False))
    assert steps[5]["length"].sum() == tokens
    used = steps[5].groupby("sequence_id")["length"].sum()
    assert (used <= 2048).all() and np.all((used == 2048) | (used & (used - 1) == 0))


@pytest.mark.skipif(EXACT is None, reason="the public tokenizers aren't installed")
def test_sequences_follow_the_training_order(spark, tmp_path):
    """Files of the mix follow each other; each step's sequences come before the next one's, copies stay apart."""
    rows = [(i, f"word{i} " * 300, None, "s", 0) for i in range(320)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.unionByName(df.filter("doc_id < 10")).repartitionByRange(32, "doc_id").write.parquet(f"{tmp_path}/mix")
    placed = cp.steps(spark.read.parquet(f"{tmp_path}/mix"))
    bounds = sorted((r["a"], r["b"]) for r in placed.groupBy("__step").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "a").join(placed.groupBy("__step").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "b"), "__step").collect())
    assert len(bounds) == cp.STEPS and all(x[1] < y[0] for x, y in zip(bounds, bounds[1:]))
    got = cp.pack(spark, spark.read.parquet(f"{tmp_path}/mix"), "").toPandas()
    order = got.assign(group=got["sequence_id"] // 2**32).groupby("group")["doc_id"].agg(["min", "max"]).sort_index()
    assert (order["max"].to_numpy()[:-1] < order["min"].to_numpy()[1:]).all()
    assert got.groupby("row_id")["doc_id"].nunique().max() == 1 and got["row_id"].nunique() == 330
    assert (got.groupby("row_id")["length"].sum() == got.groupby("row_id")["doc_tokens"].first()).all()


def test_every_stage_takes_odd_and_empty_tables(spark, odd, none, small):
    for name, stage in cp.STAGES:
        got = stage(spark, odd, small)
        assert got.columns == cp.COLUMNS or name == "packing"
        rows = got.collect()
        if name == "language ID":
            assert all(r["text"] and any(map(str.isalpha, r["text"])) for r in rows) and None not in {r["lang"] for r in rows}
        if name == "SimHash near-dedup":
            assert [r["doc_id"] for r in rows if not (r["text"] or "").strip()] == [2] and sum(r["doc_id"] in (1, 6, 9) for r in rows) == 1 and sum(r["doc_id"] == 8 for r in rows) == 1
        if name == "secret scans":
            assert len(rows) == odd.count() and sum(r["text"] is None for r in rows) == 1
        if name == "mixing":
            assert all((r["text"] or "").strip() for r in rows)
        if name == "packing":
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
        assert stage(spark, none, small).count() == 0


def test_run_gives_the_last_stage(spark, small, steps):
    got = cp.run(spark, small)
    assert list(got.columns) == list(steps[5].columns) and got.count() == len(steps[5])
