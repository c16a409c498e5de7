import hashlib
import re

import pytest
from pyspark.sql import functions as F

from touchline.llm import queries, secrets

PATTERNS = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24)]


def plain(text):
    spans = [(m.start(), k, m.end(), name) for k, (name, p, fine) in enumerate(PATTERNS) for m in re.finditer(p, text or "", re.ASCII) if fine(m)]
    named = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(spans))
    return tuple(sum(s[3] == n for s in spans) for n, *_ in PATTERNS) + (hashlib.sha256(named.encode()).hexdigest(), named)


KEY = "AKIA" + "Q7" * 8
TEXTS = [
    "password = hunter22 and PassWord:'abcdef'", "api_key=\"sk-12345.abc/+=\" apikey: short", KEY + " and " + KEY[:19] + " AKIAAKIA" + "Z" * 14, "deadbeef" * 3 + " " + "deadbee" * 3 + " x" + "a1" * 12 + "g", "😀é token  =  abcdef123 " + "0" * 24,
    "secret:secret:secret=abcdefg", "token=" + "f" * 30, "", None, "passwd=\nabcdef", "ſecret=abcdefgh KEY api-key=abcdefgh",
]


def test_base_spans_equal_plain_patterns(spark):
    df = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.digest_columns(secrets.scan(df)).collect()}
    for i, t in enumerate(TEXTS):
        *counts, digest, named = plain(t)
        r = got[i]
        assert [r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]] == [*counts, digest], (i, t, r["spans"])
        assert set(filter(None, named.split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, name):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{name}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op6_secrets(spark, f"/root/testdata/{name}").collect():
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == plain(texts[r["doc_id"]])[:4]


def test_owners_tell_examples_from_credentials(spark):
    own, shared = "Zx9" + "kQ2w" * 6, "Ab1" + "Cd2e" * 6
    rows = [(1, f"use {own} here", "a"), (2, f"again {own}", "b"), *[(10 + i, f"sample {shared} copied", f"s{i % 5}") for i in range(20)]]
    got = {r["doc_id"]: r for r in secrets.digest_columns(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got[1]["spans"] == f"token:4:{4 + len(own)}" and got[1]["n_live"] == 1 and all(got[10 + i]["spans"] == "" for i in range(20))


def test_repositories_tell_examples_inside_one_source(spark):
    own, shared = "Zx9" + "kQ2w" * 6, "Ab1" + "Cd2e" * 6
    rows = [(i, f"use {own} here", "a") for i in range(10)] + [(100 + i, f"sample {shared} password=hunter22", "a") for i in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.digest_columns(secrets.scan(df)).collect()}
    assert all(got[i]["spans"] == f"token:4:{4 + len(own)}" and got[i]["n_live"] == 1 for i in range(10))
    assert all(got[100 + i]["spans"].startswith("assign:") and "token" not in got[100 + i]["spans"] and (got[100 + i]["n_live"], got[100 + i]["n_copied"]) == (0, 1) for i in range(11))
    assert {r["text"] for r in secrets.redact(df).collect()} == {"use [SECRET] here", f"sample {shared} [SECRET]"}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a password=hunter22 b", "s"), (2, "clean", "s"), (3, None, "s"), (4, "token=" + "f" * 30 + " end", "s"), (4, "token=" + "f" * 30 + " end", "s")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["text"] or "") for r in secrets.redact(df).collect())
    assert got == [(1, "a [SECRET] b"), (2, "clean"), (3, ""), (4, "[SECRET] end"), (4, "[SECRET] end")]


def test_odd_rows(odd, none):
    assert secrets.scan(odd).count() == odd.count() and secrets.redact(odd).columns == odd.columns
    assert secrets.redact(odd).exceptAll(odd).count() == 0
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0


def test_many_matches_in_one_text(spark):
    """Spans of a generated file of 100,000 matches, half of them mixed strings beside base spans."""
    import time

    text = " ".join(f"password=hunter{i:06d} Zx9{i:06d}kQ2wAb1Cd2e{i % 7}" for i in range(50_000))
    df = spark.createDataFrame([(1, text, "a"), (2, "password=hunter22", "b")], "doc_id long, text string, source string")
    began = time.time()
    got = {r["doc_id"]: r for r in secrets.digest_columns(secrets.scan(df)).collect()}
    assert got[1]["n_assign"] == 50_000 and got[1]["base_sha256"] == plain(text)[3] and got[1]["spans"].count("token:") == 50_000
    assert time.time() - began < 150
    fewer = df.withColumn("text", F.substring("text", 1, text.index(" password=hunter005000")))
    assert secrets.redact(fewer).filter("doc_id = 1").first()["text"] == "[SECRET] " * 9_999 + "[SECRET]"


def test_main_path_is_native(spark, docs):
    plan = secrets.redact(docs.withColumn("x", F.lit(1)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name):
    from tests.oracle import check

    check(queries.op6_secrets, queries.SECRETS_SQL, spark, f"/root/testdata/{name}")


def test_a_text_of_many_matches_takes_linear_time(spark):
    import time

    piece = "token = abcDEF123456 " + "0123456789abcdef" * 2 + " Zz9" + "Qw3rTyU1oP" * 2 + " "
    took = []
    for n in (2_000, 16_000):
        df = spark.createDataFrame([(1, piece * n, "s")], "doc_id long, text string, source string")
        began = time.time()
        r = secrets.digest_columns(secrets.scan(df)).first()
        took.append(time.time() - began)
        assert r["n_assign"] == n and r["n_hex"] == n
    assert took[1] < 30
