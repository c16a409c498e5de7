import re

import pytest
from pyspark.sql import functions as F

from touchline.llm import mixture


def plain_targets(sizes: dict, weights: dict, repeats: int = 3) -> dict:
    """Share by weight; what exceeds the caps is shared again among the rest until nothing does."""
    total, fixed_ = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in fixed_]
        left = total - sum(fixed_.values())
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > repeats * sizes[s]]
        if not over:
            return fixed_ | share
        fixed_ |= {s: float(repeats * sizes[s]) for s in over}


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_targets_and_taken(spark, name):
    rows = spark.read.parquet(f"/root/testdata/{name}/documents.parquet")
    got = mixture.mix(rows, keep_text=False).toPandas()
    texts = rows.toPandas()
    sizes = texts.assign(n=texts["text"].map(size_of)).fillna({"source": "~null"}).groupby("source")["n"].sum().to_dict()
    order = sorted(sizes, key=lambda s: (s == "~null", s))
    expected = plain_targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    by = got.fillna({"source": "~null"}).groupby("source")
    assert by["target"].first().to_dict() == pytest.approx(expected)
    assert by["source_size"].first().to_dict() == sizes
    assert (abs(by["taken"].sum() - by["target"].first()) <= 1).all() and sum(expected.values()) == pytest.approx(sum(sizes.values()))
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all() and len(got) == len(texts)


def test_caps_that_chain(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 5000), ("b", 10), ("c", 100), (None, 40), ("d", 3)])]
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep_text=False).toPandas()
    sizes = {"a": 5000, "b": 10, "c": 100, "d": 3, None: 40}
    expected = plain_targets(sizes, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2})
    assert {None if isinstance(s, float) else s: t for s, t in zip(got["source"], got["target"])} == pytest.approx(expected)


def test_copies_and_order(spark, docs):
    mixed = mixture.mix(docs)
    out = mixture.emit(mixed)
    words = out.withColumn("n", mixture.word_count(F.col("text"))).groupBy("doc_id").agg(F.sum("n").alias("n"))
    both = mixed.filter("taken > 0").join(words, "doc_id")
    assert both.filter("n != taken").count() == 0 and both.count() == words.count()
    assert out.filter("position < 0 or position > 1 or position is null").count() == 0
    # a source whose weight rises stands later on average than one whose weight falls
    late = {r[0]: r[1] for r in out.groupBy((F.col("__w_end") > F.col("__w_start")).alias("rises"), (F.col("__w_end") < F.col("__w_start")).alias("falls")).agg(F.avg("position")).select(F.col("rises").cast("int") - F.col("falls").cast("int"), "avg(position)").collect()}
    assert late[1] > late[-1]


def test_schedule_is_inverted(spark):
    u, a, b = 0.3, 0.5, 1.5
    t = spark.range(1).select(mixture.invert(F.lit(u), F.lit(a), F.lit(b)).alias("t")).first()["t"]
    assert (a * t + (b - a) * t * t / 2) / ((a + b) / 2) == pytest.approx(u)


def test_reruns_agree_whatever_the_partitions(spark, docs):
    a = sorted(map(tuple, mixture.mix(docs, keep_text=False).select("doc_id", "taken", "position").collect()))
    b = sorted(map(tuple, mixture.mix(docs.repartition(7), keep_text=False).select("doc_id", "taken", "position").collect()))
    assert a == b


def test_odd_rows(odd, none):
    got = mixture.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] == 0 for r in got if not (r["text"] or "").strip())
    assert mixture.emit(mixture.mix(odd)).count() > 0 and mixture.mix(none).count() == 0 and mixture.emit(mixture.mix(none)).count() == 0


def test_main_path_is_native(spark, docs):
    plan = mixture.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name):
    from tests.oracle import check
    from touchline.llm import queries

    check(queries.op2_mixture, queries.MIXTURE_SQL, spark, f"/root/testdata/{name}")


def test_columns_named_like_the_plan_are_kept(spark, docs):
    names = ["quota", "w_start", "w_end", "before_bucket", "copy", "source_key", "w", "cap", "level"]
    theirs = docs.limit(50).withColumns({c: F.lit(f"their {c}") for c in names})
    mixed = mixture.mix(theirs)
    assert mixed.count() == 50 and all(mixed.filter(F.col(c) != f"their {c}").count() == 0 for c in names)
    copies = mixture.emit(mixed)
    assert copies.filter("copy != 'their copy' or quota != 'their quota'").count() == 0
    plain = mixture.emit(mixture.mix(docs.limit(50)))
    key = lambda df: sorted((r["doc_id"], r["position"], r["text"]) for r in df.collect())
    assert key(copies) == key(plain)
