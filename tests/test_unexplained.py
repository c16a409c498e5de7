"""Values so large that no state explains them, and halves, against the SQL: tables larger than those of the tests, by repeating events."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from touchline.functions.arrays import nearest
from touchline.plans import catalog

from .oracle import check

NAMES = [
    "hmm_forward",
    "hmm_smooth",
    "fused_sequence",
    "fuse_estimates",
    "hmm_predict",
    "news_perturbation",
    "fusion_alpha",
    "walk_forward_scalar",
]


@pytest.fixture(scope="module")
def crowded(small, tmp_path_factory):
    """The events six times with further ids, so that many sums are beyond all states, and a player whose form is beyond doubt."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    some = f"SELECT * EXCLUDE (i) REPLACE (event_id + 1000 * i AS event_id) FROM '{small}/events.parquet', range(6) r(i)"
    sure = f"SELECT * REPLACE (event_id + 9000 AS event_id, 99 AS user_id, 900e0 AS value) FROM (SELECT * FROM '{small}/events.parquet' QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) = 1)"
    duckdb.connect().execute(f"COPY ({some} UNION ALL {sure}) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_beyond_all_states(spark, crowded, name):
    check(catalog.queries()[name], catalog.oracle_sql()[name], spark, crowded)


def test_beliefs_are_undefined_or_zero(spark, crowded):
    from touchline.operators import forecast
    from touchline.plans.series import weekly

    last = lambda **k: [r["b"] for r in forecast.series(weekly(spark, crowded), **k).select(F.element_at("hm", -1)["belief"].alias("b")).collect()]
    kept, undefined = last(), last(undefined=True)
    assert sum(map(sum, kept)) < len(kept) and not any(math.isnan(x) for b in kept for x in b)
    assert any(math.isnan(x) for b in undefined for x in b) and [0, 0, 0, 0, 1] in undefined


def test_nearest_is_the_rounding_of_the_sql(spark):
    values = [6.406875, 2.5e-5, -2.5e-5, 0.49999999999999994, 1e300, -1e300, 0.0, 1e-320, math.inf, -math.inf, math.nan, 123456.7890125, 7.224999999999999]
    values += [k / 200000 for k in range(-99, 99)] + [k * 1.000005 for k in range(99)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(nearest(F.col("v"), 5).alias("a")).collect()
    expected = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 5)", [v]).fetchone()[0] for v in values]
    assert [repr(r["a"] + 0.0) for r in rows] == [repr(v + 0.0) for v in expected]
