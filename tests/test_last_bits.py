"""Arithmetic as the SQL has it, to the last bit: what is rounded or ranked afterwards can differ by a whole row otherwise."""

import duckdb
from pyspark.sql import functions as F

from touchline.operators import enriched as en
from touchline.operators import forecast as fc
from touchline.plans import sql as S
from touchline.plans.series import weekly


def test_structural_forecast_equals_its_sql_unrounded(spark, small):
    columns = ["player_id", "gameweek", "enr_mean", "enr_var", "enr_down"]
    con = duckdb.connect()
    con.execute("SET threads = 1")  # more threads sum in an order of their own
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{small}/events.parquet'")
    expected = con.execute(f"WITH {S.ENRICHED} SELECT {', '.join(columns)} FROM enr ORDER BY ALL").fetchall()
    got = sorted(tuple(r) for r in en.enriched(weekly(spark, small)).select(columns).collect())
    assert got == expected and len(got) > 300


def test_blend_equals_its_sql_unrounded(spark):
    rows = [(k * 0.37, 1 + k * 0.013, k * 0.021, k % 4 / 3) for k in range(300)]
    df = spark.createDataFrame(rows, "m double, v double, d double, recent double")
    said = fc.live_blend(F.col("m"), F.col("v"), F.col("d"), F.lit(3.0), F.lit(5.0), F.col("recent"), F.when(F.col("m") > 50, 0.5))
    got = [tuple(r) for r in df.select(*said.values()).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (m DOUBLE, v DOUBLE, d DOUBLE, recent DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    expected = con.execute("""WITH x AS (SELECT *, rowid AS i, least(greatest(0.05e0, recent), CASE WHEN m > 50 THEN 0.5e0 ELSE 1e0 END) AS a FROM t)
        SELECT greatest(0, (0.8e0 * m + 0.2e0 * 3) * a), greatest(0.1e0, (0.64e0 * v + 0.04e0 * 5) * a), greatest(0, (0.8e0 * d + 0.2e0 * sqrt(2.5e0)) * a) FROM x ORDER BY i""").fetchall()
    assert got == expected
