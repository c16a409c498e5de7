import pytest
from pyspark.sql import functions as F

from touchline.functions import fixtures, news

# text, availability, minutes risk, confidence, category
CASES = [
    ("Ruled out for 3 weeks with a hamstring injury", 0.0, 0.0, 0.9, "unavailable"),
    ("Out for 6 months", 0.0, 0.0, 0.6, "unavailable"),
    ("Doubtful, 50% chance of playing", 0.5, 0.3, 0.6, "doubtful"),
    ("Rotation risk this week", 1.0, 0.7, 0.6, "rotation"),
    ("Back in training and expected to start", 0.9, 0.0, 0.7, "positive"),
    ("", 1.0, 0.0, 1.0, "neutral"),
    ("  \t", 1.0, 0.0, 1.0, "neutral"),
    (None, 1.0, 0.0, 1.0, "neutral"),
    ("Unavailable", 0.9, 0.0, 0.6, "positive"),  # the word holds "available": kept as the rules have it
    ("Signed a new contract", 1.0, 0.0, 0.6, "neutral"),
]


def test_texts_become_signals(spark):
    t = F.col("t")
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string").select("i", news.availability(t), news.minutes_risk(t), news.confidence(t), news.category(news.availability(t), news.minutes_risk(t))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in CASES]


def test_limits_can_be_changed(spark):
    row = spark.range(1).select(news.category(F.lit(0.5), F.lit(0.0), {"doubtful": 0.35}).alias("c")).first()
    assert row["c"] == "neutral"


@pytest.mark.parametrize(
    "text, status, chance, said",
    [("Knock", "d", 0.75, "Knock. Status: doubtful. 75% chance of playing"), ("Suspended for one game", "s", 0.0, "Suspended for one game. 0% chance of playing"), ("", "i", None, "Status: injured"), (" Fit ", "a", 1.0, "Fit"), (None, "a", None, ""), ("Knock", "x", 0.29, "Knock. 28% chance of playing")],
)
def test_snapshot_as_text(spark, text, status, chance, said):
    row = spark.createDataFrame([(text, status, chance)], "t string, s string, c double").select(news.snapshot_text(F.col("t"), F.col("s"), F.col("c")).alias("x")).first()
    assert row["x"] == said


def test_strict_status_overrides_the_text(spark):
    row = spark.range(1).select(news.strict_availability(F.lit("Back in training"), F.lit("u")).alias("u"), news.strict_availability(F.lit(""), F.lit("d")).alias("d"), news.strict_availability(F.lit(""), F.lit("a")).alias("a")).first()
    assert tuple(row) == (0.0, 0.5, 1.0)


def test_fixture_scores(spark):
    d = lambda ratings, homes: fixtures.difficulty(F.array(*map(F.lit, ratings)).cast("array<double>"), F.array(*map(F.lit, homes)).cast("array<boolean>"))
    row = spark.range(1).select(
        d([5, 1], [True, False]).alias("a"), d([], []).alias("b"), d([None], [True]).alias("c"), fixtures.advantage(F.lit(1.0)).alias("d"), fixtures.advantage(F.lit(None).cast("double")).alias("e"), fixtures.congestion(F.lit(6)).alias("f"), fixtures.congestion(F.lit(1)).alias("g"),
        *[fixtures.noise_factor(F.lit(x)).alias(f"n{i}") for i, x in enumerate((0.0, 1.0, 2.5, 5.0, 9.0))],
    ).first()
    assert row["a"] == pytest.approx((4.5 + 1.5) / 2) and row["b"] == 3.0 and row["c"] == 2.5
    assert row["d"] == 1.0 and row["e"] == 0.5 and row["f"] == 1.0 and row["g"] == 0.0
    assert [row[f"n{i}"] for i in range(5)] == pytest.approx([0.8, 0.8, 0.95, 1.5, 1.5])
