"""Sections of the evaluation by hand."""

from mnemolake.operators import evaluate


def one(df):
    return tuple(df.first())


def test_sections(spark):
    found = spark.createDataFrame([("q1", 1, "a"), ("q1", 2, "b"), ("q1", 3, "s"), ("q2", 1, "s"), ("q3", 1, "a")], "query_id string, rank int, id string")
    stale = spark.createDataFrame([("q1", "s"), ("q2", "s"), ("q2", "s"), ("q4", "x")], "query_id string, id string")
    assert one(evaluate.suppressed(found, stale, 2)) == (3, 2 / 3) and one(evaluate.suppressed(found, stale, 3)) == (3, 1 / 3)
    assert one(evaluate.suppressed(found, stale.limit(0))) == (0, None)
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "a string, b string")
    assert one(evaluate.visible(pairs, spark.createDataFrame([("b", "a"), ("x", "y")], "id string, partner string"))) == (2, 0.5)
    cases = spark.createDataFrame([(0.9, 0.1), (0.2, 0.2), (0.4, 0.1), (None, 0.3)], "good double, bad double")
    n, rate, delta = one(evaluate.wins(cases))
    assert (n, rate, round(delta, 9)) == (3, 2 / 3, 0.3)
