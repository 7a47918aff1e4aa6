import numpy as np
import pytest

from mnemolake.llm.mixing import mix, water_fill


def brute_fill(sizes, weights, share, epochs):
    total, caps = sum(sizes) * share, [epochs * s for s in sizes]
    fixed = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        if not free:
            return caps
        left = (total - sum(caps[i] for i in fixed)) / sum(weights[i] for i in free)
        over = [i for i in free if weights[i] * left > caps[i]]
        if not over:
            return [caps[i] if i in fixed else weights[i] * left for i in range(len(sizes))]
        fixed |= set(over)


@pytest.mark.parametrize("sizes", [[100, 10, 1000, 5, 70], [10, 10, 10], [1, 10**6], [50]])
def test_water_fill_equals_clamp_and_reshare(spark, sizes):
    rows = [(f"s{i}", s) for i, s in enumerate(sizes)]
    got = {r["source"]: r["target"] for r in water_fill(spark.createDataFrame(rows, "source string, source_size long"), (3, 1, 2), 1.5, 2.0).collect()}
    want = brute_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2.0)
    assert np.allclose([got[f"s{i}"] for i in range(len(sizes))], want)


def test_mix_meets_targets_and_edge_cases(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 4}" if i % 9 else None, "x") for i in range(400)] + [(1000, None, "s1", "x"), (1001, "", None, "y"), (1002, "word " * 5000, "s2", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert sorted(map(tuple, mix(docs.repartition(7)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mix_of_nothing(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    one = mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["taken"]) for r in one] == [(0, 0)]
