"""The nearest stored item of each new one, against plain loops."""

import numpy as np
import pytest

from mnemolake.operators import vectors


@pytest.mark.parametrize(("by", "kind", "block"), [([], "long", 8192), (["g"], "long", 7), (["g"], "string", 8192)])
def test_equals_plain_loops(spark, monkeypatch, by, kind, block):
    monkeypatch.setattr(vectors, "MATCH_BLOCK", block)
    rng = np.random.default_rng(4)
    m = rng.normal(size=(160, 6)).astype(np.float32)
    m[50:90] = m[3]  # ties, and a hot vector
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    name = (lambda i: i) if kind == "long" else (lambda i: f"v{i:03d}")
    rows = [(name(i), [None, "x", "y"][i % 3], [float(x) for x in v]) for i, v in enumerate(m)] + [(name(900), "x", None), (name(901), "x", [1.0, 0.0])]
    new, old = [r for i, r in enumerate(rows) if i % 4 == 0], [r for i, r in enumerate(rows) if i % 4]
    table = lambda r: spark.createDataFrame(r, f"id {kind}, g string, embedding array<float>").repartition(3)
    want = {}
    for i, g, v in new:
        near = sorted((-round(float(np.dot(np.array(v), np.array(w))), 12), j) for j, h, w in old if v and w and len(v) == len(w) and (not by or g == h is not None))
        if near and -near[0][0] >= 0.6:
            want[i] = near[0][1]
    got = {r["id"]: r["duplicate_of"] for r in vectors.nearest_duplicates(table(new), table(old), 0.6, by).collect()}
    assert got == want and len(want) > 15


def test_nothing_to_compare(spark):
    none = spark.createDataFrame([], "id string, embedding array<float>")
    one = spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>")
    assert vectors.nearest_duplicates(none, one, 0.5).collect() == [] and vectors.nearest_duplicates(one, none, 0.5).collect() == []
