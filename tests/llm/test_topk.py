import numpy as np
import pytest

from mnemolake.llm import topk
from mnemolake.llm.topk import search, usable


def brute(rows, queries, k):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    q8 = lambda v: [int(np.floor(256 * float(x))) for x in v]
    out = set()
    for q, qv in {(i, tuple(v)) for i, v in ok if i in queries}:
        s = sorted((-sum(a * b for a, b in zip(q8(qv), q8(v), strict=False)), i) for i, v in ok if i != q)
        out |= {(q, r + 1, i, -n) for r, (n, i) in enumerate(s[:k])}
    return out


def run(spark, rows, queries, k=5, parts=3):
    df = usable(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(parts))
    got = [tuple(r) for r in search(df, df.filter(df.id.isin(list(queries))), k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_random_ties_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(150)]
    rows += [(1000 + i, [0.5] * 6) for i in range(80)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (None, [9.0] * 6), (2004, []), (2005, [2.0])]
    queries = {0, 7, 50, 1000, 1079, 2000, 2001, 2004, 2005}
    assert run(spark, rows, queries) == brute(rows, queries, 5)


def test_fewer_than_k_and_empty(spark):
    rows = [(1, [1.0, 2.0]), (2, [0.5, 1.0])]
    assert run(spark, rows, {1}) == brute(rows, {1}, 5) and len(run(spark, rows, {1})) == 1
    assert run(spark, rows, set()) == set()
    assert run(spark, [(1, [1.0])], {1}) == set()


@pytest.mark.parametrize("scale", [1e3, 1e6])
def test_large_components_stay_exact(spark, scale):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=3) * scale]) for i in range(40)]
    assert run(spark, rows, {0, 10}) == brute(rows, {0, 10}, 5)
