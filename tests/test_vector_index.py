"""The vector index gives what comparing all gives, and reads less."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine
from mnemolake.operators import vector_index as vi
from mnemolake.operators.vectors import top_k


@pytest.fixture(scope="module")
def clumps():
    """Twenty clumps of unit vectors, one of them a third of all rows, and equal vectors."""
    rng = np.random.default_rng(11)
    centre = rng.normal(size=(20, 16))
    of = np.where(rng.random(1500) < 0.33, 0, rng.integers(0, 20, 1500))
    m = centre[of] + 0.15 * rng.normal(size=(1500, 16))
    m[100:140] = m[7]
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def stored(spark, clumps):
    df = spark.createDataFrame([(i, [float(x) for x in v], i % 13 == 5) for i, v in enumerate(clumps)], "id long, embedding array<float>, tombstoned boolean").repartition(4)
    centres = vi.centroids(df, 24)
    rows = vi.assigned(df, centres).cache()
    return df, rows, vi.cells_of(rows, centres)


def brute(clumps, q, k, but=()):
    s = sorted((-float(clumps[i].astype(float) @ clumps[q].astype(float)), i) for i in range(len(clumps)) if i % 13 != 5 and i not in but)
    return [(i, round(-x, 9)) for x, i in s[:k]]


def test_every_vector_is_in_one_cell_within_its_radius(stored, clumps):
    _, rows, cells = stored
    held = rows.collect()
    assert sorted(r["id"] for r in held) == [i for i in range(1500) if i % 13 != 5]
    assert all(r["distance"] <= cells.radius[r["cell"]] for r in held)
    assert all(np.argmin(((cells.centroids - clumps[r["id"]]) ** 2).sum(1)) == r["cell"] for r in held[::50])


@pytest.mark.parametrize("probes", [1, 4, 24])
def test_exact_search_equals_comparing_all(stored, clumps, probes):
    df, rows, cells = stored
    for q in (7, 105, 900):
        vec = [float(x) for x in clumps[q]]
        got = [(r["id"], round(r["similarity"], 9)) for r in vi.nearest(rows, cells, vec, 5, probes).collect()]
        assert got == brute(clumps, q, 5) == [(r["id"], round(r["similarity"], 9)) for r in top_k(df, vec, 5).collect()]
    few = df.filter("id % 100 = 0").select("id")
    assert [r["id"] for r in vi.nearest(rows, cells, [float(x) for x in clumps[7]], 50, probes, among=few).collect()] == [r["id"] for r in top_k(df.join(few, "id", "left_semi"), [float(x) for x in clumps[7]], 50).collect()]
    queries = df.filter("id % 100 = 7")
    got = {}
    for r in vi.nearest_each(rows, cells, queries, 5, probes).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["similarity"], 9)))
    assert got == {q: brute(clumps, q, 5, {q}) for q in range(7, 1500, 100)}


def test_few_probes_find_nine_in_ten(stored, clumps):
    df, rows, cells = stored
    found = vi.nearest_each(rows, cells, df.filter("id % 10 = 3"), 5, 4, exact=False)
    hits = {(r["query_id"], r["id"]) for r in found.collect()}
    want = {(q, i) for q in range(3, 1500, 10) for i, _ in brute(clumps, q, 5, {q})}
    assert len(hits & want) >= 0.9 * len(want)
    # A clump's search reads few cells.
    vec = clumps[900].astype(float)
    bound = cells.bound(vec[None, :])[0]
    assert (bound >= brute(clumps, 900, 5)[-1][1]).sum() <= len(bound) / 2


def test_nothing_stored(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>, tombstoned boolean")
    assert vi.centroids(none).shape == (0, 0)
    bad = spark.createDataFrame([(1, [1.0, float("nan")], False), (2, [1.0, 0.0], True)], "id long, embedding array<float>, tombstoned boolean")
    assert vi.centroids(bad).shape == (0, 0)
    mixed = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [1.0], False), (3, [0.0, 1.0], False), (4, None, False)], "id long, embedding array<float>, tombstoned boolean")
    rows = vi.assigned(mixed, vi.centroids(mixed))
    assert sorted(r["id"] for r in rows.collect()) == [1, 3]
    got = vi.nearest_each(rows, vi.cells_of(rows, vi.centroids(mixed)), mixed, 5).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(1, 3), (3, 1)]


def test_the_engine_keeps_it(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", DEFAULTS.override(dim=32, index_from=4, index_probes=1, dedup_similarity=1.1))
    note = lambda *texts: spark.createDataFrame([(t, "fact") for t in texts], "content string, content_type string")
    engine.ingest(note(*[f"note {i} on topic {i % 4}" for i in range(12)]), "2024-01-01")
    same = lambda: [r[0] for r in engine._nearest(engine._read("episodes").filter("NOT deleted").select("id"), vec, 4).collect()] == [r["id"] for r in top_k(engine.catalog.read("vectors"), vec, 4).collect()]
    vec = engine.encoder.encode(["note on topic 2"])[0].tolist()
    assert engine.index_status()["state"] == "none" and same()
    assert engine.build_index() == 12 and engine.index_status() == {"live": 12, "indexed": 12, "gone": 0, "state": "ready"} and same()
    engine.ingest(note("note on topic 2 anew", "else"), "2024-01-02")
    assert engine.index_status()["indexed"] == 14 and same()
    engine.catalog.append({"vectors": spark.createDataFrame([("z", vec)], "id string, embedding array<float>"), "episodes": spark.createDataFrame([("z", "x", "fact")], "id string, content string, content_type string")})
    assert engine.index_status()["indexed"] == 14 and same()  # not indexed, found all the same
    engine.forget(engine.search("topic 2").select("id"), "2024-01-03")
    assert engine.index_status()["state"] == "stale" and same()
    engine.compact("2024-01-04")
    assert engine.index_status()["gone"] == 0 and same()
