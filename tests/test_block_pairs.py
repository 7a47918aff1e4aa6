"""Similarity joins by products of blocks, against plain loops: ties, copies, odd vectors, groups of several blocks."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemolake import queries
from mnemolake.config import DEFAULTS
from mnemolake.operators import consolidate, vectors


def seq(v, w):
    s = 0.0
    for p, q in zip(v, w, strict=True):
        s += float(p) * float(q)
    return s


@pytest.fixture
def rows(monkeypatch, request):
    monkeypatch.setattr(vectors, "CELL_ROWS", 30)
    monkeypatch.setattr(vectors, "CELL_STEP", 16)
    rng = np.random.default_rng(11)
    m = rng.normal(size=(220, 5)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[60:120] = m[3]  # copies: ties
    m[120:140] = np.sign(m[120:140]) / 2  # many equal products
    out = [(i, [None, "x", "x", "y"][i % 4] if i % 13 else f"small {i}", [float(x) for x in v]) for i, v in enumerate(m)]
    return [*out, (900, "x", None), (901, "x", [1.0, 0.0]), (902, "x", [1.0, None, 0.0, 0.0, 0.0]), (903, "x", [1.0, 0.5]), (3, "y", out[3][2]), (904, "y", [float("nan")] * 5)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, g string, embedding array<float>").repartition(3)


def pairs(a, b):
    return [(g, i, j, seq(v, w)) for i, g, v in a for j, h, w in b if g == h is not None and v and w and len(v) == len(w) and None not in v and None not in w]


def high(s):
    return (s == s, -s if s == s else 0.0)


def test_counts_of_pairs(spark, rows):
    # 0.25 lies on products of the rows of halves
    want = {}
    for g, i, j, s in pairs(rows, rows):
        if i < j and not s < 0.25:
            want[g] = want.get(g, 0) + 1
    assert {r["g"]: r["n"] for r in vectors.similar_pair_counts(table(spark, rows), ["g"], 0.25).collect()} == want and want["x"] > 500


def test_best_pairs_of_groups(spark, rows):
    new, old = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]
    want = []
    for g in ("x", "y"):
        want += [(g, i, j, k + 1) for k, (_, i, j, s, _) in enumerate(sorted((high(s), i, j, s, k) for k, (h, i, j, s) in enumerate(pairs(new, old)) if h == g and not s < 0.2)[:24])]
    got = vectors.contradiction_candidates(table(spark, new), table(spark, old), ["g"], 0.2, 24).collect()
    assert sorted((r["g"], r["a"], r["b"], r["rank"]) for r in got) == sorted(want) and len(want) == 48


def no_pair_is_a_row(df):
    plan = df._jdf.queryExecution().toString()
    return "CoGroups" in plan and "zip_with" not in plan


def test_pairs_are_no_rows(spark, rows):
    t = table(spark, rows)
    rows = t.selectExpr("id", "g AS topic_id", "embedding", "'a' AS embedding_text", "'t' AS title", "timestamp_seconds(id) AS created_at", "timestamp_seconds(id) AS valid_until")
    assert no_pair_is_a_row(vectors.contradiction_candidates(t, t, ["g"], 0.2))
    assert no_pair_is_a_row(consolidate.contradicted(rows, rows, "2024-01-01")["expired"])
    assert no_pair_is_a_row(vectors.supersession(rows, F.timestamp_seconds(F.lit(100)), 0.1))
    assert no_pair_is_a_row(consolidate.match_topics(rows.withColumnRenamed("topic_id", "g"), rows.withColumnRenamed("topic_id", "g"), ["g"]))


def test_texts_of_contradictions(spark, rows):
    new, old = ([(*r, f"text {r[0] % 3}") for r in rows if r[0] % 2 == k and r[0] != 3] for k in (0, 1))
    hits = {}
    for g, i, j, s in pairs([r[:3] for r in new], [r[:3] for r in old]):
        if not s < 0.2:
            hits.setdefault(g, []).append((high(s), i, j))
    want = {j for h in hits.values() for _, i, j in sorted(h)[:24] if i % 3 != j % 3}
    make = lambda r: spark.createDataFrame(r, "id long, topic_id string, embedding array<float>, embedding_text string")
    got = consolidate.contradicted(make(old), make(new), "2024-01-01", DEFAULTS.override(contradiction_similarity=0.2))["expired"]
    assert sorted(r["id"] for r in got.collect()) == sorted(want) and want


def test_contradictions_of_vectors_without_a_record(spark, tmp_path):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 8)).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    keys = [*range(0, 400, 3), *range(1, 400, 3), 3, 4]  # a third of the vectors has no record, two have two
    spark.createDataFrame([(i, [float(x) for x in v], i // 2 % 2) for i, v in enumerate(m)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    part = pd.read_parquet("/root/testdata/sf0.001/part.parquet").head(1).loc[lambda d: d.index.repeat(len(keys))].assign(p_partkey=keys, p_name=[f"part {i % 5}" for i in keys])
    spark.createDataFrame(part).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("embeddings", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES["co10_contradictions"](spark, str(tmp_path))
    want = con.sql(queries.ORACLES["co10_contradictions"]).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 10
    # records are read for the texts of candidates alone, once for each side
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [p_partkey") == 2


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e30])
def test_best_pairs_that_single_precision_confuses(spark, monkeypatch, scale):
    monkeypatch.setattr(vectors, "CELL_STEP", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3, 6))
    out = [(i, "x", [float(x) for x in scale * (base[i // 2 % 3] + 1e-10 * rng.normal(size=6))]) for i in range(200)]
    new, old = out[::2], out[1::2]
    want = sorted((-s, i, j) for _, i, j, s in pairs(new, old) if not s < 0.2 * scale**2)[:24]
    make = lambda r: spark.createDataFrame(r, "id long, g string, embedding array<double>")
    got = vectors.contradiction_candidates(make(new), make(old), ["g"], 0.2 * scale**2, 24).collect()
    assert sorted((-r["similarity"], r["a"], r["b"]) for r in got) == want and len(want) == 24
    u, w, rough = vectors._single(*(np.array([r[2] for r in side]) for side in (new, old)))
    assert (u.dtype == np.float32) == (rough > 0) == (scale < 1e10)


def test_supersession(spark, rows):
    rows = [r for r in rows if r[0] != 3]
    told = [(i, g, v, i * 7 % 50, (i * 11 % 60 if i % 3 == 0 else None)) for i, g, v in rows]
    df = spark.createDataFrame(told, "id long, topic_id string, embedding array<float>, c long, u long").selectExpr("id", "topic_id", "embedding", "timestamp_seconds(c) AS created_at", "timestamp_seconds(u) AS valid_until")
    end, made = {r[0]: r[4] for r in told}, {r[0]: r[3] for r in told}
    old, new = [r for r in rows if end[r[0]] is not None and end[r[0]] <= 40], [r for r in rows if end[r[0]] is None or end[r[0]] > 40]
    want = {}
    for _, i, j, s in pairs(old, new):
        if made[j] >= end[i] and not s < 0.1:
            want[i] = min(want.get(i, (high(s), j)), (high(s), j))
    got = {r["id"]: r["superseded_by"] for r in vectors.supersession(df, F.timestamp_seconds(F.lit(40)), 0.1).collect()}
    assert got == {i: j for i, (_, j) in want.items()} and len(got) > 30


def test_topics_by_vectors_and_words(spark, rows):
    rows = [r for r in rows if r[0] != 3 and r[0] != 904]
    title = lambda i: [f"cache {i % 9}", f"the cache of disk {i % 40}", "", f"disk 5 {i}", "disk"][i % 5] if i % 17 else None
    words = {r[0]: None if title(r[0]) is None else set(re.findall("[a-z0-9]+", title(r[0]))) - {"the", "of"} for r in rows}
    new, old = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]

    def overlap(i, j):
        x, y = words[i], words[j]
        return None if x is None or y is None else len(x & y) / min(len(x), len(y)) if x and y else 0.0

    want = {}
    for i, g, v in new:
        near = max(((s, j) for _, _, j, s in pairs([(i, g, v)], old)), default=None)
        if near and near[0] >= 0.7:
            want[i] = near[1] if near[0] >= 0.9 or (overlap(i, near[1]) or 0.0) >= 0.34 else None
        else:
            want[i] = min((j for j, h, _ in old if g == h is not None and (overlap(i, j) or 0.0) > 0.5), default=None)
    make = lambda r: spark.createDataFrame([(*x, title(x[0])) for x in r], "id long, g string, embedding array<float>, title string")
    got = consolidate.match_topics(make(new), make(old), ["g"], DEFAULTS.override(topic_similarity=0.7, topic_title_overlap=0.34, topic_force_similarity=0.9)).collect()
    assert {r["id"]: r["topic_id"] for r in got} == want and len(got) == len(want) and 20 < sum(v is not None for v in want.values()) < len(want)
