"""What an entity names comes first; recall within a time; deleted episodes back or gone for good; versions kept."""

import time

import pytest
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine, within
from mnemolake.operators import lifecycle, recall
from mnemolake.operators.recall import RecallQuery
from mnemolake.operators.scope import Scope


def test_entity_links(spark):
    anchors = spark.createDataFrame([("e1", "path", "src/app/Cache.py"), ("e2", "path", "src\\app\\cache.py"), ("e3", "path", "xcache.py"), ("e4", "tool", "git"), ("e5", "commit", "abc/cache.py"), ("e1", "path", "src/app/Cache.py")], "episode_id string, anchor_type string, anchor_value string")
    sources = spark.createDataFrame([("c1", "e1", None), ("c1", None, "r1"), ("c2", "e3", "r2"), ("c3", None, "r3")], "claim_id string, source_episode_id string, source_record_id string")
    claims = spark.createDataFrame([("c1", {"subject": "x"}), ("c2", {"key": "y"}), ("c3", {"subject": " CACHE.py "}), ("c4", None)], "id string, payload map<string,string>")
    ids = lambda entity: {k: sorted(r["id"] for r in v.collect()) for k, v in recall.entity_links(entity, anchors, sources, claims).items()}
    assert ids("cache.py") == {"episodes": ["e1", "e2"], "claims": ["c1", "c3"], "records": ["r1", "r3"]}
    assert ids("./src/app/cache.py")["episodes"] == ids("app\\cache.py")["episodes"] == ["e1", "e2"]
    assert ids("Git") == {"episodes": ["e4"], "claims": [], "records": []} and ids("y")["claims"] == ["c2"]


def test_what_is_linked_is_raised(spark):
    rows = spark.createDataFrame([(1, 0.0, "a"), (2, 0.5, "b"), (3, 0.9, "on cache"), (4, 0.8, "c")], "id long, v double, text string")
    links = spark.createDataFrame([(1,), (2,), (2,)], "id long")
    got = {r["id"]: (round(r["v"], 6), r["linked"]) for r in recall.boosted(rows, links, "v", "cache", F.col("text")).collect()}
    assert got == {1: (0.35 * 1.35 + 2, True), 2: (0.5 * 1.35 + 2, True), 3: (round(0.9 * 1.12, 6), False), 4: (0.8, False)}


def test_time_limits(spark):
    slow = lambda: spark.range(4).select(F.pandas_udf(lambda s: (time.sleep(20), s)[1], "long")("id")).collect()
    began = time.monotonic()
    assert within(spark, slow, 1.0) == (None, "the time is over") and time.monotonic() - began < 10
    assert within(spark, lambda: spark.range(3).count(), 60)[0] == 3
    assert within(spark, lambda: 1 / 0, 60) == (None, "division by zero")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    engine = MemoryEngine(spark, f"file://{tmp_path_factory.mktemp('s')}", DEFAULTS.override(dim=64, record_threshold=0.05, keep_versions=2, cluster_similarity=0.4))
    rows = [("Problem: cache fails\nFix: edit src/app/cache.py", "solution"), ("Problem: cache fails again\nFix: edit src/app/cache.py", "solution"), ("deploys go out at noon", "fact"), ("cache talk of the town", "fact")]
    engine.ingest(spark.createDataFrame(rows, "content string, content_type string"), "2024-01-01")
    engine.consolidate("2024-01-02")
    return engine


def test_recall_by_entity(spark, engine):
    q = RecallQuery("noon", "2024-01-03", 4, entity="cache.py")
    got = engine.recall(q)
    assert engine.recall(RecallQuery("noon", "2024-01-03", 4, entity="cache.py", sections=("episodes",)))["episodes"].filter("linked").count() == 2
    assert got["records"].count() >= 1 and all(r["relevance"] >= 2 for r in got["records"].collect())
    assert all(r["relevance"] >= 2 and r["linked"] for r in got["claims"].collect()) and got["claims"].count() >= 1
    assert engine.search_claims("noon", "2024-01-03").count() == 0


def test_recall_within(spark, engine, monkeypatch):
    q = RecallQuery("cache deploys", "2024-01-03", 4, sections=("episodes", "records"))
    out, left_out = engine.recall_within(q, 600)
    assert left_out == [] and [r["id"] for r in out["records"].collect()] == [r["id"] for r in engine.recall(q)["records"].collect()]
    assert out["episodes"].count() == 4
    out, left_out = engine.recall_within(q, 0)
    assert out == {} and left_out == ["episodes: left out, the time is over", "records: left out, the time is over"]
    monkeypatch.setattr(engine.encoder, "encode", lambda texts: (_ for _ in ()).throw(ConnectionError("no encoder")))
    out, left_out = engine.recall_within(q, 600)
    assert left_out == ["episodes: by words alone (no encoder)", "records: left out (no encoder)"]
    assert {r["content"].split()[-1] for r in out["episodes"].collect()} >= {"noon", "town"}


def test_back_and_gone(spark, engine):
    ids = engine.search("noon").select("id")
    one = spark.createDataFrame(ids.collect(), "id string")
    other = MemoryEngine(spark, engine.catalog.root, engine.config, owner=Scope(project_slug="other"))
    assert engine.forget(one, "2024-01-04") == 1 and engine.search("noon").count() == 0
    assert other.restore(one, "2024-01-05") == 0 and other.hard_delete(one, "2024-01-05") == 0
    assert engine.restore(one, "2024-01-05") == 1 and engine.search("noon").count() == 1
    assert not engine.catalog.read("vectors").join(one, "id").first()["tombstoned"]
    assert engine.hard_delete(one, "2024-01-06") == 1
    for table, key in (("episodes", "id"), ("vectors", "id"), ("episode_anchors", "episode_id"), ("keyword_postings", "id"), ("keyword_lengths", "id")):
        assert engine.catalog.read(table).join(one.withColumnRenamed("id", key), key, "left_semi").count() == 0
    assert engine.restore(one, "2024-01-07") == 0 and engine.keyword_coverage()["stale"] == 0


def test_versions_are_kept_up_to_a_number(spark, engine):
    topic = engine.catalog.read("knowledge_topics").first()["id"]
    for day in range(3):
        engine.correct(topic, f"## Facts\n\n- **a**: b{day}\n", f"2024-02-0{day + 1}")
    held = engine.catalog.read("topic_versions").filter(F.col("topic_id") == topic).orderBy("superseded_at").collect()
    assert [str(r["superseded_at"])[:10] for r in held] == ["2024-02-02", "2024-02-03"]
    rows = spark.createDataFrame([("t", 1, "a"), ("t", 1, "b"), ("t", 0, "c"), ("u", 0, None)], "topic_id string, superseded_at int, title string")
    assert sorted(map(str, ((r["topic_id"], r["title"]) for r in lifecycle.retained(rows, 2).collect()))) == ["('t', 'a')", "('t', 'b')", "('u', None)"]
