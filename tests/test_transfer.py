"""Exports of a scope, and imports under new ids where an id is taken."""

import pytest
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine
from mnemolake.operators.scope import Scope
from mnemolake.sources import transfer
from mnemolake.sources.catalog import IMPORTED, SCHEMAS, conform

CONFIG = DEFAULTS.override(dim=32, cluster_similarity=0.4)


def store(spark, tmp_path, **tables):
    """What an import brings, or what is held, from a few columns."""
    return {t: conform(spark.createDataFrame(*tables[t]), t) if t in tables else spark.createDataFrame([], SCHEMAS[t]) for t in IMPORTED}


def test_ids_that_are_taken_are_replaced_with_all_that_refers_to_them(spark, tmp_path):
    ep, topic, rec = "id string, content string, content_type string", "id string, filename string, title string, source_episodes array<string>", "id string, topic_id string, record_type string, embedding_text string, source_episodes array<string>"
    held = store(spark, tmp_path, episodes=([("e1", "mine", "fact"), ("e2", "same", "fact")], ep), knowledge_topics=([("t1", "a.md", "A", []), ("t2", "b.md", "B", [])], topic), claims=([("c1", "fact", "x")], "id string, claim_type string, canonical_text string"))
    new = store(
        spark, tmp_path, episodes=([("e1", "theirs", "fact"), ("e2", "same", "fact"), ("e3", "new", "fact"), ("e3", "new", "fact")], ep), knowledge_topics=([("t1", "c.md", "C", ["e1", "e2"]), ("t9", "b.md", "B2", ["e3"])], topic),
        knowledge_records=([("r1", "t1", "fact", "f", ["e2", "e1"]), ("r2", "t9", "fact", "g", None)], rec), claims=([("c1", "fact", "x"), ("c2", "fact", "y")], "id string, claim_type string, canonical_text string"),
        claim_sources=([("c1", "e1", "t9", "r2"), ("c2", None, "t1", None)], "claim_id string, source_episode_id string, source_topic_id string, source_record_id string"), claim_edges=([("c1", "c2", "contradicts")], "from_claim_id string, to_claim_id string, edge_type string"),
    )
    got = {t: df.collect() for t, df in transfer.incoming(new, held.__getitem__, "import").items()}
    moved = next(r["id"] for r in got["episodes"] if r["content"] == "theirs")
    topic_id = next(r["id"] for r in got["knowledge_topics"])
    assert moved.startswith("e1-") and topic_id.startswith("t1-")
    assert sorted(r["id"] for r in got["episodes"]) == sorted([moved, "e3"])  # e2 is there
    assert [(r["filename"], r["source_episodes"]) for r in got["knowledge_topics"]] == [("c.md", [moved, "e2"])]  # b.md is the topic that is there
    assert {(r["id"], r["topic_id"], tuple(r["source_episodes"] or ())) for r in got["knowledge_records"]} == {("r1", topic_id, ("e2", moved)), ("r2", "t2", ())}
    assert [r["id"] for r in got["claims"]] == ["c2"]
    assert {(r["claim_id"], r["source_episode_id"], r["source_topic_id"], r["source_record_id"]) for r in got["claim_sources"]} == {("c1", moved, "t2", "r2"), ("c2", None, topic_id, None)}
    assert len(got["claim_edges"]) == 1 and len({r["id"] for r in got["claim_sources"]}) == 2
    again = {t: held[t].unionByName(conform(spark.createDataFrame(rows, SCHEMAS[t]), t)) for t, rows in got.items()}
    assert all(df.count() == 0 for df in transfer.incoming(new, again.__getitem__, "import").values())  # a second time nothing is new


def test_a_scopes_part_and_back(spark, tmp_path):
    pref = lambda k, v: f'{{"type": "preference", "key": "{k}", "value": "{v}"}}'
    a = MemoryEngine(spark, f"file://{tmp_path}/s", CONFIG, owner=Scope(project_slug="a"))
    b = MemoryEngine(spark, f"file://{tmp_path}/s", CONFIG, owner=Scope(project_slug="b"))
    for engine, key in ((a, "editor"), (b, "shell")):
        engine.ingest(spark.createDataFrame([(pref(key, "one thing"), "preference"), (pref(key + " name", "one thing too"), "preference")], "content string, content_type string"), "2024-01-01")
    a.consolidate("2024-01-02")
    a.export(f"file://{tmp_path}/part", everything=False)
    part = a.catalog.exported(f"file://{tmp_path}/part")
    assert {r["project_slug"] for r in part["episodes"].collect()} == {"a"} and part["knowledge_topics"].count() >= 1
    ids = {r["id"] for r in part["claims"].collect()}
    assert ids and {r["claim_id"] for r in part["claim_sources"].collect()} == ids
    fresh = MemoryEngine(spark, f"file://{tmp_path}/n", CONFIG.override(dim=16), owner=Scope(project_slug="a"))
    added = fresh.import_(f"file://{tmp_path}/part")
    assert added["episodes"] == 2 and added["claims"] == len(ids) == fresh.browse_claims("2024-01-03").count()
    assert fresh.keyword_coverage() == {"live": 2, "indexed": 2, "stale": 0}
    assert {len(r["embedding"]) for r in fresh.catalog.read("vectors").collect()} == {16}
    assert sum(fresh.import_(f"file://{tmp_path}/part").values()) == 0
    with pytest.raises(ValueError):
        fresh.catalog.exported(f"file://{tmp_path}/part", (*IMPORTED, "vectors"))
    names = [fresh.backup(f"file://{tmp_path}/b", f"2024-01-0{d}", keep=2) for d in (1, 2, 3)][-1]
    assert names == ["export-2024-01-02", "export-2024-01-03"] == fresh.catalog.snapshots(f"file://{tmp_path}/b")


def test_stale_challenges_end(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", CONFIG)
    claims = spark.createDataFrame([("a", "challenged"), ("b", "challenged"), ("c", "active")], "id string, status string").withColumn("created_at", F.to_timestamp(F.lit("2024-01-01")))
    events = spark.createDataFrame([("a", "challenged", "2024-01-01"), ("b", "challenged", "2024-01-20")], "claim_id string, event_type string, at string").withColumn("created_at", F.to_timestamp("at"))
    engine.catalog.publish({"claims": claims, "claim_events": events})
    assert engine.expire_stale("2024-01-21") == 1
    assert {r["id"]: r["status"] for r in engine.catalog.read("claims").collect()} == {"a": "expired", "b": "challenged", "c": "active"}
    assert [r["claim_id"] for r in engine.catalog.read("claim_events").filter("event_type = 'auto_expired_challenged'").collect()] == ["a"]
    assert engine.expire_stale("2024-01-21") == 0
