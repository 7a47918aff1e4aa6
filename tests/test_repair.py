"""Stores of older schema, and stores with rows that should not be there."""

import json

import pytest

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine
from mnemolake.operators.scope import Scope
from mnemolake.sources import catalog as module
from mnemolake.sources.catalog import Catalog


def test_an_older_store_is_brought_up(spark, tmp_path):
    store = Catalog(spark, f"file://{tmp_path}/s")
    assert store.migrate() == []  # nothing there yet
    rows = spark.createDataFrame([("e1", "x", "fact", " ", "app "), ("e2", "y", "fact", None, None)], "id string, content string, content_type string, project_slug string, app_client_name string")
    store.publish({"episodes": rows})
    now = json.loads((tmp_path / "s/_current.json").read_text())
    assert now["schema"] == module.SCHEMA_VERSION
    (tmp_path / "s/_current.json").unlink()
    (tmp_path / "s/_pointers/1.json").write_text(json.dumps({k: v for k, v in now.items() if k != "schema"}))  # as before there were schema versions
    for f in (tmp_path / "s").rglob(".*.crc"):
        f.unlink()
    assert store.append({"keyword_lengths": spark.createDataFrame([("e1", 1)], "id string, length int")}) == 2 and "schema" not in json.loads((tmp_path / "s/_pointers/1.json").read_text())
    assert store.pointer()["schema"] == 1 and store.migrate() == [2] and store.migrate() == []
    assert {r["id"]: (r["project_slug"], r["app_client_name"]) for r in store.read("episodes").collect()} == {"e1": ("default", "app"), "e2": ("default", "legacy_client")}
    store.rollback(1)
    assert store.pointer().get("schema", 1) == 1 and store.migrate() == [2]


def test_a_newer_store_is_refused(spark, tmp_path, monkeypatch):
    store = Catalog(spark, f"file://{tmp_path}/s")
    store.publish({"keyword_lengths": spark.createDataFrame([("e1", 1)], "id string, length int")}, schema=99)
    with pytest.raises(ValueError, match="schema version 99"):
        store.read("keyword_lengths")


def test_repair(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", DEFAULTS.override(dim=2))
    ep = "id string, content string, content_type string, updated_at timestamp, created_at timestamp"
    at = __import__("datetime").datetime
    engine.catalog.publish({
        "episodes": spark.createDataFrame([("a", "old", "fact", at(2024, 1, 1), None), ("a", "new", "fact", at(2024, 1, 2), None), ("b", "x", "fact", None, None), ("c", "y", "fact", None, None)], ep),
        "vectors": spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [1.0]), ("z", [0.0, 1.0])], "id string, embedding array<float>"),
        "episode_anchors": spark.createDataFrame([("a", "path", "p"), ("z", "path", "p")], "episode_id string, anchor_type string, anchor_value string"),
        "claims": spark.createDataFrame([("c1", "fact")], "id string, claim_type string"),
        "claim_sources": spark.createDataFrame([("c1", "a", None), ("c1", "z", None), ("c1", "z", "t"), ("c9", "a", None)], "claim_id string, source_episode_id string, source_topic_id string"),
    })
    want = {"repeated_episodes": 1, "stray_vectors": 3, "unindexed": 2, "stray_anchors": 1, "stray_sources": 2}
    assert engine.repair() == want and engine.catalog.pointer()["version"] == 1
    with pytest.raises(PermissionError):
        MemoryEngine(spark, engine.catalog.root, engine.config, owner=Scope(write_mode="deny")).repair(dry_run=False)
    assert engine.repair(dry_run=False) == want and engine.repair() == dict.fromkeys(want, 0)
    assert {r["id"]: (r["content"], r["indexed"]) for r in engine.catalog.read("episodes").collect()} == {"a": ("new", True), "b": ("x", False), "c": ("y", False)}
    assert {(r["claim_id"], r["source_episode_id"], r["source_topic_id"]) for r in engine.catalog.read("claim_sources").collect()} == {("c1", "a", None), ("c1", None, "t")}
