import pytest
from pyspark.sql import functions as F

from mnemolake.engine import MemoryEngine
from mnemolake.operators import reads
from mnemolake.operators.recall import RecallQuery
from mnemolake.operators.scope import Scope


@pytest.fixture()
def engine(spark, tmp_path):
    from mnemolake.config import DEFAULTS

    return MemoryEngine(spark, f"file://{tmp_path}/store", DEFAULTS.override(dim=64, cluster_similarity=0.5))


def notes(spark):
    rows = [("Preference: editor = vim", "preference", ["tools"]), ("Preference: editor = emacs now", "preference", ["tools"]), ("Problem: cache fails\nFix: edit src/app/cache.py", "solution", ["cache", "bug"]), ("Talked about lunch", "exchange", [])]
    return spark.createDataFrame(rows, "content string, content_type string, tags array<string>")


def test_store_recall_forget(spark, engine):
    got = engine.ingest(notes(spark), "2024-01-01")
    assert got.filter("status = 'stored'").count() == 4
    assert [r["status"] for r in engine.ingest(notes(spark), "2024-01-02").collect()] == ["known"] * 4  # the same ids
    again = engine.remember("preference: EDITOR = vim", "2024-01-02", "preference")
    assert [r["status"] for r in again.collect()] in (["duplicate"], ["stored"])
    out = engine.recall(RecallQuery("cache fails src/app/cache.py", "2024-01-03", 3))
    assert out["episodes"].first()["content_type"] == "solution"
    assert set(out) == {"episodes", "topics", "records", "claims"} and all(df.count() >= 0 for df in out.values())
    assert engine.ask("lunch", "2024-01-03", 1).count() == 1
    assert engine.search("LUNCH").count() == 1
    ids = engine.search("lunch").select("id")
    assert engine.forget(spark.createDataFrame(ids.collect(), "id string"), "2024-01-04") == 1
    assert engine.search("lunch").count() == 0
    other = MemoryEngine(spark, engine.catalog.root, engine.config, owner=Scope(project_slug="other"))
    assert other.search("cache").count() == 0
    with pytest.raises(PermissionError):
        MemoryEngine(spark, engine.catalog.root, owner=Scope(write_mode="deny")).remember("x", "2024-01-01")
    with pytest.raises(ValueError):
        engine.remember(" ", "2024-01-01")


def test_reindex_takes_a_new_encoder(spark, engine):
    from mnemolake.sources.embeddings import WordHashEncoder

    assert engine.reindex() == 0  # an empty store
    engine.ingest(notes(spark), "2024-01-01")
    gone = spark.createDataFrame(engine.search("lunch").select("id").collect(), "id string")
    engine.forget(gone, "2024-01-02")
    episodes = engine.catalog.read("episodes").withColumn("indexed", F.lit(False))
    engine.catalog.publish({"episodes": episodes})
    assert reads.visible(engine.catalog.read("episodes")).count() == 0  # not indexed, not read
    wide = MemoryEngine(spark, engine.catalog.root, engine.config.override(dim=32), WordHashEncoder(32))
    assert wide.reindex() == 3
    rows = wide.catalog.read("vectors").collect()
    assert {len(r["embedding"]) for r in rows} == {32} and not any(r["tombstoned"] for r in rows)
    assert {(r["deleted"], r["indexed"]) for r in wide.catalog.read("episodes").collect()} == {(True, False), (False, True)}
    top = wide.recall(RecallQuery("cache fails src/app/cache.py", "2024-01-03", 3))["episodes"].first()
    assert top["content_type"] == "solution"
    with pytest.raises(PermissionError):
        MemoryEngine(spark, engine.catalog.root, owner=Scope(write_mode="deny")).reindex()


def test_consolidation_outcomes_and_drift(spark, engine):
    when = ["after a deploy", "on startup when cold"]
    rows = [(f"Problem: cache fails {when[i % 2]}\nFix: edit src/app/cache.py", "solution", ["cache"], "2023-12-01") for i in range(4)]
    engine.ingest(spark.createDataFrame(rows, "content string, content_type string, tags array<string>, created_at string"), "2024-01-01")
    assert engine.consolidate("2024-01-02")["records"] >= 1
    claims = engine.browse_claims("2024-01-03").collect()
    assert claims and all(c["reliability"] % 5 == 0 for c in claims)
    cid = claims[0]["id"]
    engine.record_outcome("applied the fix", "success", "2024-01-04", [cid], refs=[("issue", "id", "12")])
    with pytest.raises(ValueError):
        engine.record_outcome("x", "success", "2024-01-04", ["no such claim"])
    assert engine.browse_outcomes().first()["claims"] == [cid]
    after = {c["id"]: c for c in engine.browse_claims("2024-01-05").collect()}[cid]
    assert after["validation_count"] == 1 and after["reliability"] > claims[0]["reliability"]
    hit = engine.detect_drift(spark.createDataFrame([("src/app/cache.py",), ("docs/x.md",)], "path string"), "2024-01-06")
    assert cid in {r["id"] for r in hit.collect()}
    assert {c["id"]: c["status"] for c in engine.browse_claims("2024-01-07").collect()}[cid] == "challenged"
    assert {c["id"]: c["status"] for c in engine.browse_claims("2024-01-05").collect()}[cid] == "active"
    status = engine.status("2024-01-07")
    assert status["claims_challenged"] >= 1 and status["posture"] == "drift_watch" and status["version"] > 3
    assert engine.search_claims("cache fails", "2024-01-07").count() >= 1
    assert engine.consolidation_log(5).count() == 1 and engine.hygiene_scan().count() >= 0
    topic = engine.browse().first()["topic_id"]
    assert engine.recall("cache fails", "2024-01-08")["topics"].first()["id"] == topic
    with pytest.raises(ValueError):
        engine.correct("no such topic", "", "2024-01-08")
    assert engine.correct(topic, "## Facts\n\n- **a**: b\n", "2024-01-08") == 1
    assert engine.timeline("a b", "2024-02-01").count() >= 1
    engine.compact("2024-06-01", 1)
    assert engine.decay_report("2024-06-01").count() >= 0
    assert engine.hygiene_apply("2024-06-01").count() >= 0


def test_snapshots(spark, engine, tmp_path):
    engine.ingest(notes(spark), "2024-01-01")
    version = engine.catalog.pointer()["version"]
    engine.protect(tag="tools")
    assert engine.catalog.read("episodes").filter("protected").count() == 2
    engine.catalog.rollback(version)
    assert engine.catalog.read("episodes").filter("protected").count() == 0
    out = f"file://{tmp_path}/out"
    engine.export(out)
    fresh = MemoryEngine(spark, f"file://{tmp_path}/other", engine.config)
    assert fresh.import_(out)["episodes"] == 4 and fresh.import_(out)["episodes"] == 0
    engine.policy_grant(("app_client_name", "bot"), "deny", "project", project="p")
    engine.policy_grant(("app_client_name", "bot"), "allow", "project", project="p")
    assert [r["write_mode"] for r in engine.policy_list().collect()] == ["allow"]


def test_hooks_cannot_break_anything(engine):
    seen = []

    class Plugin:
        def on_recall(self, query):
            seen.append(query)

        def on_prune(self):
            raise RuntimeError("broken")

    engine.hooks.register(Plugin())
    assert engine.hooks.fire("recall", query="q") == 1 and engine.hooks.fire("prune") == 0 and seen == ["q"]


def test_git_changes(tmp_path):
    import subprocess

    from mnemolake.sources.git import changed_paths, normalise_path

    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    (tmp_path / "a.py").write_text("x")
    (tmp_path / ".tmp_b").write_text("x")
    assert changed_paths(tmp_path) == ["a.py"] and normalise_path(".\\a\\b") == "a/b"


def test_streaming_ingest(spark, tmp_path):
    from mnemolake.streaming.ingest import deduplicated, ingest, outcome_windows

    src = spark.createDataFrame([("2024-01-01 00:00:00", "p", "a"), ("2024-01-01 00:01:00", "p", "a"), ("2024-01-01 00:02:00", "q", "a")], "created_at string, project_slug string, content string").selectExpr("timestamp(created_at) created_at", "project_slug", "content")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    got = []
    ingest(deduplicated(stream), lambda b: got.extend(b.collect()), f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r["project_slug"] for r in got) == ["p", "q"]
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "success")], "observed_at string, outcome_type string").selectExpr("timestamp(observed_at) observed_at", "outcome_type")
    assert outcome_windows(rows, "1 hour", "30 minutes").count() == 2
