"""What one scope does neither shows in another nor changes it."""

import pytest
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine
from mnemolake.operators import scope
from mnemolake.operators.recall import RecallQuery
from mnemolake.operators.scope import Scope

CONFIG = DEFAULTS.override(dim=64, cluster_similarity=0.4, topic_threshold=0.05, record_threshold=0.05)


def facts(spark, *rows):
    made = [('{"type": "preference", "key": "%s", "value": "%s"}' % r, "preference", ["t"]) for r in rows]
    return spark.createDataFrame(made, "content string, content_type string, tags array<string>")


@pytest.fixture(scope="module")
def two(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('store')}"
    secret = MemoryEngine(spark, root, CONFIG, owner=Scope(project_slug="secret"))
    other = MemoryEngine(spark, root, CONFIG)
    secret.ingest(facts(spark, ("build server", "runs on linux boxes"), ("build server name", "runs on linux hosts")), "2024-01-01")
    secret.consolidate("2024-01-02")
    return secret, other


def claim(engine):
    return engine.browse_claims("2024-01-03").first()["id"]


def test_records_topics_and_claims_stay_in_their_scope(two):
    secret, other = two
    rows = secret.catalog.read("knowledge_records")
    assert rows.count() == 2 and {r["project_slug"] for r in rows.collect()} == {"secret"}
    assert [r["project_slug"] for r in secret.catalog.read("knowledge_topics").collect()] == ["secret"]
    q = RecallQuery("build server linux", "2024-01-03")
    mine, theirs = secret.recall(q), other.recall(q)
    assert mine["records"].count() == 2 and mine["topics"].count() == 1 and mine["claims"].count() == 2
    assert all(df.count() == 0 for df in theirs.values())
    assert secret.browse_claims("2024-01-03").count() == 2 and other.browse_claims("2024-01-03").count() == 0
    assert other.search_claims("build server", "2024-01-03").count() == 0
    assert other.recall(q, where={"project_slug": "secret"})["claims"].count() == 2  # a scope asked for
    assert other.browse().count() == 0 and other.status("2024-01-03")["claims_valid"] == 0


def test_writes_reach_only_the_callers_rows(spark, two):
    secret, other = two
    ids = secret.catalog.read("episodes").select("id")
    assert other.protect(ids) == 0 and other.protect(tag="t") == 0 and other.forget(ids, "2024-01-03") == 0
    assert secret.catalog.read("episodes").filter("protected OR deleted").count() == 0
    topic = secret.catalog.read("knowledge_topics").first()["id"]
    with pytest.raises(ValueError):
        other.correct(topic, "## Facts\n\n- **a**: b\n", "2024-01-03")
    with pytest.raises(ValueError):
        other.record_outcome("x", "success", "2024-01-03", [claim(secret)])
    with pytest.raises(ValueError):
        other.record_outcome("x", "success", "2024-01-03", episode_ids=[ids.first()["id"]])
    assert other.contradictions().count() == 0 and other.hygiene_apply("2024-01-03").count() == 0
    version = secret.catalog.pointer()["version"]
    secret.record_outcome("x", "success", "2024-01-03", [f" {claim(secret)} ", claim(secret)])
    assert secret.catalog.pointer()["version"] == version + 1  # one publish
    assert secret.protect(ids) == 2


def test_drift_challenges_own_claims_only(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    config = CONFIG
    a, b = (MemoryEngine(spark, root, config, owner=Scope(project_slug=p)) for p in ("a", "b"))
    for e, when in ((a, "after a deploy"), (b, "on startup")):
        e.ingest(spark.createDataFrame([(f"Problem: cache fails {when} {n}\nFix: edit src/app/cache.py", "solution", ["x"]) for n in ("early on mondays", "late on sundays")], "content string, content_type string, tags array<string>"), "2024-01-01")
    a.consolidate("2024-01-02")
    hit = a.detect_drift(spark.createDataFrame([("src/app/cache.py",)], "path string"), "2024-01-03").collect()
    assert {r["id"] for r in hit} == {r["id"] for r in a.browse_claims("2024-01-04").collect()}
    assert {r["status"] for r in a.browse_claims("2024-01-04").collect()} == {"challenged"}
    assert {r["status"] for r in b.browse_claims("2024-01-04").collect()} == {"active"}
    assert [r["paths"] for r in a.catalog.read("drift_impacts").collect()] == [["src/app/cache.py"]] * len(hit)


def test_a_second_run_merges_and_contradicts(spark, two):
    secret, other = two
    secret.ingest(facts(spark, ("build server", "moved away to windows boxes"), ("build server owner", "runs on linux team")), "2024-02-01")
    got = secret.consolidate("2024-02-02")
    assert got["topics_created"] == 0 and got["topics_updated"] == 1 and got["contradictions"] == 1 and got["records"] == 2
    topic = secret.catalog.read("knowledge_topics").collect()
    assert len(topic) == 1 and topic[0]["fact_count"] == 3 and len(topic[0]["source_episodes"]) == 4
    log = secret.contradictions().collect()
    assert len(log) == 1 and "linux boxes" in log[0]["old_content"] and "windows" in log[0]["new_content"]
    assert other.contradictions().count() == 0
    edge = secret.catalog.read("claim_edges").collect()
    assert len(edge) == 1 and edge[0]["edge_type"] == "contradicts"
    claims = {r["id"]: r for r in secret.catalog.read("claims").collect()}
    assert claims[edge[0]["to_claim_id"]]["status"] == "expired" and claims[edge[0]["from_claim_id"]]["status"] == "active"
    assert claims[edge[0]["from_claim_id"]]["precision_"] < 1.0
    live = secret.catalog.read("knowledge_records").filter("valid_until IS NULL")
    assert live.count() == 3 and live.filter(F.col("embedding_text").contains("linux boxes")).count() == 0
    old = secret.topic_as_of(topic[0]["id"], "2024-02-01").first()
    assert "linux boxes" in old["content"] and secret.topic_as_of(topic[0]["id"], "2024-03-01").count() == 0
    found = secret.recall(RecallQuery("build server windows", "2024-02-03"))
    assert found["records"].filter("uncertainty LIKE '%Evolving%'").count() > 0
    assert found["claims"].filter("contradicted_by IS NOT NULL").count() == 1
    assert secret.catalog.read("consolidation_reports").count() == 2 and secret.catalog.read("consolidation_metrics").count() == 2
    assert secret.consolidate("2024-02-04")["records"] == 0  # nothing is pending


def test_every_row_gets_a_status(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/store", CONFIG)
    rows = [("one two three", "fact"), ("one two three", "fact"), ("one two three", "preference"), ("quite another text", "solution")]
    got = engine.ingest(spark.createDataFrame(rows, "content string, content_type string"), "2024-01-01").collect()
    assert sorted(r["status"] for r in got) == ["duplicate", "duplicate", "stored", "stored"]
    assert all((r["duplicate_of"] is None) == (r["status"] == "stored") for r in got)
    assert any(r["advice"] for r in got)
    parts = len(engine.catalog.pointer()["tables"]["episodes"])
    engine.ingest(spark.createDataFrame([("a third text here", "fact")], "content string, content_type string"), "2024-01-02")
    assert len(engine.catalog.pointer()["tables"]["episodes"]) == parts + 1 and engine.catalog.read("episodes").count() == 3  # added beside


def test_cluster_scope(spark):
    rows = [(1, 5, "n", "p", "d1", "C:\\Repo\\"), (1, 6, "n", "p", "d2", "c:/Repo"), (2, 7, "n", None, "d", None)]
    df = spark.createDataFrame(rows, "cluster int, id int, namespace_slug string, project_slug string, project_display_name string, project_root_uri string")
    got = {r["cluster"]: r for r in scope.of_clusters(df).collect()}
    assert got[1]["project_display_name"] is None and got[1]["project_root_uri"] == "c:/Repo" and got[1]["project_slug"] == "p"
    assert got[2]["project_slug"] == "default" and got[2]["project_root_uri"] is None
