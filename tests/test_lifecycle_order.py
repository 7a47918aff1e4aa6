"""States do not depend on the order of rows, snapshots not on luck, claims not on other scopes."""

import itertools

import pytest

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine
from mnemolake.operators import lifecycle
from mnemolake.operators.scope import Scope
from mnemolake.sources.catalog import Catalog


def test_ties_go_to_the_gravest(spark):
    events = [("a", 1, "update", "2024-01-01"), ("a", 1, "expire", "2024-01-01"), ("a", 1, "challenged", "2024-01-01"), ("b", 1, "contradiction", "2024-01-01"), ("b", 1, "challenged", "2024-01-01"), ("c", 2, "update", "2024-01-01"), ("c", 1, "expire", "2024-01-01"), ("d", 1, "seen", "2024-01-01")]
    for rows in itertools.islice(itertools.permutations(events), 0, 40320, 8000):
        df = spark.createDataFrame(rows, "claim_id string, n int, event_type string, at string").selectExpr("claim_id", "n", "event_type", "timestamp(at) AS created_at").repartition(3)
        got = {r["id"]: (r["last"], r["state"]) for r in lifecycle.lifecycle_state(df).collect()}
        assert got == {"a": ("expire", "expired"), "b": ("contradiction", "challenged"), "c": ("update", "active")}


def test_openers_are_the_callers(spark):
    rows = [(1, "Completed the move", "solution"), (2, "completedness of sets", "solution"), (3, "acme-tool v0.3 shipped", "solution"), (4, "sprint notes: nothing", "solution"), (5, "Completed: see src/app/x.py", "solution"), (6, "  ", "solution")]
    df = spark.createDataFrame(rows, "id int, content string, content_type string").selectExpr("*", "false AS deleted", "array('t') AS tags")
    bucket = lambda *openers: {r["id"] for r in (lifecycle.hygiene_buckets(df, openers) if openers else lifecycle.hygiene_buckets(df)).collect() if r["bucket"] == "noise_journal"}
    assert bucket() == {1, 3, 6}
    assert bucket(*lifecycle.JOURNAL_OPENERS, "sprint notes") == {1, 3, 4, 6}


@pytest.mark.parametrize("step", ["rename", "note"])
def test_a_failure_while_publishing_loses_nothing(spark, tmp_path, monkeypatch, step):
    catalog = Catalog(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([("t1", "cache", 1)], "id string, term string, tf int")
    catalog.publish({"keyword_postings": one})
    if step == "rename":
        monkeypatch.setattr(catalog, "_replace", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    else:
        write = catalog._write_text
        monkeypatch.setattr(catalog, "_write_text", lambda path, text: (_ for _ in ()).throw(OSError("lost")) if "_pointers" in path else write(path, text))
    with pytest.raises(OSError, match="lost"):
        catalog.append({"keyword_postings": one})
    monkeypatch.undo()
    held = {"rename": 1, "note": 2}[step]  # before the rename nothing has happened, after it all has
    assert catalog.read("keyword_postings").count() == held and catalog.pointer()["version"] == held and catalog.at(held)
    assert catalog.append({"keyword_postings": one}) == held + 1 and catalog.read("keyword_postings").count() == held + 1
    catalog.rollback(1)
    assert catalog.read("keyword_postings").count() == 1
    assert catalog.append({"keyword_postings": one}) == held + 2 and catalog.read("keyword_postings").count() == 2
    (tmp_path / "s/_current.json").unlink()  # a pointer lost from outside
    assert catalog.pointer()["version"] == held + 2


def test_two_scopes_learn_one_fact(spark, tmp_path):
    config = DEFAULTS.override(dim=64, cluster_similarity=0.4)
    a = MemoryEngine(spark, f"file://{tmp_path}/s", config, owner=Scope(project_slug="a"))
    b = MemoryEngine(spark, f"file://{tmp_path}/s", config, owner=Scope(project_slug="b"))
    same = [('{"type": "preference", "key": "editor", "value": "vim"}', "preference"), ('{"type": "preference", "key": "editor ", "value": "vim."}', "preference")]
    for k, engine in enumerate((a, b)):
        engine.ingest(spark.createDataFrame(same, "content string, content_type string"), "2024-01-01")
        engine.consolidate(f"2024-01-0{2 + k}")
    mine, theirs = a.browse_claims("2024-01-05").collect(), b.browse_claims("2024-01-05").collect()
    assert len(mine) == len(theirs) == 1 and mine[0]["id"] != theirs[0]["id"] and mine[0]["canonical_text"] == theirs[0]["canonical_text"]
    topic = a.catalog.read("knowledge_topics").filter("project_slug = 'a'").first()["id"]
    a.correct(topic, "## Preferences\n\n- **editor**: emacs\n", "2024-01-06")
    assert [r["id"] for r in b.browse_claims("2024-01-07").filter("status = 'active'").collect()] == [theirs[0]["id"]]
    assert mine[0]["id"] not in {r["id"] for r in a.browse_claims("2024-01-07").filter("status = 'active'").collect()}
