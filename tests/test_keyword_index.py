"""The kept keyword index gives what reading all texts gives, whatever has happened to the store."""

import pytest

from mnemolake.config import DEFAULTS
from mnemolake.engine import MemoryEngine
from mnemolake.operators import keyword
from mnemolake.operators.scope import Scope

TEXTS = ["cache fails on cold start", "the cache is warm, the cache is fine", "lunch at noon", "Cache-key: CACHE_9 cachet", "start the server", "naïve café start", ""]


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, content string")


def found(df):
    return {r["id"]: (round(r["raw"], 12), round(r["keyword"], 12)) for r in df.collect()}


@pytest.mark.parametrize("known", [[], [0, 2, 5], list(range(7)), [0, 1, 2, 3, 4, 5, 6, 90]])
def test_equals_reading_all(spark, known):
    docs = [(f"d{i}", t) for i, t in enumerate(TEXTS)] + [("d7", None)]
    other = [(f"x{i}", "cache cache start") for i in range(3)]  # not searched
    postings, lengths = keyword.term_tables(table(spark, [d for i, d in enumerate(docs) if i in known] + other))
    for query in ("cache start", "CACHE", "café the 9", "nowhere", "!", "start start noon"):
        want = found(keyword.bm25(table(spark, docs), query))
        assert found(keyword.search_index(postings, lengths, table(spark, docs), query)) == want
    top = keyword.search_index(postings, lengths, table(spark, docs), "cache start", 2)
    assert [r["id"] for r in top.collect()] == [r["id"] for r in keyword.bm25(table(spark, docs), "cache start", 2).collect()]


def notes(spark, *texts):
    return spark.createDataFrame([(t, "fact") for t in texts], "content string, content_type string")


def test_follows_the_store(spark, tmp_path):
    config = DEFAULTS.override(dim=64)
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", config)
    other = MemoryEngine(spark, f"file://{tmp_path}/s", config, owner=Scope(project_slug="other"))
    same = lambda e: found(e._keywords(e._read("episodes").filter("NOT deleted"), "cache start", 50)) == found(keyword.bm25(e._read("episodes").filter("NOT deleted"), "cache start"))
    engine.ingest(notes(spark, *TEXTS[:3]), "2024-01-01")
    assert engine.keyword_coverage() == {"live": 3, "indexed": 3, "stale": 0} and same(engine)
    other.ingest(notes(spark, *TEXTS[3:5]), "2024-01-02")
    assert same(engine) and same(other)
    engine.forget(engine.search("lunch").select("id"), "2024-01-03")
    assert engine.keyword_coverage() == {"live": 4, "indexed": 4, "stale": 1} and same(engine)
    # Rows that come by another way are found at once, and indexed with the next rebuild.
    engine.catalog.append({"episodes": spark.createDataFrame([("z1", "cache from elsewhere", "fact")], "id string, content string, content_type string")})
    assert engine.keyword_coverage()["indexed"] == 4 and same(engine) and "z1" in found(engine._keywords(engine._read("episodes"), "elsewhere", 5))
    engine.compact("2024-01-04")
    assert engine.keyword_coverage()["stale"] == 0
    assert engine.reindex_keywords() == 5 and engine.keyword_coverage() == {"live": 5, "indexed": 5, "stale": 0} and same(engine) and same(other)
    with pytest.raises(PermissionError):
        MemoryEngine(spark, engine.catalog.root, owner=Scope(write_mode="deny")).reindex_keywords()


def test_only_the_terms_asked_for_are_read(spark, tmp_path):
    engine = MemoryEngine(spark, f"file://{tmp_path}/s", DEFAULTS.override(dim=64))
    engine.ingest(notes(spark, *TEXTS[:4]), "2024-01-01")
    plan = engine._keywords(engine._read("episodes"), "cache", 5)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,cache)" in plan or "In(term, [cache])" in plan
    assert "content" not in plan.split("== Physical Plan ==")[1]
