import math

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import keyword, lifecycle, reads, recall, temporal
from mnemolake.operators.recall import RecallQuery
from mnemolake.sources.conversations import sessions_to_episodes
from mnemolake.sources.embeddings import completions


def test_query_bounds():
    with pytest.raises(ValueError):
        RecallQuery(" ", "2024-01-01")
    with pytest.raises(ValueError):
        RecallQuery("x", "2024-01-01", 51)
    with pytest.raises(ValueError):
        RecallQuery("x", "2024-01-01", sections=("dreams",))
    assert RecallQuery("x", "2024-01-01", 4).fetch_k() == 12 and RecallQuery("x", "2024-01-01", 4, tags=("a",)).fetch_k() == 20 and RecallQuery("x", "2024-01-01", 4).fetch_k(True) == 32


@pytest.mark.parametrize("text,shaped", [("why does it fail", True), ("hello there", False), ("look at src/a/b.py", True), ("open notes.md", True), ("lunch", False)])
def test_solution_shape(text, shaped):
    assert recall.solution_shaped(text) is shaped


def test_scores_by_hand(spark):
    row = [(1, "Fix: edit src/a/b.py", "solution", ["cache"], 0.5, 3, "2024-01-01", 0.8, 0.4, False), (2, "talk", "exchange", [], 0.5, 0, "2024-01-01", 0.8, 0.4, False)]
    df = spark.createDataFrame(row, "id long, content string, content_type string, tags array<string>, surprise_score double, access_count int, created_at string, similarity double, keyword double, linked boolean").withColumn("created_at", F.to_timestamp("created_at"))
    got = {r["id"]: r["score"] for r in recall.episode_scores(df, RecallQuery("fix the cache in src/a/b.py", "2024-03-31")).collect()}
    sim, fresh = 0.7 * 0.8 + 0.3 * 0.4, 0.5  # 90 days: one half-life
    assert got[2] == pytest.approx(sim * 0.5**0.4 * fresh**0.35)
    overlap = recall.query_tokens("fix the cache in src/a/b.py") & recall.query_tokens(row[0][1])
    assert got[1] == pytest.approx(sim * (0.92 + 0.08 * fresh) * 1.08 * (1 + min(len(overlap), 6) * 0.12) * 1.06)


def test_entity_links_come_first(spark):
    df = spark.createDataFrame([(1, "a", True, 0.0), (2, "mentions cache", False, 0.9)], "id long, content string, linked boolean, similarity double").withColumns({"keyword": F.lit(0.0), "content_type": F.lit("fact"), "tags": F.array().cast("array<string>"), "surprise_score": F.lit(0.5), "access_count": F.lit(0), "created_at": F.to_timestamp(F.lit("2024-01-01"))})
    got = {r["id"]: r["score"] for r in recall.episode_scores(df, RecallQuery("x", "2024-01-01", entity="cache")).collect()}
    assert got[1] == pytest.approx(0.35 * 1.35 + 2.0) and got[2] == pytest.approx(0.7 * 0.9 * 0.5**0.4 * 1.12)


def test_valid_time_is_half_open(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-02-01"), (2, None, None), (3, "2024-02-01", None)], "id int, f string, u string").select("id", F.to_timestamp("f").alias("valid_from"), F.to_timestamp("u").alias("valid_until"))
    at = lambda t: [r["id"] for r in df.filter(temporal.valid_at(t)).orderBy("id").collect()]
    assert at("2024-01-01") == [1, 2] and at("2024-01-31 23:59:59") == [1, 2] and at("2024-02-01") == [2, 3] and at("2024-02-01T00:00:00+01:00") == [1, 2]
    ages = df.select(temporal.recency(F.col("valid_from"), "2024-01-01")).orderBy("id").collect()
    assert [round(r[0], 6) for r in ages] == [1.0, 0.5, 1.0]


def test_challenge_history_decides_past_status(spark):
    claims = spark.createDataFrame([("a", "expired"), ("b", "challenged"), ("c", "active")], "id string, status string").withColumns({"claim_type": F.lit("fact"), "created_at": F.to_timestamp(F.lit("2024-01-01")), "valid_from": F.to_timestamp(F.lit("2024-01-01")), "valid_until": F.lit(None).cast("timestamp")})
    events = spark.createDataFrame([("a", "challenged", "2024-02-01"), ("b", "challenged", "2024-03-01"), ("b", "challenged", "2024-02-15")], "claim_id string, event_type string, at string").select("claim_id", "event_type", F.to_timestamp("at").alias("created_at"))
    status = lambda t: {r["id"]: r["status"] for r in temporal.claims_as_of(claims, events, t).collect()}
    assert status("2024-01-15") == {"a": "active", "b": "active", "c": "active"}
    assert status("2024-02-10") == {"a": "challenged", "b": "active", "c": "active"}
    assert status("2024-02-15") == {"a": "challenged", "b": "challenged", "c": "active"}
    assert status("2023-01-01") == {}


def test_bm25_by_hand(spark):
    docs = [(1, "red fox red"), (2, "blue fox"), (3, None), (4, "sea")]
    got = {r["id"]: r["raw"] for r in keyword.bm25(spark.createDataFrame(docs, "id int, content string"), "Red a FOX fox").collect()}
    lengths = {1: 3, 2: 2, 3: 0, 4: 1}
    mean = sum(lengths.values()) / 4
    part = lambda f, d, n: math.log(1 + (4 - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / mean))
    assert got == {1: pytest.approx(part(2, 1, 3) + part(1, 2, 3)), 2: pytest.approx(part(1, 2, 2))}
    tf, lengths_df = keyword.term_tables(spark.createDataFrame(docs, "id int, content string"))
    assert tf.count() == 5 and lengths_df.count() == 4


def test_pairs_windows_and_ranks(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "a"], "2024-01-01"), (2, ["a", "b", "c"], "2024-01-02"), (3, [], "2024-01-03")], "id int, tags array<string>, at string").select("id", "tags", F.to_timestamp("at").alias("created_at"))
    assert {(r["tag_a"], r["tag_b"]): r["count"] for r in reads.tag_pairs(rows).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    values = spark.createDataFrame([(v,) for v in (5, 1, 3, 3)], "v int")
    assert reads.upper_median(values, "v").first()[0] == 3 and reads.nearest_rank(values, "v", 0.95).first()[0] == 5 and reads.upper_median(values.limit(0), "v").first()[0] is None


def test_forget_detaches_and_expires(spark):
    e = spark.createDataFrame([("e1", False), ("e2", False)], "id string, deleted boolean").withColumn("updated_at", F.to_timestamp(F.lit("2024-01-01")))
    v = spark.createDataFrame([("e1", False)], "id string, tombstoned boolean")
    c = spark.createDataFrame([("c1", "active"), ("c2", "active")], "id string, status string").withColumns({"valid_until": F.lit(None).cast("timestamp"), "updated_at": F.to_timestamp(F.lit("2024-01-01"))})
    s = spark.createDataFrame([("c1", "e1", None, None), ("c2", "e1", "t1", None), ("c2", "e2", None, None)], "claim_id string, source_episode_id string, source_topic_id string, source_record_id string")
    out = lifecycle.forget(e, v, c, s, spark.createDataFrame([("e1",)], "id string"), "2024-02-01")
    assert {r["id"]: r["status"] for r in out["claims"].collect()} == {"c1": "expired", "c2": "active"}
    assert {r["id"]: r["deleted"] for r in out["episodes"].collect()} == {"e1": True, "e2": False} and out["vectors"].first()["tombstoned"]
    assert sorted((r["claim_id"], r["source_episode_id"] or "") for r in out["claim_sources"].collect()) == [("c2", ""), ("c2", "e2")]
    assert [r["claim_id"] for r in out["claim_events"].collect()] == ["c1"]


def test_injected_model_and_dialogues(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bad")], "id long, prompt string")

    def call(p):
        if p == "bad":
            raise RuntimeError("no")
        return p.upper()

    assert {r["id"]: (r["completion"], r["error"]) for r in completions(rows, call).collect()} == {1: ("A", None), 2: (None, "no")}
    assert {r["error"] for r in completions(rows, None).collect()} == {"completions are disabled"}
    talk = spark.createDataFrame([([("ann", "hi"), ("bob", "yo")], "May 1")], "session_1 array<struct<speaker:string,text:string>>, session_1_date_time string")
    assert [r["content"] for r in sessions_to_episodes(talk, ["session_1"]).orderBy("turn").collect()] == ["[May 1] ann: hi", "[May 1] bob: yo"]
