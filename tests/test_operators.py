import numpy as np
import pytest

from mnemolake.config import EngineConfig
from mnemolake.operators import evaluate, lifecycle, scope, trust, vectors
from mnemolake.sources import markdown
from mnemolake.sources.embeddings import HashEncoder, WordHashEncoder, encode, incremental


def test_config_layers(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("[engine]\ndim = 8\nmin_cluster_size = 3\n")
    c = EngineConfig.load(f, {"MNEMOLAKE_DIM": "16"})
    assert (c.dim, c.min_cluster_size, c.recency_half_life_days) == (16, 3, 90.0)
    f.write_text("[engine]\nnonsense = 1\n")
    with pytest.raises(ValueError):
        EngineConfig.load(f, {})
    with pytest.raises(ValueError):
        EngineConfig(vector_weight=0.9)


def test_scope_forms():
    s = scope.coerce({"namespace": {"slug": "team"}, "project": {"slug": "p"}, "policy": {"read_visibility": "project"}})
    assert s.read_filter() == {"namespace_slug": "team", "project_slug": "p"}
    assert scope.coerce("team/p").project_slug == "p" and scope.coerce(None) == scope.Scope()
    assert scope.Scope(read_visibility="namespace").mutation_filter()["project_slug"] == "default"
    with pytest.raises(ValueError):
        scope.coerce({"colour": "red"})
    with pytest.raises(PermissionError):
        scope.Scope(write_mode="deny").require_write()


def test_dirty_counters_count_as_zero(spark):
    base = dict.fromkeys(["validation_count", "success_count", "partial_success_count", "failure_count", "explicit_failure_count", "reverted_count", "superseded_count", "contradiction_count", "challenged_count", "drift_event_count", "expiry_event_count", "source_link_count", "source_episode_count", "source_topic_count", "source_record_count", "source_anchor_count", "outcomes_with_provenance_count"], "0")
    rows = [{"id": "a", "status": "active", **base}, {"id": "b", "status": " Challenged ", **base, "validation_count": "5", "success_count": "5.0", "contradiction_count": "garbage", "failure_count": "-3"}]
    df = spark.createDataFrame([{**r, "last_observed_at": "2024-01-10", "updated_at": None} for r in rows], f"id string, status string, {', '.join(f'{k} string' for k in base)}, last_observed_at string, updated_at string")
    got = {r["id"]: r for r in trust.with_reuse(trust.with_reliability(df, "2024-01-20"), "2024-01-20").withColumn("p", trust.precision()).collect()}
    assert got["a"]["reliability"] == 30 and got["a"]["reusability"] == "unvalidated"  # 50 - 10 - 4 + 8 - 10 - 3, to the nearest five
    assert got["b"]["reliability"] == 55 and got["b"]["recommendation"] == "reuse_with_caution"  # 50 + 15 + 12 - 15 + 8 - 10 - 3
    assert got["b"]["p"] == pytest.approx(0.75 * 1.15) and sum(x["points"] for x in got["b"]["adjustments"]) == 7


def test_scheduler_scalars():
    u = trust.utility({"backlog": 50, "misses": 1, "fallbacks": 2, "failure_rate": 0.5}, {"backlog": 100, "recall": 10})
    assert u["score"] == pytest.approx(0.35 * 0.5 + 0.15 * 0.5 + 0.2 * 0.5) and u["dominant"][0] == "unconsolidated_backlog"
    assert trust.should_run(False, 30, 40, 0, 5, 0.1) == "backlog" and trust.should_run(False, 0, 40, 0, 5, 0.7) == "utility" and trust.should_run(False, 0, 40, 0, 5, 0.1) is None
    assert trust.health(True, 0.0, 1.0, 1.0) == "healthy" and trust.health(False, 0, 1, None) == "error" and trust.posture(0, 0, 0) == "bootstrapping"


def test_average_linkage_joins_what_is_near():
    v = np.array([[1, 0], [0.99, 0.14], [0, 1], [0.1, 0.99], [-1, 0]], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert vectors.average_linkage(v @ v.T, 0.78).tolist() == [0, 0, 2, 2, 4]


def test_cluster_keeps_scopes_apart_and_splits_large_ones(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in "ab":
        for c in range(3):
            centre = rng.normal(size=8)
            for _ in range(4):
                x = centre + 0.01 * rng.normal(size=8)
                rows.append((len(rows), s, [float(y) for y in x / np.linalg.norm(x)]))
    df = spark.createDataFrame(rows, "id long, scope string, embedding array<double>")
    got = {r["id"]: r["cluster"] for r in vectors.cluster(df, ["scope"]).collect()}
    assert len(got) == 24 and all(got[i] == i // 4 * 4 for i in got)
    assert set(vectors.cluster(df, ["scope"], block=4).select("id").toPandas()["id"]) <= set(got)


def test_greedy_dedup_takes_the_first(spark):
    df = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "s", [1.0, 0.01]), (3, "t", [1.0, 0.0]), (4, "s", [0.0, 1.0])], "id long, scope string, embedding array<double>")
    got = {r["id"]: r["duplicate_of"] for r in vectors.greedy_dedup(df, ["scope"]).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: None}


def test_merge_and_append(spark):
    cur = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.6)], "id long, title string, confidence double")
    new = spark.createDataFrame([(2, "B", 0.1), (3, "c", 0.2)], "id long, title string, confidence double")
    assert sorted(map(tuple, lifecycle.merge(cur, new, ["id"], keep=["confidence"]).collect())) == [(1, "a", 0.5), (2, "B", 0.6), (3, "c", 0.2)]
    assert lifecycle.append_new(cur, new.unionByName(new), ["id"]).count() == 3


def test_markdown_round_trip():
    records = [{"type": "fact", "subject": "s", "info": "i"}, {"type": "solution", "problem": "p", "fix": "f\ng", "context": "x"}, {"type": "preference", "key": "k", "value": "v", "context": "c"}, {"type": "strategy", "problem_pattern": "pp", "strategy": "st", "preconditions": "pre", "failure_modes": "fm"}]
    text = markdown.render("T", "S", ["a"], 0.8, records)
    assert markdown.parse(text) == records and markdown.front_matter(text)[0]["title"] == "T"
    assert markdown.storage_name("A b.md", {"x": "1"}) != markdown.storage_name("A b.md", {"x": "2"})
    assert markdown.safe_path("/k", "a.md") == "/k/a.md"
    for bad in ("../a.md", "/etc/x", "a/../../b", ""):
        with pytest.raises(ValueError):
            markdown.safe_path("/k", bad)


def test_encoders_and_cache(spark):
    e = HashEncoder(16)
    assert np.allclose(e.encode(["a"]), e.encode(["a"])) and np.allclose(np.linalg.norm(e.encode(["a", "b"]), axis=1), 1)
    w = WordHashEncoder(64).encode(["red fox", "red fox runs", "blue sea"])
    assert w[0] @ w[1] > w[0] @ w[2]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    first = incremental(rows, None, e)
    cache = spark.createDataFrame(first.collect(), first.schema)
    again = incremental(spark.createDataFrame([(1, "a"), (3, "new")], "id long, text string"), cache, e)
    assert {r["id"] for r in again.collect()} == {1, 3} and encode(rows.limit(0), e).count() == 0


def test_evaluation_scalars(spark):
    assert evaluate.bootstrap(5, 10)[1] < 0.5 < evaluate.bootstrap(5, 10)[2] and evaluate.bootstrap(0, 0) == (0.0, 0.0, 0.0)
    g = evaluate.gates({"freshness": 0.98, "leak_rate": 0.5})
    assert (g["freshness"], g["leak_rate"], g["scope_isolation"]) == ("pass", "fail", "missing")
    assert set(evaluate.gates({"freshness": 1.0}, age_hours=1000).values()) == {"missing"}
