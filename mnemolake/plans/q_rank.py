"""Queries of trust formulas, vectors, keywords, recall, consolidation, streams and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.config import DEFAULTS
from mnemolake.functions import text
from mnemolake.operators import consolidate, keyword, lifecycle, reads, recall, temporal, trust, vectors
from mnemolake.plans.q_reads import ASSEMBLED_SQL, AS_OF, NOW, _evidence, secs
from mnemolake.registry import query

_POINTS = """
points AS (SELECT *, greatest(failure_count, explicit_failure_count + reverted_count + superseded_count) AS bad, success_count + 0.5::DOUBLE * partial_success_count AS good,
  CAST(source_episode_count > 0 AS INT) + CAST(source_topic_count > 0 AS INT) + CAST(source_record_count > 0 AS INT) AS kinds,
  greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-01-20') - epoch(coalesce(last_observed_at, updated_at))) / 86400) AS age FROM ev),
ratio AS (SELECT *, CASE WHEN success_count + partial_success_count + bad > 0 THEN good / (success_count + partial_success_count + bad) END AS ratio FROM points),
signals AS (SELECT *,
  CASE WHEN validation_count >= 5 THEN 15 WHEN validation_count >= 2 THEN 8 WHEN validation_count = 1 THEN 4 ELSE -10 END AS p1,
  CASE WHEN ratio IS NULL THEN -4 WHEN ratio >= 0.8 THEN 12 WHEN ratio >= 0.6 THEN 6 WHEN ratio >= 0.4 THEN 0 ELSE -8 END AS p2,
  -(least(12, explicit_failure_count * 4) + least(12, (reverted_count + superseded_count) * 6)) AS p3,
  -least(24, contradiction_count * 8) AS p4,
  -(least(18, drift_event_count * 6) + least(9, challenged_count * 3) + CASE status WHEN 'challenged' THEN 15 WHEN 'expired' THEN 20 ELSE 0 END) AS p5,
  CASE WHEN age <= 14 THEN 8 WHEN age <= 60 THEN 4 WHEN age <= 180 THEN 0 ELSE -6 END AS p6,
  CASE WHEN source_link_count >= 3 THEN 4 WHEN source_link_count >= 1 THEN 2 ELSE -6 END + CASE WHEN kinds >= 3 THEN 3 WHEN kinds = 2 THEN 2 WHEN kinds = 1 THEN 1 ELSE -4 END + CASE WHEN outcomes_with_provenance_count > 0 THEN 2 ELSE 0 END AS p7,
  CASE WHEN source_anchor_count >= 3 THEN 4 WHEN source_anchor_count >= 1 THEN 2 ELSE -3 END AS p8,
  -least(10, expiry_event_count * 5) AS p9 FROM ratio),
rel AS (SELECT *, CAST(5 * round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, CAST(50 + p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 + p9 AS DOUBLE))) / 5, 0) AS INT) AS reliability FROM signals)
"""
REL_SQL = f"WITH {ASSEMBLED_SQL}, {_POINTS}"
_BAND = "CASE WHEN reliability >= 75 THEN 'high' WHEN reliability >= 55 THEN 'moderate' WHEN reliability >= 35 THEN 'guarded' ELSE 'low' END AS band"
_ADVICE = "CASE WHEN status = 'expired' OR reliability < 35 THEN 'avoid_reuse' WHEN status = 'challenged' OR reliability < 55 THEN 'reuse_with_caution' WHEN reliability >= 75 THEN 'reusable' ELSE 'conditionally_reusable' END AS recommendation"


@query("tr01_reliability", f"{REL_SQL} SELECT id, reliability, {_BAND}, {_ADVICE}, round(0.2::DOUBLE + reliability / 100 * 1.2::DOUBLE, 3) AS ranking_multiplier FROM rel")
def _(e):
    return trust.with_reliability(_evidence(e), NOW).select("id", "reliability", "band", "recommendation", "ranking_multiplier")


_PRECISION = """
raw AS (SELECT *, 1.0::DOUBLE + least(0.15::DOUBLE, success_count * 0.03::DOUBLE) + least(0.08::DOUBLE, partial_success_count * 0.02::DOUBLE) - least(0.45::DOUBLE, bad * 0.12::DOUBLE)
  - least(0.5::DOUBLE, contradiction_count * 0.15::DOUBLE) - least(0.4::DOUBLE, drift_event_count * 0.12::DOUBLE) - least(0.25::DOUBLE, challenged_count * 0.08::DOUBLE) AS p FROM rel),
prec AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE status WHEN 'challenged' THEN p * 0.75::DOUBLE WHEN 'expired' THEN least(p, 0.1::DOUBLE) ELSE p END)) AS prec FROM raw)
"""


@query("tr03_precision", f"{REL_SQL}, {_PRECISION} SELECT id, round(prec, 6) AS precision, round(prec * 0.55::DOUBLE, 6) AS competing FROM prec")
def _(e):
    p = trust.precision()
    return _evidence(e).select("id", F.round(p, 6).alias("precision"), F.round(trust.competing_precision(p), 6).alias("competing"))


@query("tr06_strategy_reuse", f"""{REL_SQL},
adv AS (SELECT *, failure_count + contradiction_count + 0.5::DOUBLE * challenged_count AS risk, {_ADVICE}, round(0.2::DOUBLE + reliability / 100 * 1.2::DOUBLE, 3) AS mult FROM rel),
m AS (SELECT *, greatest(0.2::DOUBLE, 1.0::DOUBLE + least(0.35::DOUBLE, ln(1 + validation_count) * 0.12::DOUBLE) + least(0.45::DOUBLE, good * 0.1::DOUBLE) - least(0.75::DOUBLE, risk * 0.2::DOUBLE)) AS plain FROM adv)
SELECT id, good AS support_weight, risk AS risk_weight, greatest(0.2::DOUBLE, least(1.5::DOUBLE, round((plain + mult) / 2, 3))) AS reuse_multiplier,
  CASE WHEN validation_count = 0 THEN 'unvalidated' WHEN risk = 0 AND good >= 2 AND recommendation NOT IN ('avoid_reuse', 'reuse_with_caution') THEN 'validated' WHEN risk > good OR recommendation = 'avoid_reuse' THEN 'degraded' ELSE 'mixed' END AS reusability FROM m""")
def _(e):
    return trust.with_reuse(_evidence(e), NOW).select("id", "support_weight", "risk_weight", "reuse_multiplier", "reusability")


_SUPPORT = """
parts AS (SELECT *,
  CASE WHEN (valid_from IS NOT NULL AND TIMESTAMP '1998-06-01' < valid_from) OR (valid_until IS NOT NULL AND TIMESTAMP '1998-06-01' >= valid_until) THEN 0.05::DOUBLE
       WHEN valid_until IS NOT NULL AND epoch(valid_until) - epoch(TIMESTAMP '1998-06-01') <= 86400 THEN 0.8::DOUBLE WHEN valid_until IS NOT NULL AND epoch(valid_until) - epoch(TIMESTAMP '1998-06-01') <= 604800 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS temporal,
  CASE WHEN validation_count = 0 THEN 0.35::DOUBLE ELSE greatest(0.2::DOUBLE, least(1.0::DOUBLE, 0.35::DOUBLE + good / greatest(1.0::DOUBLE, good + bad) * 0.45::DOUBLE + least(1.0::DOUBLE, validation_count / 5.0::DOUBLE) * 0.2::DOUBLE - CASE WHEN bad > good THEN least(0.2::DOUBLE, (bad - good) * 0.05::DOUBLE) ELSE 0 END)) END AS support,
  greatest(0.25::DOUBLE, 1.0::DOUBLE - (CASE status WHEN 'challenged' THEN 0.22::DOUBLE WHEN 'expired' THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END + least(0.45::DOUBLE, drift_event_count * 0.07::DOUBLE + challenged_count * 0.05::DOUBLE + contradiction_count * 0.03::DOUBLE))) AS penalty FROM prec)
"""


@query("tr07_rank_factors", f"{REL_SQL}, {_PRECISION}, {_SUPPORT} SELECT id, temporal, round(support, 4) AS support, round(penalty, 4) AS penalty FROM parts")
def _(e):
    return _evidence(e).select("id", trust.temporal_validity(AS_OF).alias("temporal"), F.round(trust.outcome_support(), 4).alias("support"), F.round(trust.drift_penalty(), 4).alias("penalty"))


@query("tr08_claim_rank", f"""{REL_SQL}, {_PRECISION}, {_SUPPORT},
k AS (SELECT *, (CAST(contains(lower(canonical_text), 'urgent') AS INT) + CAST(contains(lower(canonical_text), 'claim') AS INT)) / 2.0::DOUBLE AS keyword FROM parts),
s AS (SELECT *, ((keyword * 0.2::DOUBLE) * (0.5::DOUBLE + greatest(0.0::DOUBLE, least(1.0::DOUBLE, confidence)) * 0.5::DOUBLE) * 0.55::DOUBLE + reliability / 100 * 0.2::DOUBLE + temporal * 0.1::DOUBLE + support * 0.15::DOUBLE) * greatest(0.2::DOUBLE, least(1.5::DOUBLE, round(0.2::DOUBLE + reliability / 100 * 1.2::DOUBLE, 3))) * penalty * prec AS score FROM k)
SELECT id, round(greatest(0.0::DOUBLE, score), 3) AS score FROM s""")
def _(e):
    rows = trust.with_reliability(_evidence(e), NOW)
    k = keyword.share_of_words("urgent claim", F.col("canonical_text"))
    score = trust.claim_rank(F.lit(0.0), k, F.lit(0.0), AS_OF, precision_=trust.precision())
    return rows.select("id", score.alias("score"))


@query("tr09_surprise", """
WITH m AS (SELECT access_count AS median FROM episodes WHERE NOT deleted ORDER BY access_count LIMIT 1 OFFSET (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM episodes WHERE NOT deleted)),
s AS (SELECT id, surprise_score AS old, CASE WHEN median > 0 AND access_count > median THEN greatest(surprise_score, surprise_score + least((access_count - median) * 0.02::DOUBLE, 0.15::DOUBLE)) ELSE surprise_score END
  - CASE WHEN access_count = 0 AND consolidated = 1 AND (epoch(TIMESTAMP '2024-02-20') - epoch(updated_at)) / 86400 >= 7 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM episodes, m WHERE NOT deleted AND consolidated <> 2),
c AS (SELECT id, old, greatest(0.1::DOUBLE, least(1.0::DOUBLE, raw)) AS new FROM s)
SELECT id, round(new, 4) AS surprise_score FROM c WHERE abs(new - old) >= 0.005 AND round(new, 4) <> old
""")
def _(e):
    return consolidate.surprise_update(e.episodes, "2024-02-20")


_QUERY_VECTOR = "(SELECT embedding FROM vectors WHERE id = 7)"


def _vector(e, i: int = 7):
    """The query's own vector: one row."""
    return [float(x) for x in e.vectors.filter(F.col("id") == i).first()["embedding"]]


@query("jn18_nearest", f"SELECT id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), 4) AS similarity FROM vectors WHERE NOT tombstoned ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])) DESC, id LIMIT 10")
def _(e):
    return vectors.top_k(e.vectors, _vector(e), 10).select("id", F.round("similarity", 4).alias("similarity"))


@query("jn22_contradiction_candidates", "WITH p AS (SELECT a.label, a.id AS a, b.id AS b, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM vectors a JOIN vectors b ON a.label = b.label WHERE a.id % 2 = 0 AND b.id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, a, b) AS rank FROM p WHERE s >= 0.2) SELECT label, a, b, round(s, 4) AS similarity FROM r WHERE rank <= 24")
def _(e):
    v = e.vectors
    return vectors.contradiction_candidates(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), ["label"], 0.2, 24).select("label", "a", "b", F.round("similarity", 4).alias("similarity"))


_BM25 = """
w AS (SELECT id, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM episodes WHERE NOT deleted),
f AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS f0, len(list_filter(w, lambda x: x = 'version')) AS f1 FROM w),
c AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f),
b AS (SELECT id, ln(1 + (docs - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * f0 * 2.2::DOUBLE / (f0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) + ln(1 + (docs - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS raw FROM f, c WHERE f0 + f1 > 0)
"""


@query("rk02_keyword_bm25", f"WITH {_BM25} SELECT id, round(raw, 4) AS raw, round(raw / (raw + 1), 4) AS keyword FROM b")
def _(e):
    return keyword.bm25(e.episodes.filter("NOT deleted"), "License version").select("id", F.round("raw", 4).alias("raw"), F.round("keyword", 4).alias("keyword"))


@query("rk03_keyword_index", f"WITH {_BM25} SELECT id, round(raw, 4) AS raw, round(raw / (raw + 1), 4) AS keyword FROM b")
def _(e):
    # The index knows two thirds of the texts, deleted ones among them; the rest is counted beside it.
    postings, lengths = keyword.term_tables(e.episodes.filter("id % 3 <> 0"))
    return keyword.search_index(postings, lengths, e.episodes.filter("NOT deleted"), "License version").select("id", F.round("raw", 4).alias("raw"), F.round("keyword", 4).alias("keyword"))


_HYBRID = f"""
v AS (SELECT id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])) AS similarity FROM vectors WHERE NOT tombstoned ORDER BY 2 DESC, id LIMIT 30),
k AS (SELECT id, raw / (raw + 1) AS keyword FROM b ORDER BY raw DESC, id LIMIT 50),
m AS (SELECT coalesce(v.id, k.id) AS id, coalesce(similarity, 0.0::DOUBLE) AS similarity, coalesce(keyword, 0.0::DOUBLE) AS keyword FROM v FULL JOIN k ON v.id = k.id)
"""


@query("jn28_candidate_merge", f"WITH {_BM25}, {_HYBRID} SELECT id, round(similarity, 4) AS similarity, round(keyword, 4) AS keyword, round(similarity * 0.7::DOUBLE + keyword * 0.3::DOUBLE, 4) AS sim FROM m")
def _(e):
    near = vectors.top_k(e.vectors, _vector(e), 30)
    words = keyword.bm25(e.episodes.filter("NOT deleted"), "license version", 50)
    m = recall.merge_candidates(near, words)
    return m.select("id", F.round("similarity", 4).alias("similarity"), F.round("keyword", 4).alias("keyword"), F.round(recall.hybrid(F.col("similarity"), F.col("keyword")), 4).alias("sim"))


@query("rk24_hybrid_recall", f"""
WITH {_BM25}, {_HYBRID},
s AS (SELECT e.id, e.content_type, m.similarity * 0.7::DOUBLE + m.keyword * 0.3::DOUBLE AS sim, e.surprise_score, e.access_count, greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-02-10') - epoch(e.created_at)) / 86400) AS age FROM m JOIN episodes e ON e.id = m.id WHERE NOT e.deleted AND e.indexed AND e.content_type IN ('fact', 'solution', 'preference', 'procedure', 'exchange')),
r AS (SELECT id, content_type, sim * pow(surprise_score, 0.4::DOUBLE) * pow(exp(-age * ln(2.0::DOUBLE) / 90), 0.35::DOUBLE) * (1 + ln(1 + access_count) * 0.25::DOUBLE) AS score FROM s)
SELECT id, content_type, round(score, 4) AS score FROM r ORDER BY r.score DESC, id LIMIT 10
""")
def _(e):
    q = recall.RecallQuery("license version", "2024-02-10", 10, content_types=("fact", "solution", "preference", "procedure", "exchange"))
    near = vectors.top_k(e.vectors, _vector(e), 30)
    words = keyword.bm25(e.episodes.filter("NOT deleted"), q.text, 50)
    rows = recall.merge_candidates(near, words).join(recall.filtered(e.episodes, q), "id")
    return recall.episode_scores(rows, q).orderBy(F.desc("score"), "id").limit(10).select("id", "content_type", F.round("score", 4).alias("score"))


@query("rk05_recency", "SELECT id, round(exp(-greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-01-20') - epoch(created_at)) / 86400) * ln(2.0::DOUBLE) / 90), 4) AS recency FROM episodes")
def _(e):
    return e.episodes.select("id", F.round(temporal.recency(F.col("created_at"), NOW), 4).alias("recency"))


@query("rk06_priority", "SELECT id, round(surprise_score * pow(surprise_score, 0.4::DOUBLE) * pow(exp(-greatest(0.0::DOUBLE, (epoch(TIMESTAMP '2024-01-20') - epoch(created_at)) / 86400) * ln(2.0::DOUBLE) / 90), 0.35::DOUBLE) * (1 + ln(1 + access_count) * 0.25::DOUBLE), 4) AS priority FROM episodes")
def _(e):
    return e.episodes.select("id", F.round(recall.priority(F.col("surprise_score"), NOW), 4).alias("priority"))


@query("rk08_solution_recall")
def _(e):
    q = recall.RecallQuery("fix the failing license error in src/en/src1.py", "2024-02-10", 20)
    return recall.episodes_section(e.episodes, e.vectors, _vector(e), q, reads.tag_pairs(e.episodes)).select("id", "content_type", F.round("score", 6).alias("score"))


@query("rk10_tag_multiplier", "SELECT id, round(1 + least(len(list_intersect(tags, ['src1', 'src12'])), 3) * 0.06::DOUBLE, 4) AS multiplier FROM episodes")
def _(e):
    return e.episodes.select("id", F.round(recall.tag_multiplier("src1 and src12 en"), 4).alias("multiplier"))


@query("rk12_entity_multiplier", "SELECT id, CASE WHEN contains(lower(content), 'src/license.md') THEN 1.12 WHEN contains(lower(content), 'license.md') THEN 1.08 ELSE 1.0 END::DOUBLE AS multiplier FROM episodes")
def _(e):
    return e.episodes.select("id", recall.entity_multiplier("src/license.md", F.col("content")).cast("double").alias("multiplier"))


@query("rk14_topics", """
WITH s AS (SELECT t.id, (CAST(contains(lower(t.title), 'supplier#000000002') AS INT) + CAST(contains(lower(t.title), 'supplier') AS INT)) / 2.0::DOUBLE AS kw, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST((SELECT embedding FROM vectors WHERE id = 7) AS DOUBLE[])) AS sem, t.confidence, t.access_count FROM topics t LEFT JOIN vectors v ON v.id = t.id),
r AS (SELECT id, (coalesce(sem, 0) * 0.8::DOUBLE + kw * 0.2::DOUBLE) * (confidence * 0.5::DOUBLE + 0.5::DOUBLE) * (1 + ln(1 + access_count) * 0.25::DOUBLE) AS relevance FROM s)
SELECT id, round(relevance, 3) AS relevance FROM r WHERE relevance >= 0.25 ORDER BY 2 DESC, id LIMIT 5
""")
def _(e):
    sims = e.vectors.select("id", vectors.dot(F.col("embedding"), vectors.literal(_vector(e))).alias("similarity"))
    return recall.topics_section(e.topics, sims, recall.RecallQuery("supplier#000000002 supplier", NOW)).select("id", "relevance")


@query("rk15_records", """
WITH s AS (SELECT r.id, r.record_type, (CAST(contains(lower(embedding_text), 'small') AS INT) + CAST(contains(lower(embedding_text), 'ring') AS INT) + CAST(contains(lower(embedding_text), 'build') AS INT)) / 3.0::DOUBLE AS kw, list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST((SELECT embedding FROM vectors WHERE id = 7) AS DOUBLE[])) AS sem, confidence, access_count FROM records r LEFT JOIN vectors v ON v.id = r.id WHERE NOT r.deleted),
q AS (SELECT id, (coalesce(sem, 0) * 0.9::DOUBLE + kw * 0.1::DOUBLE) * CASE WHEN record_type = 'procedure' THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END * (confidence * 0.5::DOUBLE + 0.5::DOUBLE) * (1 + ln(1 + access_count) * 0.25::DOUBLE) AS relevance FROM s)
SELECT id, round(relevance, 3) AS relevance FROM q WHERE relevance >= 0.3 ORDER BY 2 DESC, id LIMIT 15
""")
def _(e):
    sims = e.vectors.select("id", vectors.dot(F.col("embedding"), vectors.literal(_vector(e))).alias("similarity"))
    return recall.records_section(e.records.filter("NOT deleted"), sims, recall.RecallQuery("small ring build", NOW)).select("id", "relevance")


@query("rk19_shared_words", "SELECT id, (CAST(contains(lower(canonical_text), 'urgent') AS INT) + CAST(contains(lower(canonical_text), 'low') AS INT) + CAST(contains(lower(canonical_text), 'of 8') AS INT) * 0 + CAST(contains(lower(canonical_text), '88') AS INT)) / 3.0::DOUBLE AS share FROM claims")
def _(e):
    return e.claims.select("id", keyword.share_of_words("Urgent low 88", F.col("canonical_text")).alias("share"))


@query("rk22_uncertainty", "SELECT r.id, nullif(concat_ws(' | ', CASE WHEN r.confidence < 0.6 THEN 'Low confidence' END, CASE WHEN r.topic_id IN (SELECT topic_id FROM contradictions WHERE detected_at >= TIMESTAMP '2024-01-28') THEN 'Evolving topic' END), '') AS uncertainty FROM records r")
def _(e):
    recent = e.contradictions.filter(F.col("topic_id").isNotNull() & (F.col("detected_at") >= temporal.instant("2024-01-28"))).select("topic_id")
    return recall.uncertainty(e.records, recent).select("id", "uncertainty")


@query("rk25_access_fold", "SELECT t.id, CAST(t.access_count + coalesce(n.n, 0) AS INTEGER) AS access_count FROM topics t LEFT JOIN (SELECT topic_id AS id, count(*) AS n FROM contradictions GROUP BY topic_id) n ON n.id = t.id")
def _(e):
    return lifecycle.fold_access(e.topics, e.contradictions.filter("topic_id IS NOT NULL").select(F.col("topic_id").alias("id"))).select("id", "access_count")


@query("jn29_uncovered_episodes", "WITH top AS (SELECT id FROM records ORDER BY confidence DESC, id LIMIT 5) SELECT e.id FROM episodes e WHERE e.id NOT IN (SELECT t.id FROM top t UNION SELECT t.id + 1 FROM top t)")
def _(e):
    rows = e.records.withColumn("relevance", F.col("confidence")).withColumn("source_episodes", F.array("id", F.col("id") + 1))
    return recall.without_covered(e.episodes, rows).select("id")


@query("jn30_source_summary")
def _(e):
    rows = e.records.select("id", F.array("id", F.col("id") + 1, F.col("id") + 2).alias("source_episodes"))
    return recall.source_summary(rows, e.episodes, NOW)


@query("jn25_supersession", """
WITH r AS (SELECT r.id, r.topic_id, r.created_at, r.valid_until, CAST(v.embedding AS DOUBLE[]) AS v FROM records r JOIN vectors v ON v.id = r.id),
h AS (SELECT a.id, b.id AS b, list_dot_product(a.v, b.v) AS s FROM r a JOIN r b ON a.topic_id = b.topic_id WHERE a.valid_until <= TIMESTAMP '2024-12-01' AND (b.valid_until IS NULL OR b.valid_until > TIMESTAMP '2024-12-01') AND b.created_at >= a.valid_until - INTERVAL 60 DAY),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, b) AS k FROM h WHERE s >= 0.1)
SELECT id, b AS superseded_by FROM n WHERE k = 1
""")
def _(e):
    rows = e.records.join(e.vectors.select("id", "embedding"), "id").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 60 DAY"))
    return vectors.supersession(rows, temporal.instant("2024-12-01"), 0.1).select("id", "superseded_by")


@query("dm09_expire_claims", "SELECT id, CASE WHEN id % 7 = 0 THEN 'expired' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN CAST(epoch(least(coalesce(valid_until, TIMESTAMP '1998-06-01'), TIMESTAMP '1998-06-01')) AS BIGINT) ELSE CAST(epoch(valid_until) AS BIGINT) END AS valid_until FROM claims")
def _(e):
    return lifecycle.expire(e.claims, e.claims.filter("id % 7 = 0").select("id"), AS_OF).select("id", "status", secs("valid_until"))


@query("dm06_forget_sources", "SELECT claim_id, count(*) AS n, count(source_episode_id) AS with_episode FROM (SELECT claim_id, CASE WHEN source_episode_id % 5 = 0 THEN NULL ELSE source_episode_id END AS source_episode_id FROM claim_sources WHERE source_episode_id IS NULL OR source_episode_id % 5 <> 0 OR source_topic_id IS NOT NULL OR source_record_id IS NOT NULL) GROUP BY claim_id")
def _(e):
    ids = e.claim_sources.filter("source_episode_id % 5 = 0").select(F.col("source_episode_id").alias("id"))
    return lifecycle.detach_sources(e.claim_sources, ids).groupBy("claim_id").agg(F.count("*").alias("n"), F.count("source_episode_id").alias("with_episode"))


@query("dm12_stale_challenged", "WITH f AS (SELECT claim_id AS id, min(created_at) AS challenged_at FROM claim_events WHERE event_type = 'challenged' GROUP BY claim_id) SELECT c.id FROM claims c JOIN f ON f.id = c.id WHERE c.status = 'challenged' AND (c.valid_from IS NULL OR c.valid_from <= TIMESTAMP '1998-06-01') AND (c.valid_until IS NULL OR c.valid_until > TIMESTAMP '1998-06-01') AND f.challenged_at <= TIMESTAMP '1998-06-01' - INTERVAL 168 HOUR ORDER BY f.challenged_at, c.id LIMIT 200")
def _(e):
    return lifecycle.stale_challenged(e.claims, e.claim_events, AS_OF).select("id")


@query("dm13_challenge", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'active' AND id % 3 = 0 AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1998-06-01') AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-06-01') THEN 'challenged' ELSE status END AS status FROM claims) GROUP BY status")
def _(e):
    return lifecycle.challenge(e.claims, e.claims.filter("id % 3 = 0").select("id"), AS_OF)[0].groupBy("status").agg(F.count("*").alias("n"))


@query("dm08_merge_topics", "SELECT id, CASE WHEN id % 2 = 0 THEN 'new ' || title ELSE title END AS title, confidence FROM topics UNION ALL SELECT -1, 'added', 0.5")
def _(e):
    changes = e.topics.filter("id % 2 = 0").withColumn("title", F.concat(F.lit("new "), "title")).withColumn("confidence", F.lit(0.0))
    added = e.spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("added").alias("title"), F.lit(0.5).alias("confidence"))
    return lifecycle.merge(e.topics.select("id", "title", "confidence"), changes.select("id", "title", "confidence").unionByName(added), ["id"], keep=["confidence"])


@query("st05_lifecycle_state", "WITH r AS (SELECT claim_id AS id, event_type, row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, n DESC, CASE WHEN event_type IN ('expire', 'auto_expired_challenged') THEN 2 WHEN event_type IN ('challenged', 'code_drift_detected', 'contradiction') THEN 1 ELSE 0 END DESC, event_type DESC) AS k FROM claim_events) SELECT id, CASE WHEN event_type IN ('expire', 'auto_expired_challenged') THEN 'expired' WHEN event_type IN ('challenged', 'code_drift_detected', 'contradiction') THEN 'challenged' ELSE 'active' END AS state FROM r WHERE k = 1")
def _(e):
    return lifecycle.lifecycle_state(e.claim_events).select("id", "state")


@query("st04_challenged_ttl", """
WITH past AS (SELECT * FROM claim_events WHERE created_at <= TIMESTAMP '1997-06-01'),
g AS (SELECT claim_id AS id, event_type, created_at, n, CASE WHEN event_type IN ('expire', 'auto_expired_challenged') THEN 2 WHEN event_type IN ('challenged', 'code_drift_detected', 'contradiction') THEN 1 ELSE 0 END AS gravity FROM past),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, n DESC, gravity DESC, event_type DESC) AS k, min(created_at) FILTER (event_type = 'challenged') OVER (PARTITION BY id) AS since FROM g),
s AS (SELECT id, event_type, gravity, gravity = 1 AND coalesce(since, created_at) <= TIMESTAMP '1997-06-01' - INTERVAL 720 HOUR AS over FROM r WHERE k = 1)
SELECT id, CASE WHEN over THEN 'auto_expired_challenged' ELSE event_type END AS last, CASE WHEN over OR gravity = 2 THEN 'expired' WHEN gravity = 1 THEN 'challenged' ELSE 'active' END AS state FROM s
""")
def _(e):
    return lifecycle.with_ttl(e.claim_events, "1997-06-01", 720)


@query("st02_lookback_counts", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, observed_at)) AS BIGINT) AS start, outcome_type, count(*) AS n FROM outcomes GROUP BY 1, 2")
def _(e):
    from mnemolake.streaming.ingest import outcome_windows

    return outcome_windows(e.outcomes, "6 hours", "6 hours").select(F.unix_seconds(F.col("start").cast("timestamp")).alias("start"), "outcome_type", "n")


@query("st08_sessions")
def _(e):
    from mnemolake.streaming.ingest import sessions

    return sessions(e.table("events"), "30 minutes")


@query("ev08_token_f1", """
WITH t AS (SELECT conv_id, max(text) FILTER (turn = 0) AS a, max(text) FILTER (turn = 1) AS b FROM turns GROUP BY conv_id),
a AS (SELECT conv_id, unnest(string_split_regex(trim(lower(a)), '\\s+')) AS w FROM t WHERE a IS NOT NULL AND b IS NOT NULL), b AS (SELECT conv_id, unnest(string_split_regex(trim(lower(b)), '\\s+')) AS w FROM t WHERE a IS NOT NULL AND b IS NOT NULL),
x AS (SELECT conv_id, w, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT conv_id, w, count(*) AS n FROM b GROUP BY 1, 2),
o AS (SELECT x.conv_id, sum(least(x.n, y.n)) AS shared FROM x JOIN y ON x.conv_id = y.conv_id AND x.w = y.w GROUP BY 1),
p AS (SELECT conv_id, sum(n) AS n FROM x GROUP BY 1), g AS (SELECT conv_id, sum(n) AS n FROM y GROUP BY 1)
SELECT p.conv_id, round(coalesce(2.0::DOUBLE * shared / (p.n + g.n), 0), 4) AS f1 FROM p JOIN g USING (conv_id) LEFT JOIN o USING (conv_id)
""")
def _(e):
    from mnemolake.operators.evaluate import token_overlap

    t = e.turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("predicted"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("gold")).filter("predicted IS NOT NULL AND gold IS NOT NULL")
    return token_overlap(t, "conv_id").select("conv_id", F.round("f1", 4).alias("f1"))


@query("ev09_wilson", "WITH o AS (SELECT action_summary, count(*) AS n, count(*) FILTER (outcome_type = 'success') AS s FROM outcomes GROUP BY 1), c AS (SELECT *, CAST(s AS DOUBLE) / n AS p FROM o) SELECT action_summary, round(greatest(0.0::DOUBLE, (p + 1.96::DOUBLE * 1.96::DOUBLE / (2.0::DOUBLE * n)) / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n) - 1.96::DOUBLE / (1 + 1.96::DOUBLE * 1.96::DOUBLE / n) * sqrt(p * (1 - p) / n + 1.96::DOUBLE * 1.96::DOUBLE / (4.0::DOUBLE * n * n))), 4) AS low FROM c")
def _(e):
    from mnemolake.operators.evaluate import wilson

    o = e.outcomes.groupBy("action_summary").agg(F.count("*").alias("n"), F.count_if(F.col("outcome_type") == "success").alias("s"))
    return wilson(o, "s", "n").select("action_summary", F.round("low", 4).alias("low"))


@query("ev11_metric_trend", "SELECT coalesce(a.event_type, b.event_type) AS section, a.n AS baseline, b.n AS current, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) b ON a.event_type = b.event_type")
def _(e):
    from mnemolake.operators.evaluate import trend

    ev = e.table("events").withColumnRenamed("event_type", "section")
    cut = temporal.instant("2024-01-15")
    count = lambda df: df.groupBy("section").agg(F.count("*").alias("n"))
    return trend(count(ev.filter(F.col("ts") < cut)), count(ev.filter(F.col("ts") >= cut)), "section", "n")


@query("ev05_provenance", "SELECT count(*) AS claims, round(avg(CAST(id IN (SELECT claim_id FROM claim_sources) AS DOUBLE)), 4) AS coverage FROM claims")
def _(e):
    has = e.claim_sources.select(F.col("claim_id").alias("id")).distinct().withColumn("has", F.lit(1.0))
    return e.claims.join(has, "id", "left").agg(F.count("*").alias("claims"), F.round(F.avg(F.coalesce("has", F.lit(0.0))), 4).alias("coverage"))


@query("fn06_anchors")
def _(e):
    from mnemolake.functions.text import anchors_udf

    return e.table("pages").select("page_id", F.explode(anchors_udf()("html")).alias("a")).select("page_id", "a.anchor_type", "a.anchor_value")


@query("fn05_action_keys", "SELECT DISTINCT action_summary, 'act_' || substr(sha256(lower(regexp_replace(trim(action_summary), '\\s+', ' ', 'g'))), 1, 32) AS action_key FROM outcomes")
def _(e):
    key = text._udf(text.action_key, T.StringType(), 1)
    return e.outcomes.select("action_summary").distinct().withColumn("action_key", key("action_summary"))


@query("fn19_normalise", "WITH v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS x FROM vectors) SELECT id, round(list_sum(x) / sqrt(list_dot_product(x, x)), 6) AS total, round(x[1] / sqrt(list_dot_product(x, x)), 6) AS first FROM v")
def _(e):
    v = vectors.normalise(F.col("embedding"))
    total = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return e.vectors.filter(vectors.valid(F.col("embedding"), 64)).select("id", F.round(total, 6).alias("total"), F.round(v[0], 6).alias("first"))


@query("co02_clusters")
def _(e):
    return vectors.cluster(e.vectors.filter("NOT tombstoned").select("id", "label", "embedding"), ["label"], 0.3)


@query("co05_fast_path")
def _(e):
    notes = e.episodes.filter("NOT deleted").select((F.col("id") % 20).alias("cluster"), "id", F.lit("preference").alias("content_type"), "tags", F.concat(F.lit("Preference: k"), (F.col("id") % 7).cast("string"), F.lit(" = "), F.substring("content", 1, 30)).alias("content"))
    return consolidate.fast_path(notes).select("cluster", "claim_id", "position", "path_kind")


@query("co01_consolidation")
def _(e):
    notes = e.episodes.withColumn("content_type", F.lit("preference")).withColumn("content", F.concat(F.lit("Preference: k"), (F.col("id") % 7).cast("string"), F.lit(" = v")))
    return consolidate.consolidate(notes, e.vectors, ["project_slug"], "2024-03-01", config=DEFAULTS.override(cluster_similarity=0.3))["claims"].select("id", "claim_type", "canonical_text")


@query("jn20_greedy_dedup")
def _(e):
    return vectors.greedy_dedup(e.vectors.select("id", "label", "embedding"), ["label"], "id", 0.4)


@query("dm14_anchor_dedup", "SELECT DISTINCT anchor_type, anchor_value FROM anchors")
def _(e):
    rows = e.anchors.select("anchor_type", "anchor_value")
    return lifecycle.append_new(rows.limit(0), rows, ["anchor_type", "anchor_value"])


@query("ag19_dashboard", "SELECT content_type, count(*) AS n, round(avg(surprise_score), 4) AS surprise FROM episodes WHERE NOT deleted GROUP BY content_type")
def _(e):
    return e.episodes.filter("NOT deleted").groupBy("content_type").agg(F.count("*").alias("n"), F.round(F.avg("surprise_score"), 4).alias("surprise"))


@query("so10_failure_first", "SELECT project_slug, links, CAST(row_number() OVER (ORDER BY links DESC, project_slug) AS INTEGER) AS place FROM (SELECT e.project_slug, count(o.id) AS links FROM episodes e LEFT JOIN outcomes o ON o.claim_id = e.id AND o.outcome_type = 'failure' GROUP BY e.project_slug)")
def _(e):
    failed = e.outcomes.filter("outcome_type = 'failure'").groupBy(F.col("claim_id").alias("id")).agg(F.count("*").alias("n"))
    per = e.episodes.select("id", "project_slug").join(failed, "id", "left").groupBy("project_slug").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("links"))
    return per.withColumn("place", F.row_number().over(Window.orderBy(F.desc("links"), "project_slug")))  # one row per project


