"""Further queries: provenance joins, topic matching, competing hypotheses, boosts, ratios, evaluation slices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.config import DEFAULTS
from mnemolake.functions import text
from mnemolake.operators import consolidate, evaluate, keyword, lifecycle, reads, recall, temporal, trust, vectors
from mnemolake.plans.q_rank import _PRECISION, REL_SQL, _vector
from mnemolake.plans.q_reads import AS_OF, NOW, _evidence, secs
from mnemolake.registry import query

_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


@query("jn07_first_challenge_join", "SELECT c.id, CAST(epoch(f.at) AS BIGINT) AS first_challenged FROM claims c LEFT JOIN (SELECT claim_id, min(created_at) AS at FROM claim_events WHERE event_type = 'challenged' GROUP BY claim_id) f ON f.claim_id = c.id")
def _(e):
    return e.claims.select("id").join(temporal.first_challenges(e.claim_events), "id", "left").select("id", secs("first_challenged"))


@query("jn14_outcome_anchors", "SELECT o.claim_id, count(DISTINCT a.anchor_value) AS outcome_anchor_count FROM outcomes o JOIN claim_sources s ON s.claim_id = o.claim_id JOIN anchors a ON a.episode_id = s.source_episode_id GROUP BY o.claim_id")
def _(e):
    held = e.claim_sources.select("claim_id", F.col("source_episode_id").alias("episode_id")).join(e.anchors.select("episode_id", "anchor_value"), "episode_id").select("claim_id", "anchor_value").distinct()
    return held.join(e.outcomes.select("claim_id").distinct(), "claim_id", "left_semi").groupBy("claim_id").agg(F.count("*").alias("outcome_anchor_count"))


@query("jn19_ingest_near_duplicates", f"WITH s AS (SELECT n.id, o.id AS b, {_DOT.format('n.embedding', 'o.embedding')} AS s FROM vectors n JOIN vectors o ON n.label = o.label AND n.id % 10 = 0 AND o.id % 10 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, b) AS k FROM s WHERE s >= 0.3) SELECT id, b AS duplicate_of FROM r WHERE k = 1")
def _(e):
    return vectors.nearest_duplicates(e.vectors.filter("id % 10 = 0"), e.vectors.filter("id % 10 <> 0"), 0.3, ["label"])


@query("jn21_scope_isolated_pairs", f"SELECT a.label, count(*) AS n FROM vectors a JOIN vectors b ON a.label = b.label AND a.id < b.id WHERE {_DOT.format('a.embedding', 'b.embedding')} >= 0.25 GROUP BY a.label")
def _(e):
    return vectors.similar_pair_counts(e.vectors, ["label"], 0.25)


@query("jn24_topic_match", f"""
WITH n AS (SELECT v.id, t.title, v.embedding FROM vectors v JOIN topics t ON t.id = v.id WHERE v.id % 2 = 0), o AS (SELECT v.id AS topic_id, t.title, v.embedding FROM vectors v JOIN topics t ON t.id = v.id WHERE v.id % 2 = 1),
s AS (SELECT n.id, topic_id, {_DOT.format('n.embedding', 'o.embedding')} AS s,
  len(list_intersect(list_distinct(regexp_extract_all(lower(n.title), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(o.title), '[a-z0-9]+')))) / least(len(list_distinct(regexp_extract_all(lower(n.title), '[a-z0-9]+'))), len(list_distinct(regexp_extract_all(lower(o.title), '[a-z0-9]+')))) AS overlap FROM n, o),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, topic_id DESC) AS k FROM s), w AS (SELECT id, min(CASE WHEN overlap > 0.5 THEN topic_id END) AS by_words FROM s GROUP BY id)
SELECT n.id, CASE WHEN b.s >= 0.1 THEN CASE WHEN b.overlap >= 0.34 OR b.s >= 0.9 THEN b.topic_id END ELSE w.by_words END AS topic_id FROM n LEFT JOIN b ON b.id = n.id AND k = 1 LEFT JOIN w ON w.id = n.id
""")
def _(e):
    from mnemolake.config import DEFAULTS

    rows = e.vectors.select("id", "embedding").join(e.topics.select("id", "title"), "id").withColumn("all", F.lit(1))
    return consolidate.match_topics(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["all"], DEFAULTS.override(topic_similarity=0.1)).select("id", "topic_id")


@query("jn31_competing_hypotheses", "WITH top AS (SELECT id FROM claims WHERE status = 'active' ORDER BY confidence DESC, id LIMIT 50), b AS (SELECT from_claim_id AS id, to_claim_id AS partner FROM claim_edges UNION SELECT to_claim_id, from_claim_id FROM claim_edges) SELECT DISTINCT c.id, c.status FROM b JOIN top ON top.id = b.id JOIN claims c ON c.id = b.partner WHERE b.id <> b.partner AND c.status IN ('expired', 'challenged') AND c.id NOT IN (SELECT id FROM top)")
def _(e):
    top = e.claims.filter("status = 'active'").orderBy(F.desc("confidence"), "id").limit(50).select("id")
    ids = recall.partners(e.claim_edges, e.claims, top).select(F.col("partner").alias("id")).distinct().join(top, "id", "left_anti")
    return e.claims.join(ids, "id", "left_semi").select("id", "status")


@query("jn34_entity_context", "SELECT 'episode' AS kind, count(DISTINCT episode_id) AS n FROM anchors WHERE anchor_value = 'src/en/src1.py' UNION ALL SELECT 'claim', count(DISTINCT s.claim_id) FROM claim_sources s JOIN anchors a ON a.episode_id = s.source_episode_id WHERE a.anchor_value = 'src/en/src1.py' UNION ALL SELECT 'record', count(*) FROM records WHERE contains(lower(embedding_text), 'src1')")
def _(e):
    held = e.anchors.filter("anchor_value = 'src/en/src1.py'").select("episode_id").distinct()
    a = held.agg(F.lit("episode").alias("kind"), F.count("*").alias("n"))
    b = e.claim_sources.join(held.select(F.col("episode_id").alias("source_episode_id")), "source_episode_id", "left_semi").agg(F.lit("claim").alias("kind"), F.count_distinct("claim_id").alias("n"))
    c = e.records.filter(F.contains(F.lower("embedding_text"), F.lit("src1"))).agg(F.lit("record").alias("kind"), F.count("*").alias("n"))
    return a.unionByName(b).unionByName(c)


@query("ag10_protected_and_records", "SELECT (SELECT count(*) FROM episodes WHERE protected AND NOT deleted) AS protected, (SELECT count(*) FROM records WHERE NOT deleted) AS records")
def _(e):
    a = e.episodes.filter("protected AND NOT deleted").agg(F.count("*").alias("protected"))
    return a.crossJoin(e.records.filter("NOT deleted").agg(F.count("*").alias("records")))  # one row each


@query("ag23_unique_claims", "SELECT canonical_text, min(id) AS id FROM claims GROUP BY canonical_text")
def _(e):
    return e.claims.groupBy("canonical_text").agg(F.min("id").alias("id"))


@query("ag25_consistency_ratio", "SELECT round(avg(CAST(n > 0 AS DOUBLE)), 4) AS ratio, avg(CAST(n > 0 AS DOUBLE)) >= 0.995 AS consistent FROM (SELECT t.id, count(r.id) AS n FROM topics t LEFT JOIN records r ON r.topic_id = t.id AND NOT r.deleted GROUP BY t.id)")
def _(e):
    n = e.records.filter("NOT deleted").groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("n"))
    ok = e.topics.select("id").join(n, "id", "left").agg(F.avg(F.coalesce(F.col("n") > 0, F.lit(False)).cast("double")).alias("r"))
    return ok.select(F.round("r", 4).alias("ratio"), (F.col("r") >= 0.995).alias("consistent"))


@query("ag26_specifics_kept", "WITH p AS (SELECT conv_id, max(text) FILTER (turn = 0) AS a, max(text) FILTER (turn = 1) AS b FROM turns GROUP BY conv_id), x AS (SELECT conv_id, list_distinct(regexp_extract_all(a, '[A-Za-z0-9]{8,}')) AS terms, b FROM p WHERE a IS NOT NULL AND b IS NOT NULL) SELECT conv_id, CASE WHEN len(terms) = 0 THEN 1.0 ELSE round(len(list_filter(terms, lambda t: contains(b, t))) / len(terms), 4) END::DOUBLE AS kept FROM x")
def _(e):
    t = e.turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    terms = F.array_distinct(F.regexp_extract_all("a", F.lit("[A-Za-z0-9]{8,}"), F.lit(0)))
    kept = F.size(F.filter(terms, lambda x: F.contains(F.col("b"), x))) / F.size(terms)
    return t.select("conv_id", F.when(F.size(terms) == 0, 1.0).otherwise(F.round(kept, 4)).alias("kept"))


@query("wn02_recent_runs", "SELECT id, CAST(epoch(started_at) AS BIGINT) AS started_at FROM runs ORDER BY runs.started_at DESC, id LIMIT 5")
def _(e):
    return reads.newest(e.runs, "started_at", 5).select("id", secs("started_at"))


@query("se01_union_distinct", "SELECT source_episode_id AS id FROM claim_sources WHERE source_episode_id IS NOT NULL UNION SELECT episode_id FROM anchors")
def _(e):
    return e.claim_sources.filter("source_episode_id IS NOT NULL").select(F.col("source_episode_id").alias("id")).union(e.anchors.select(F.col("episode_id").alias("id"))).distinct()


@query("se04_set_difference", "SELECT episode_id AS id FROM anchors EXCEPT SELECT id FROM episodes WHERE deleted")
def _(e):
    return e.anchors.select(F.col("episode_id").alias("id")).distinct().join(e.episodes.filter("deleted").select("id"), "id", "left_anti")


@query("se06_tag_union", "SELECT project_slug, list_sort(list_distinct(flatten(list(list_transform(tags, lambda t: lower(t)))))) AS tags FROM episodes GROUP BY project_slug")
def _(e):
    return e.episodes.select("project_slug", F.explode("tags").alias("t")).groupBy("project_slug").agg(F.array_sort(F.collect_set(F.lower("t"))).alias("tags"))


@query("rk11_cooccurrence_boost", """
WITH c AS (SELECT id, tags, surprise_score AS score FROM episodes WHERE id < 60), t AS (SELECT DISTINCT unnest(tags) AS tag FROM c),
x AS (SELECT id, unnest(list_distinct(tags)) AS tag FROM episodes), pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS n FROM x a JOIN x b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2),
linked AS (SELECT tag_a AS tag FROM pairs WHERE n >= 40 AND tag_a IN (SELECT tag FROM t) AND tag_b IN (SELECT tag FROM t) UNION SELECT tag_b FROM pairs WHERE n >= 40 AND tag_a IN (SELECT tag FROM t) AND tag_b IN (SELECT tag FROM t))
SELECT id, round(CASE WHEN list_has_any(tags, (SELECT coalesce(list(tag), []) FROM linked)) THEN score * 1.1::DOUBLE ELSE score END, 6) AS score FROM c
""")
def _(e):
    from mnemolake.config import DEFAULTS

    c = e.episodes.filter("id < 60").withColumn("score", F.col("surprise_score"))
    return recall.cooccurrence_boost(c, reads.tag_pairs(e.episodes), DEFAULTS.override(cooccurrence_min_count=40)).select("id", F.round("score", 6).alias("score"))


@query("rk18_claim_browse", f"{REL_SQL}, {_PRECISION} SELECT id, reliability, validation_count FROM prec WHERE claim_type = 'strategy' ORDER BY updated_at DESC, id LIMIT 50")
def _(e):
    rows = trust.with_reuse(trust.with_reliability(_evidence(e), NOW), NOW)
    return rows.filter("claim_type = 'strategy'").orderBy(F.desc("updated_at"), "id").limit(50).select("id", "reliability", "validation_count")


@query("rk20_claim_texts", "SELECT id, canonical_text || ' ' || 'status ' || status || ' type ' || claim_type AS text FROM claims")
def _(e):
    payload = F.map_from_arrays(F.array(F.lit("type"), F.lit("status")), F.array("claim_type", "status"))
    return e.claims.select("id", F.concat_ws(" ", "canonical_text", F.array_join(F.transform(F.array_sort(F.map_entries(payload)), lambda p: F.concat_ws(" ", p["key"], p["value"])), " ")).alias("text"))


@query("rk21_competing_rank", f"{REL_SQL}, {_PRECISION} SELECT id, round(prec * 0.65::DOUBLE, 6) AS precision FROM prec WHERE status IN ('expired', 'challenged') AND prec * 0.65::DOUBLE >= 0.05")
def _(e):
    p = trust.precision() * 0.65
    return _evidence(e).filter(F.col("status").isin("expired", "challenged")).select("id", p.alias("p")).filter("p >= 0.05").select("id", F.round("p", 6).alias("precision"))


@query("rk27_timeline", f"""
WITH v AS (SELECT id, {_DOT.format('embedding', '(SELECT embedding FROM vectors WHERE id = 7)')} AS s FROM vectors)
SELECT r.id, CASE WHEN r.valid_until IS NOT NULL AND r.valid_until <= TIMESTAMP '2024-02-20' THEN 'superseded' ELSE 'active' END AS state FROM records r JOIN v ON v.id = r.id WHERE v.s >= 0.1
""")
def _(e):
    sims = e.vectors.select("id", vectors.dot(F.col("embedding"), vectors.literal(_vector(e))).alias("similarity"))
    none = e.records.limit(0).select("id", F.col("id").alias("superseded_by"))
    return recall.timeline(e.records, sims, none, "2024-02-20", 0.1).select("id", "state")


@query("fn15_title_tokens", "SELECT id, list_sort(list_filter(list_distinct(regexp_extract_all(lower(title || ' of the A-1 and b'), '[a-z0-9]+')), lambda w: w NOT IN ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'of', 'on', 'or', 'the', 'to', 'with'))) AS tokens FROM topics")
def _(e):
    tokens = text._udf(lambda t: sorted(text.title_tokens(t)), T.ArrayType(T.StringType()), 1)
    return e.topics.select("id", tokens(F.concat("title", F.lit(" of the A-1 and b"))).alias("tokens"))


@query("fn20_path_variants", "SELECT DISTINCT anchor_value AS path, [anchor_value, './' || anchor_value, replace(anchor_value, '/', '\\'), '.\\' || replace(anchor_value, '/', '\\'), '/r/' || anchor_value, replace('/r/' || anchor_value, '/', '\\')] AS variants FROM anchors")
def _(e):
    return e.anchors.select(F.col("anchor_value").alias("path")).distinct().select("path", lifecycle.path_variants(F.col("path"), "/r").alias("variants"))


@query("fn22_date_labels", "SELECT id, strftime(created_at, '%b %d') AS label FROM episodes")
def _(e):
    return e.episodes.select("id", F.date_format("created_at", "MMM dd").alias("label"))


@query("fn17_json_lists", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def _(e):
    return e.table("events").select(F.col("event_id").alias("id"), F.element_at(F.from_json("props", "map<string,string>"), "k").alias("k"))


@query("ev06_lag_percentiles", "WITH f AS (SELECT claim_id, epoch(min(created_at)) AS at FROM claim_events WHERE event_type = 'challenged' GROUP BY claim_id), l AS (SELECT CAST(f.at - epoch(c.valid_from) AS BIGINT) AS lag FROM f JOIN claims c ON c.id = f.claim_id) SELECT lag AS value FROM l ORDER BY lag LIMIT 1 OFFSET (SELECT CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) FROM l)")
def _(e):
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    lag = temporal.first_challenges(e.claim_events).join(e.claims.select("id", "valid_from"), "id").select((at("first_challenged") - at("valid_from")).alias("lag"))
    return reads.nearest_rank(lag, "lag", 0.95)


@query("ev03_challenged_suppression", "SELECT count(*) AS challenged, count(*) FILTER (a.id IS NULL) AS suppressed FROM (SELECT id FROM claims WHERE status = 'challenged') c LEFT JOIN (SELECT id FROM claims WHERE status = 'active' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1998-06-01') AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-06-01')) a ON a.id = c.id")
def _(e):
    live = temporal.active_claims(e.claims, AS_OF).select("id", F.lit(True).alias("live"))
    return e.claims.filter("status = 'challenged'").select("id").join(live, "id", "left").agg(F.count("*").alias("challenged"), F.count_if(F.col("live").isNull()).alias("suppressed"))


@query("dm03_counters", "SELECT id, access_count + CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS access_count FROM episodes")
def _(e):
    log = e.episodes.filter("id % 4 = 0").select("id")
    return lifecycle.fold_access(e.episodes, log.unionByName(log)).select("id", "access_count")


@query("dm04_mark_consolidated", "SELECT consolidated, count(*) AS n FROM (SELECT CASE WHEN id % 9 = 0 THEN 1 ELSE consolidated END AS consolidated FROM episodes) GROUP BY consolidated")
def _(e):
    return lifecycle.update(e.episodes, e.episodes.filter("id % 9 = 0").select("id"), {"consolidated": F.lit(1)}).groupBy("consolidated").agg(F.count("*").alias("n"))


@query("dm11_expire_unsourced", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN id NOT IN (SELECT claim_id FROM claim_sources) THEN 'expired' ELSE status END AS status FROM claims) GROUP BY status")
def _(e):
    return lifecycle.expire_unsourced(e.claims, e.claim_sources, AS_OF)[0].groupBy("status").agg(F.count("*").alias("n"))


@query("co14_attempt_reset", "SELECT id, CASE WHEN consolidation_attempts >= 5 AND updated_at <= TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR THEN 0 ELSE consolidation_attempts END AS attempts FROM episodes")
def _(e):
    return lifecycle.reset_attempts(e.episodes, NOW).select("id", F.col("consolidation_attempts").alias("attempts"))


@query("co13_prune", "SELECT count(*) AS vectors FROM vectors WHERE id NOT IN (SELECT id FROM episodes WHERE NOT deleted AND NOT protected AND consolidated = 1 AND consolidated_at < TIMESTAMP '2024-01-30' - INTERVAL 10 DAY)")
def _(e):
    return consolidate.prune(e.episodes, e.vectors, "2024-01-30", 10)[1].agg(F.count("*").alias("vectors"))


@query("co10_contradictions", f"""
WITH p AS (SELECT a.label, a.id AS a, b.id AS b, {_DOT.format('a.embedding', 'b.embedding')} AS s FROM vectors a JOIN vectors b ON a.label = b.label WHERE a.id % 2 = 0 AND b.id % 2 = 1), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, a, b) AS k FROM p WHERE s >= 0.3)
SELECT DISTINCT r.b AS id FROM r JOIN records x ON x.id = r.a JOIN records y ON y.id = r.b WHERE k <= 24 AND x.embedding_text <> y.embedding_text
""")
def _(e):
    rows = e.vectors.select("id", F.col("label").alias("topic_id"), "embedding")
    return consolidate.contradicted(rows.filter("id % 2 = 1"), rows.filter("id % 2 = 0"), NOW, DEFAULTS.override(contradiction_similarity=0.3), e.records)["expired"]


@query("st03_failure_rates", "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, observed_at)) AS BIGINT) AS start, round(avg(CAST(outcome_type IN ('failure', 'reverted', 'superseded') AS DOUBLE)), 6) AS rate FROM outcomes GROUP BY 1")
def _(e):
    bad = F.col("outcome_type").isin("failure", "reverted", "superseded").cast("double")
    return e.outcomes.groupBy(F.window("observed_at", "1 day").alias("w")).agg(F.round(F.avg(bad), 6).alias("rate")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "rate")


@query("so08_claim_search_order", "SELECT id, share FROM (SELECT id, (CAST(contains(lower(canonical_text), 'urgent') AS INT) + CAST(contains(lower(canonical_text), '12') AS INT)) / 2.0::DOUBLE AS share, updated_at FROM claims) ORDER BY share DESC, updated_at DESC, id LIMIT 25")
def _(e):
    return e.claims.withColumn("share", keyword.share_of_words("urgent 12", F.col("canonical_text"))).orderBy(F.desc("share"), F.desc("updated_at"), "id").limit(25).select("id", "share")


@query("so07_per_section_top", "SELECT record_type, id, k FROM (SELECT record_type, id, CAST(row_number() OVER (PARTITION BY record_type ORDER BY confidence DESC, id) AS INTEGER) AS k FROM records) WHERE k <= 15")
def _(e):
    w = Window.partitionBy("record_type").orderBy(F.desc("confidence"), "id")
    return e.records.select("record_type", "id", F.row_number().over(w).alias("k")).filter("k <= 15")


_CLAIM_PLACES = """
p AS (SELECT c.id, c.status, o.o_custkey AS query_id, row_number() OVER (PARTITION BY o.o_custkey ORDER BY round(c.confidence * c.precision_, 6) DESC, c.id) AS rank,
  row_number() OVER (PARTITION BY o.o_custkey ORDER BY c.updated_at DESC, c.id) AS age FROM claims c JOIN orders o ON o.o_orderkey = c.id)
"""


def _claim_places(e):
    """Each customer's claims by confidence times precision: (query_id, id, status, updated_at, rank)."""
    rows = e.claims.join(e.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("query_id")), "id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col("confidence") * F.col("precision_"), 6)), "id")))


@query("ev02_claim_recall", f"WITH {_CLAIM_PLACES} SELECT count(*) AS queries, round(avg(CAST(rank <= 5 AS DOUBLE)), 6) AS recall FROM p WHERE age = 1")
def _(e):
    # Wanted is the claim of each customer that was changed last.
    rows = _claim_places(e)
    wanted = rows.groupBy("query_id").agg(F.max_by("id", F.struct("updated_at", -F.col("id"))).alias("want"))
    return evaluate.recall_at(rows, wanted, 5, "id").select("queries", F.round("recall", 6).alias("recall"))


@query("ev07_sections", f"""
WITH {_CLAIM_PLACES},
s AS (SELECT query_id, bool_or(rank <= 5) AS leak FROM p WHERE status = 'expired' GROUP BY query_id),
e AS (SELECT DISTINCT least(from_claim_id, to_claim_id) AS lo, greatest(from_claim_id, to_claim_id) AS hi FROM claim_edges WHERE from_claim_id <> to_claim_id),
v AS (SELECT coalesce(a.status IN ('expired', 'challenged'), false) OR coalesce(b.status IN ('expired', 'challenged'), false) AS seen FROM e LEFT JOIN claims a ON a.id = e.lo LEFT JOIN claims b ON b.id = e.hi),
w AS (SELECT claim_id, avg(confidence) FILTER (outcome_type = 'success') AS good, avg(confidence) FILTER (outcome_type = 'failure') AS bad FROM outcomes GROUP BY claim_id)
SELECT 'stale_suppression' AS section, count(*) AS cases, round(avg(CAST(NOT leak AS DOUBLE)), 6) AS rate FROM s
UNION ALL SELECT 'contradiction_visibility', count(*), round(avg(CAST(seen AS DOUBLE)), 6) FROM v
UNION ALL SELECT 'outcome_ranking', count(*), round(avg(CAST(good > bad AS DOUBLE)), 6) FROM w WHERE good IS NOT NULL AND bad IS NOT NULL
""")
def _(e):
    rows = _claim_places(e)
    stale = evaluate.suppressed(rows, rows.filter("status = 'expired'"))
    ends = e.claim_edges.select(F.explode(F.array("from_claim_id", "to_claim_id")).alias("id")).distinct()
    seen = evaluate.visible(e.claim_edges.select(F.col("from_claim_id").alias("a"), F.col("to_claim_id").alias("b")), recall.partners(e.claim_edges, e.claims, ends))
    mean = lambda kind: F.avg(F.when(F.col("outcome_type") == kind, F.col("confidence")))
    won = evaluate.wins(e.outcomes.groupBy("claim_id").agg(mean("success").alias("good"), mean("failure").alias("bad")))
    named = [df.select(F.lit(n).alias("section"), "cases", F.round("rate", 6).alias("rate")) for n, df in (("stale_suppression", stale), ("contradiction_visibility", seen), ("outcome_ranking", won))]
    return named[0].unionByName(named[1]).unionByName(named[2])
