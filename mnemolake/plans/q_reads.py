"""Queries of scans, filters, joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.functions import text
from mnemolake.operators import evidence, lifecycle, reads, recall, scope, temporal
from mnemolake.registry import query
from mnemolake.sources import markdown

NOW, AS_OF, EVENTS_AT = "2024-01-20 00:00:00", "1998-06-01 00:00:00", "2024-01-20 00:00:00"


def secs(c: str):
    return F.unix_seconds(F.col(c).cast("timestamp")).alias(c)


@query("sc03_episode_scan", "SELECT id, content_type, CAST(epoch(created_at) AS BIGINT) AS created_at FROM episodes WHERE NOT deleted AND project_slug = 'en'")
def _(e):
    return e.episodes.filter("NOT deleted").filter(scope.equality({"project_slug": "en"})).orderBy("created_at").select("id", "content_type", secs("created_at"))


@query("sc04_active_episodes", "SELECT id, consolidated FROM episodes WHERE NOT deleted AND consolidated <> 2")
def _(e):
    return reads.active_episodes(e.episodes).select("id", "consolidated")


@query("sc05_point_lookup", "SELECT id, content_type, surprise_score FROM episodes WHERE id = 25 AND NOT deleted AND indexed")
def _(e):
    return reads.visible(e.episodes).filter("id = 25").select("id", "content_type", "surprise_score")


@query("sc06_batch_lookup", "SELECT id, status, confidence FROM claims WHERE id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(e):
    ids = e.table("customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return reads.by_ids(e.claims, ids).select("id", "status", "confidence")


@query("sc07_missing_ids", "SELECT DISTINCT s.source_episode_id AS id FROM claim_sources s WHERE s.source_episode_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM episodes e WHERE e.id = s.source_episode_id)")
def _(e):
    ids = e.claim_sources.filter("source_episode_id IS NOT NULL").select(F.col("source_episode_id").alias("id"))
    return reads.by_ids(e.episodes, ids, missing=True)


@query("sc08_unindexed_oldest", "SELECT id, CAST(epoch(created_at) AS BIGINT) AS created_at FROM episodes WHERE NOT indexed AND NOT deleted ORDER BY episodes.created_at, id LIMIT 50")
def _(e):
    return e.episodes.filter("NOT indexed AND NOT deleted").orderBy("created_at", "id").limit(50).select("id", secs("created_at"))


@query("sc09_topics_by_name", "SELECT id, title, confidence FROM topics WHERE filename = 'Supplier#000000003.md' OR title = 'Supplier#000000005'")
def _(e):
    return e.topics.filter("filename = 'Supplier#000000003.md' OR title = 'Supplier#000000005'").select("id", "title", "confidence")


@query("sc10_records_with_topics", "SELECT r.id, r.record_type, t.title AS topic_title FROM records r JOIN topics t ON t.id = r.topic_id WHERE NOT r.deleted AND (r.valid_from IS NULL OR r.valid_from <= TIMESTAMP '2024-01-20') AND (r.valid_until IS NULL OR r.valid_until > TIMESTAMP '2024-01-20')")
def _(e):
    return reads.records_with_topics(e.records, e.topics, NOW).select("id", "record_type", "topic_title")


@query("sc11_export_edges", "SELECT from_claim_id, to_claim_id FROM claim_edges WHERE from_claim_id IN (SELECT id FROM claims WHERE status = 'challenged') OR to_claim_id IN (SELECT id FROM claims WHERE status = 'challenged')")
def _(e):
    ids = e.claims.filter("status = 'challenged'").select("id")
    marked = e.claim_edges.join(ids.select(F.col("id").alias("from_claim_id"), F.lit(True).alias("f")), "from_claim_id", "left").join(ids.select(F.col("id").alias("to_claim_id"), F.lit(True).alias("t")), "to_claim_id", "left")
    return marked.filter("f OR t").select("from_claim_id", "to_claim_id")


@query("sc17_version_as_of", "SELECT p_brand AS topic_id, arg_min(p_name, (p_size, p_name)) AS title FROM part WHERE p_size > 20 GROUP BY p_brand")
def _(e):
    # A brand's parts are its versions, superseded one second for each unit of size.
    rows = e.table("part").groupBy("p_brand", "p_size").agg(F.min("p_name").alias("title"))
    versions = rows.select(F.col("p_brand").alias("topic_id"), F.timestamp_seconds("p_size").alias("superseded_at"), "title", F.lit("").alias("summary"), F.lit("").alias("content"))
    return markdown.version_as_of(versions, F.timestamp_seconds(F.lit(20))).select("topic_id", "title")


@query("sc28_dashboard_episodes", "SELECT id, content_type, CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || '…' ELSE content END AS preview FROM episodes WHERE NOT deleted")
def _(e):
    return e.episodes.filter("NOT deleted").select("id", "content_type", reads.preview(F.col("content"), 80).alias("preview"))


@query("sc29_conversation_ingest", "SELECT conv_id, turn, concat('[', CAST(conv_id AS VARCHAR), '] ', role, ': ', text) AS content FROM turns WHERE text IS NOT NULL AND role IS NOT NULL")
def _(e):
    from mnemolake.sources.conversations import turns_to_episodes

    return turns_to_episodes(e.turns)


@query("fp01_scope_equality", "SELECT id FROM episodes WHERE namespace_slug = 'default' AND project_slug = 'fr' AND app_client_name = 'src1'")
def _(e):
    return e.episodes.filter(scope.equality({"namespace_slug": "default", "project_slug": "fr", "app_client_name": "src1", "agent_name": None})).select("id")


@query("fp02_exact_scope", "SELECT id FROM policies WHERE namespace_slug = 'default' AND project_slug IS NULL")
def _(e):
    return e.policies.filter(scope.exact({"namespace_slug": "default"}, ["namespace_slug", "project_slug"])).select("id")


@query("fp04_scope_defaults", "SELECT id, coalesce(nullif(trim(namespace_slug), ''), 'default') AS namespace_slug, coalesce(nullif(trim(project_slug), ''), 'default') AS project_slug, 'legacy_client' AS app_client_name FROM policies")
def _(e):
    return scope.with_defaults(e.policies).select("id", "namespace_slug", "project_slug", "app_client_name")


@query("fp05_read_visibility", "SELECT id FROM episodes WHERE namespace_slug = 'default' AND project_slug = 'de'")
def _(e):
    return e.episodes.filter(scope.equality(scope.Scope(project_slug="de", read_visibility="project").read_filter())).select("id")


@query("fp06_mutation_filter", "SELECT id FROM episodes WHERE namespace_slug = 'default' AND project_slug = 'de' AND app_client_name = 'src2'")
def _(e):
    wanted = {k: v for k, v in scope.Scope(project_slug="de", app_client_name="src2", read_visibility="namespace").mutation_filter().items() if k in e.episodes.columns}
    return e.episodes.filter(scope.equality(wanted)).select("id")


@query("fp07_active_claims", "SELECT id, claim_type FROM claims WHERE status = 'active' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1998-06-01') AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-06-01')")
def _(e):
    return temporal.active_claims(e.claims, AS_OF).select("id", "claim_type")


@query("fp08_records_as_of", "SELECT id, record_type FROM records WHERE NOT deleted AND created_at <= TIMESTAMP '2024-02-10' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-02-10') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-02-10')")
def _(e):
    return temporal.records_as_of(e.records, "2024-02-10").select("id", "record_type")


_AS_OF_SQL = """
WITH first AS (SELECT claim_id, min(created_at) AS at FROM claim_events WHERE event_type = 'challenged' GROUP BY claim_id)
SELECT c.id, c.claim_type, CASE WHEN c.status = 'active' THEN 'active' WHEN f.at IS NOT NULL AND f.at <= TIMESTAMP '1998-06-01' THEN 'challenged' ELSE 'active' END AS status
FROM claims c LEFT JOIN first f ON f.claim_id = c.id
WHERE c.created_at <= TIMESTAMP '1998-06-01' AND (c.valid_from IS NULL OR c.valid_from <= TIMESTAMP '1998-06-01') AND (c.valid_until IS NULL OR c.valid_until > TIMESTAMP '1998-06-01')
"""


@query("fp09_claims_as_of", _AS_OF_SQL)
def _(e):
    return temporal.claims_as_of(e.claims, e.claim_events, AS_OF).select("id", "claim_type", "status")


@query("so01_claims_as_of_newest", _AS_OF_SQL.strip() + " ORDER BY c.updated_at DESC, c.id LIMIT 40")
def _(e):
    return temporal.claims_as_of(e.claims, e.claim_events, AS_OF).orderBy(F.desc("updated_at"), "id").limit(40).select("id", "claim_type", "status")


@query("fp10_next_validity_change", "SELECT CAST(epoch(min(least(CASE WHEN valid_from > TIMESTAMP '2024-01-20' THEN valid_from END, CASE WHEN valid_until > TIMESTAMP '2024-01-20' THEN valid_until END))) AS BIGINT) AS next_change FROM records WHERE NOT deleted")
def _(e):
    return temporal.next_change(e.records, NOW).select(secs("next_change"))


@query("fp12_episode_search", "SELECT id, content_type FROM episodes WHERE NOT deleted AND contains(lower(content), 'license') AND content_type IN ('fact', 'solution') AND list_has_any(tags, ['en', 'de']) AND created_at > TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-28' ORDER BY created_at DESC, id LIMIT 20")
def _(e):
    return reads.search_episodes(e.episodes, "License", ["fact", "solution"], ["en", "de"], "2024-01-03", "2024-01-28").select("id", "content_type")


@query("fp13_recall_filters", "SELECT id FROM episodes WHERE NOT deleted AND indexed AND content_type IN ('fact') AND list_has_any(tags, ['k3', 'fr']) AND created_at >= TIMESTAMP '2024-01-02' AND created_at <= TIMESTAMP '2024-01-25' AND created_at <= TIMESTAMP '2024-01-20'")
def _(e):
    q = recall.RecallQuery("x", NOW, content_types=("fact",), tags=("k3", "fr"), after="2024-01-02", before="2024-01-25", as_of="2024-01-20")
    return recall.filtered(e.episodes, q).select("id")


@query("fp14_tag_lookup", "SELECT id FROM episodes WHERE list_contains(tags, 'k5')")
def _(e):
    return e.episodes.filter(F.array_contains("tags", "k5")).select("id")


@query("fp15_json_path", "SELECT id FROM outcomes WHERE lower(json_extract_string(provenance, '$.k')) = '69' OR contains(lower(action_summary), 'purchase')")
def _(e):
    return e.outcomes.filter((F.lower(F.get_json_object("provenance", "$.k")) == "69") | F.contains(F.lower("action_summary"), F.lit("purchase"))).select("id")


@query("fp16_entity_anchors", "SELECT DISTINCT episode_id AS id FROM anchors WHERE (anchor_type = 'path' AND anchor_value = 'src/en/src2.py') OR anchor_value LIKE '%/src6.py'")
def _(e):
    return e.anchors.filter("(anchor_type = 'path' AND anchor_value = 'src/en/src2.py')").unionByName(e.anchors.filter(F.endswith("anchor_value", F.lit("/src6.py")))).select(F.col("episode_id").alias("id")).distinct()


@query("fp17_unconsolidated", "SELECT id, priority FROM (SELECT e.id, CASE WHEN e.id IN (SELECT claim_id FROM outcomes WHERE outcome_type = 'failure') THEN 0 ELSE 1 END AS priority, e.created_at FROM episodes e WHERE NOT deleted AND indexed AND consolidated = 0 AND consolidation_attempts < 5) ORDER BY priority, created_at DESC, id LIMIT 100")
def _(e):
    failed = e.outcomes.filter("outcome_type = 'failure'").select(F.col("claim_id").alias("id"))
    return reads.unconsolidated(e.episodes, failed, limit=100).select("id", "priority")


@query("fp18_prunable", "SELECT id FROM episodes WHERE NOT deleted AND NOT protected AND consolidated = 1 AND consolidated_at < TIMESTAMP '2024-01-30' - INTERVAL 10 DAY")
def _(e):
    return reads.prunable(e.episodes, "2024-01-30", 10).select("id")


@query("fp19_low_confidence", "SELECT r.id, r.confidence FROM records r JOIN topics t ON t.id = r.topic_id WHERE NOT r.deleted AND (r.valid_from IS NULL OR r.valid_from <= TIMESTAMP '2024-01-20') AND (r.valid_until IS NULL OR r.valid_until > TIMESTAMP '2024-01-20') AND r.confidence < 0.5")
def _(e):
    return reads.low_confidence(e.records, e.topics, NOW).select("id", "confidence")


@query("fp20_hygiene_buckets", "SELECT CASE WHEN content_type = 'exchange' THEN 'exchange' WHEN content_type = 'solution' AND trim(content) = '' THEN 'noise_journal' END AS bucket, count(*) AS n FROM episodes WHERE NOT deleted GROUP BY 1")
def _(e):
    return lifecycle.hygiene_buckets(e.episodes).groupBy("bucket").agg(F.count("*").alias("n"))


@query("fp22_previews", "SELECT id, CASE WHEN length(content) > 120 THEN substr(content, 1, 120) || '…' ELSE content END AS preview FROM episodes WHERE id < 500")
def _(e):
    return e.episodes.filter("id < 500").select("id", reads.preview(F.col("content"), 120).alias("preview"))


@query("fp24_provenance_present", "SELECT id FROM outcomes WHERE provenance IS NOT NULL AND trim(provenance) NOT IN ('', '{}', 'null')")
def _(e):
    return e.outcomes.filter("provenance IS NOT NULL AND trim(provenance) NOT IN ('', '{}', 'null')").select("id")


@query("fp26_meta_descriptive", r"""
WITH t AS (SELECT id, (CASE id % 5 WHEN 0 THEN 'Discusses ' WHEN 1 THEN '  This document ' WHEN 2 THEN 'Detailsx ' ELSE '' END) || coalesce(content, '') AS content FROM episodes)
SELECT id FROM t WHERE trim(content) = '' OR regexp_matches(lower(trim(content)), '^(discusses|covers|related to|describes|details|provides|mentions|this document|an overview|information about)\b')
""")
def _(e):
    opener = F.expr("CASE id % 5 WHEN 0 THEN 'Discusses ' WHEN 1 THEN '  This document ' WHEN 2 THEN 'Detailsx ' ELSE '' END")
    rows = e.episodes.select("id", F.concat(opener, F.coalesce("content", F.lit(""))).alias("content"))
    return rows.filter(text._udf(text.meta_descriptive, T.BooleanType(), 1)("content")).select("id")


@query("fp28_content_types", "SELECT content_type, count(*) AS n FROM episodes WHERE content_type IN ('exchange', 'fact', 'solution', 'preference', 'procedure') GROUP BY content_type")
def _(e):
    return e.episodes.filter(F.col("content_type").isin("exchange", "fact", "solution", "preference", "procedure")).groupBy("content_type").agg(F.count("*").alias("n"))


@query("jn02_contradictions", "SELECT c.id, c.resolution, t.title FROM contradictions c LEFT JOIN topics t ON t.id = c.topic_id ORDER BY c.detected_at DESC, c.id LIMIT 30")
def _(e):
    return reads.contradictions(e.contradictions, e.topics, limit=30).select("id", "resolution", "title")


@query("jn03_claims_by_anchor", "SELECT DISTINCT c.id, c.status FROM claims c JOIN claim_sources s ON s.claim_id = c.id JOIN anchors a ON a.episode_id = s.source_episode_id WHERE a.anchor_type = 'path' AND a.anchor_value = 'src/en/src2.py'")
def _(e):
    eps = e.anchors.filter("anchor_type = 'path' AND anchor_value = 'src/en/src2.py'").select(F.col("episode_id").alias("source_episode_id"))
    ids = e.claim_sources.join(eps, "source_episode_id", "left_semi").select(F.col("claim_id").alias("id"))
    return e.claims.join(ids, "id", "left_semi").select("id", "status")


@query("jn04_claims_by_anchor_values", "SELECT DISTINCT c.id, a.anchor_value FROM claims c JOIN claim_sources s ON s.claim_id = c.id JOIN anchors a ON a.episode_id = s.source_episode_id JOIN episodes e ON e.id = a.episode_id WHERE e.project_slug = 'en' AND a.anchor_value IN ('src/en/src1.py', 'src/en/src2.py', 'src/de/src3.py')")
def _(e):
    held = e.anchors.filter(F.col("anchor_value").isin("src/en/src1.py", "src/en/src2.py", "src/de/src3.py")).join(e.episodes.filter("project_slug = 'en'").select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
    return e.claim_sources.join(held.select(F.col("episode_id").alias("source_episode_id"), "anchor_value"), "source_episode_id").join(e.claims.select(F.col("id").alias("claim_id")), "claim_id", "left_semi").select(F.col("claim_id").alias("id"), "anchor_value").distinct()


_SCOPED = """
WITH scoped AS (
  SELECT s.claim_id, coalesce(e.project_slug, r.project_slug, t.project_slug) AS project_slug
  FROM claim_sources s LEFT JOIN episodes e ON e.id = s.source_episode_id LEFT JOIN records r ON r.id = s.source_record_id LEFT JOIN topics t ON t.id = s.source_topic_id)
"""


@query("jn05_source_scopes", _SCOPED + "SELECT claim_id, project_slug, count(*) AS n FROM scoped GROUP BY claim_id, project_slug")
def _(e):
    return scope.source_scopes(e.claim_sources, e.episodes, e.records, e.topics, ["project_slug"]).groupBy("claim_id", "project_slug").agg(F.count("*").alias("n"))


@query("jn06_claims_in_scope", _SCOPED + "SELECT c.id, c.status FROM claims c WHERE c.id IN (SELECT claim_id FROM scoped GROUP BY claim_id HAVING bool_and(coalesce(project_slug = 'en', false)))")
def _(e):
    rows = scope.source_scopes(e.claim_sources, e.episodes, e.records, e.topics, ["project_slug"])
    return scope.claims_in_scope(e.claims, rows, {"project_slug": "en"}).select("id", "status")


@query("jn08_trust_coverage", """
WITH valid AS (SELECT * FROM claims WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1998-06-01') AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-06-01')),
sourced AS (SELECT DISTINCT claim_id FROM claim_sources),
anchored AS (SELECT DISTINCT s.claim_id FROM claim_sources s JOIN anchors a ON a.episode_id = s.source_episode_id),
n AS (SELECT count(*) AS valid, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'challenged') AS challenged, count(s.claim_id) AS sourced, count(a.claim_id) AS anchored
      FROM valid v LEFT JOIN sourced s ON s.claim_id = v.id LEFT JOIN anchored a ON a.claim_id = v.id)
SELECT *, round(sourced / valid, 3) AS source_ratio, round(anchored / sourced, 3) AS anchor_ratio FROM n
""")
def _(e):
    return reads.trust_coverage(e.claims, e.claim_sources, e.anchors, AS_OF)


@query("jn09_unsourced_claims", "SELECT c.id FROM claims c LEFT JOIN claim_sources s ON s.claim_id = c.id WHERE c.status <> 'expired' GROUP BY c.id HAVING count(s.claim_id) = 0")
def _(e):
    return lifecycle.expire_unsourced(e.claims, e.claim_sources, AS_OF)[1].select(F.col("claim_id").alias("id"))


@query("jn10_orphan_claims", """
SELECT c.id, CASE WHEN NOT EXISTS (SELECT 1 FROM claim_sources s WHERE s.claim_id = c.id) THEN 'no_sources' ELSE 'deleted_sources' END AS reason
FROM claims c WHERE c.status = 'active' AND (NOT EXISTS (SELECT 1 FROM claim_sources s WHERE s.claim_id = c.id)
  OR (SELECT bool_and(s.source_topic_id IS NULL AND s.source_record_id IS NULL AND coalesce(e.deleted, false)) FROM claim_sources s LEFT JOIN episodes e ON e.id = s.source_episode_id WHERE s.claim_id = c.id))
""")
def _(e):
    return lifecycle.orphans(e.claims, e.claim_sources, e.episodes)


@query("jn11_deleted_provenance", "SELECT id FROM episodes WHERE deleted AND id IN (SELECT source_episode_id FROM claim_sources)")
def _(e):
    return lifecycle.deleted_with_claims(e.episodes, e.claim_sources)


@query("jn12_outcomes_of_claims", "SELECT id, outcome_type FROM outcomes WHERE claim_id IN (SELECT id FROM claims WHERE status = 'challenged')")
def _(e):
    return e.outcomes.join(e.claims.filter("status = 'challenged'").select(F.col("id").alias("claim_id")), "claim_id", "left_semi").select("id", "outcome_type")


@query("jn13_outcome_browse", "SELECT claim_id, list_sort(list_distinct(list(action_summary))) AS actions, count(*) AS n FROM outcomes GROUP BY claim_id")
def _(e):
    return e.outcomes.groupBy("claim_id").agg(F.array_sort(F.collect_set("action_summary")).alias("actions"), F.count("*").alias("n"))


@query("jn15_acl_matches", "SELECT a.id, a.write_mode FROM acl_entries a JOIN policies p ON p.id = a.policy_id JOIN principals q ON q.id = a.principal_id WHERE p.enabled AND (p.namespace_slug IS NULL OR p.namespace_slug = 'default') AND (p.project_slug IS NULL OR p.project_slug = 'en') AND ((q.principal_type = 'app_client_name' AND q.principal_key IN ('NATION_0', 'NATION_4', 'NATION_6', 'NATION_8')) OR (q.principal_type = 'agent_name' AND q.principal_key IN ('NATION_1', 'NATION_9')))")
def _(e):
    who = [("app_client_name", f"NATION_{i}") for i in (0, 4, 6, 8)] + [("agent_name", f"NATION_{i}") for i in (1, 9)]
    return scope.matching_acl(e.acl_entries, e.policies, e.principals, {"namespace_slug": "default", "project_slug": "en"}, who).select("id", "write_mode")


@query("tr15_effective_policy", "SELECT policy_id, CASE WHEN bool_or(write_mode = 'deny') THEN 'deny' ELSE 'allow' END AS write_mode, ['private', 'project', 'namespace'][CAST(min(CASE read_visibility WHEN 'private' THEN 1 WHEN 'project' THEN 2 ELSE 3 END) AS BIGINT)] AS read_visibility, count(*) AS matched_entries FROM acl_entries GROUP BY policy_id")
def _(e):
    return scope.effective_policy(e.acl_entries, ["policy_id"])


@query("jn16_policy_listing", "SELECT p.id AS policy_id, a.id AS entry_id, a.write_mode, q.principal_key FROM policies p LEFT JOIN acl_entries a ON a.policy_id = p.id LEFT JOIN principals q ON q.id = a.principal_id")
def _(e):
    return scope.policy_listing(e.policies, e.acl_entries, e.principals).select("policy_id", "entry_id", "write_mode", "principal_key")


@query("jn17_contradicting_partners", "WITH b AS (SELECT from_claim_id AS id, to_claim_id AS partner FROM claim_edges UNION SELECT to_claim_id, from_claim_id FROM claim_edges) SELECT b.id, b.partner FROM b JOIN claims c ON c.id = b.partner WHERE b.id <> b.partner AND c.status IN ('expired', 'challenged') AND b.id IN (SELECT id FROM claims WHERE status = 'active')")
def _(e):
    return recall.partners(e.claim_edges, e.claims, e.claims.filter("status = 'active'").select("id"))


@query("jn26_contradictions_in_runs", "SELECT r.id, r.status, count(c.id) AS contradictions FROM runs r LEFT JOIN contradictions c ON c.detected_at BETWEEN r.started_at AND r.completed_at GROUP BY r.id, r.status")
def _(e):
    return reads.in_windows(e.runs, e.contradictions).select("id", "status", "contradictions")


@query("jn27_runs_with_metrics", "SELECT r.id, r.episodes_processed, m.n FROM runs r LEFT JOIN (SELECT n_regionkey AS id, count(*) AS n FROM nation GROUP BY n_regionkey) m ON m.id = r.id")
def _(e):
    m = e.table("nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.count("*").alias("n"))
    return e.runs.join(m, "id", "left").select("id", "episodes_processed", "n")


@query("jn32_drift", """
WITH changed(path) AS (VALUES ('src/en/src2.py'), ('src/de/src4.py'), ('.tmp_x/src/en/src2.py'))
SELECT s.claim_id AS id, list_sort(list_distinct(list(c.path))) AS paths FROM changed c JOIN anchors a ON a.anchor_value = c.path JOIN claim_sources s ON s.source_episode_id = a.episode_id JOIN claims k ON k.id = s.claim_id
WHERE k.status <> 'expired' AND (k.valid_from IS NULL OR k.valid_from <= TIMESTAMP '1998-06-01') AND (k.valid_until IS NULL OR k.valid_until > TIMESTAMP '1998-06-01') AND NOT starts_with(c.path, '.tmp_') GROUP BY s.claim_id
""")
def _(e):
    changed = e.spark.range(1).select(F.explode(F.array(F.lit("src/en/src2.py"), F.lit("./src/de/src4.py"), F.lit(".tmp_x/src/en/src2.py"))).alias("path"))
    changed = changed.withColumn("path", F.regexp_replace("path", r"^\./", ""))
    return lifecycle.drifted(changed, e.anchors, e.claim_sources, e.claims, "/repo", AS_OF)


@query("jn33_failure_linked_episodes", "SELECT claim_id AS id FROM outcomes WHERE outcome_type = 'failure' AND observed_at >= TIMESTAMP '2024-01-15' UNION SELECT s.source_episode_id FROM claim_sources s WHERE s.source_episode_id IS NOT NULL AND s.claim_id IN (SELECT claim_id FROM outcomes WHERE outcome_type = 'failure' AND observed_at >= TIMESTAMP '2024-01-15')")
def _(e):
    failed = e.outcomes.filter((F.col("outcome_type") == "failure") & (F.col("observed_at") >= temporal.instant("2024-01-15"))).select("claim_id").distinct()
    via = e.claim_sources.filter("source_episode_id IS NOT NULL").join(failed, "claim_id", "left_semi").select(F.col("source_episode_id").alias("id"))
    return failed.select(F.col("claim_id").alias("id")).union(via).distinct()


@query("jn35_topic_consistency", "SELECT t.id, count(r.id) AS records, count(r.id) > 0 AS has_records FROM topics t LEFT JOIN records r ON r.topic_id = t.id AND NOT r.deleted GROUP BY t.id")
def _(e):
    n = e.records.filter("NOT deleted").groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("records"))
    return e.topics.select("id").join(n, "id", "left").select("id", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) > 0).alias("has_records"))


@query("jn36_foreign_sources", "SELECT DISTINCT claim_id AS id FROM outcomes WHERE claim_id NOT IN (SELECT id FROM claims WHERE status = 'active')")
def _(e):
    return e.outcomes.select(F.col("claim_id").alias("id")).distinct().join(e.claims.filter("status = 'active'").select("id"), "id", "left_anti")


@query("ag01_stats", """
WITH a AS (SELECT count(*) FILTER (NOT deleted) AS episodes, count(*) FILTER (NOT deleted AND consolidated = 0) AS pending, count(*) FILTER (NOT deleted AND consolidated = 1) AS consolidated,
  count(*) FILTER (NOT deleted AND consolidated = 2) AS pruned, count(*) FILTER (deleted) AS deleted, count(*) FILTER (NOT deleted AND protected) AS protected, count(*) FILTER (NOT deleted AND NOT indexed) AS unindexed FROM episodes),
b AS (SELECT count(*) AS topics, CAST(coalesce(sum(access_count), 0) AS BIGINT) AS topic_reads FROM topics),
c AS (SELECT count(*) FILTER (NOT deleted) AS records, count(*) FILTER (NOT deleted AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-20') AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20')) AS current_records FROM records)
SELECT * FROM a, b, c
""")
def _(e):
    return reads.stats(e.episodes, e.topics, e.records, NOW)


@query("ag07_failure_rate", "WITH o AS (SELECT count(*) AS outcomes, count(*) FILTER (outcome_type IN ('failure', 'reverted', 'superseded')) AS failures FROM outcomes WHERE observed_at >= TIMESTAMP '2024-01-10') SELECT *, failures / outcomes AS failure_rate FROM o")
def _(e):
    return reads.failure_rate(e.outcomes, "2024-01-10")


@query("ag08_contradicted_topics", "SELECT DISTINCT topic_id FROM contradictions WHERE topic_id IS NOT NULL AND detected_at >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY")
def _(e):
    return e.contradictions.filter(F.col("topic_id").isNotNull() & (F.col("detected_at") >= temporal.instant("2024-01-13"))).select("topic_id").distinct()


@query("ag09_challenged_count", "SELECT count(*) AS n FROM claims WHERE status = 'challenged' AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1998-06-01') AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-06-01')")
def _(e):
    return e.claims.filter((F.col("status") == "challenged") & temporal.valid_at(AS_OF)).agg(F.count("*").alias("n"))


@query("ag11_upper_median", "SELECT access_count AS median FROM episodes WHERE access_count IS NOT NULL ORDER BY access_count LIMIT 1 OFFSET (SELECT CAST(floor(count(*) / 2) AS BIGINT) FROM episodes)")
def _(e):
    return reads.upper_median(e.episodes, "access_count")


_PAIRS = "WITH t AS (SELECT id, created_at, unnest(list_distinct(tags)) AS tag FROM episodes), pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS count, max(a.created_at) AS last_seen FROM t a JOIN t b ON a.id = b.id AND a.tag < b.tag GROUP BY 1, 2) "


@query("ag12_tag_pairs", _PAIRS + "SELECT tag_a, tag_b, count, CAST(epoch(last_seen) AS BIGINT) AS last_seen FROM pairs")
def _(e):
    return reads.tag_pairs(e.episodes).select("tag_a", "tag_b", "count", secs("last_seen"))


@query("ag13_cooccurring_tags", _PAIRS + ", b AS (SELECT tag_a AS given, tag_b AS tag, count FROM pairs WHERE count >= 2 UNION ALL SELECT tag_b, tag_a, count FROM pairs WHERE count >= 2) SELECT tag, CAST(sum(count) AS BIGINT) AS count FROM b WHERE given IN ('en', 'k1') AND tag NOT IN ('en', 'k1') GROUP BY tag")
def _(e):
    return reads.cooccurring(reads.tag_pairs(e.episodes), ["en", "k1"], 2)


@query("ag14_pairs_in_set", _PAIRS + "SELECT tag_a, tag_b, count FROM pairs WHERE count >= 2 AND tag_a IN ('en', 'fr', 'k1', 'k2', 'src1') AND tag_b IN ('en', 'fr', 'k1', 'k2', 'src1')")
def _(e):
    inside = ["en", "fr", "k1", "k2", "src1"]
    return reads.tag_pairs(e.episodes).filter((F.col("count") >= 2) & F.col("tag_a").isin(inside) & F.col("tag_b").isin(inside)).select("tag_a", "tag_b", "count")


@query("ag15_records_by_type", "SELECT topic_id, count(*) FILTER (record_type = 'fact') AS fact, count(*) FILTER (record_type = 'solution') AS solution, count(*) FILTER (record_type = 'preference') AS preference, count(*) FILTER (record_type = 'procedure') AS procedure, count(*) FILTER (record_type = 'strategy') AS strategy FROM records WHERE NOT deleted GROUP BY topic_id")
def _(e):
    return e.records.filter("NOT deleted").groupBy("topic_id").pivot("record_type", ["fact", "solution", "preference", "procedure", "strategy"]).count().fillna(0)


@query("ag16_top_tags", "WITH t AS (SELECT project_slug, unnest(tags) AS tag FROM episodes), n AS (SELECT project_slug, tag, count(*) AS n, CAST(row_number() OVER (PARTITION BY project_slug ORDER BY count(*) DESC, tag) AS INTEGER) AS rank FROM t GROUP BY 1, 2) SELECT * FROM n WHERE rank <= 5")
def _(e):
    from pyspark.sql import Window

    n = e.episodes.select("project_slug", F.explode("tags").alias("tag")).groupBy("project_slug", "tag").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("project_slug").orderBy(F.desc("n"), "tag"))).filter("rank <= 5")


@query("ag18_run_summary", "WITH r AS (SELECT * FROM runs ORDER BY started_at DESC LIMIT 10) SELECT CAST(sum(episodes_processed) AS BIGINT) AS processed, CAST(sum(clusters_failed) AS BIGINT) AS failed, avg(CASE WHEN episodes_processed > 0 THEN episodes_processed END) AS mean_processed FROM r")
def _(e):
    return reads.newest(e.runs, "started_at", 10).agg(F.sum("episodes_processed").alias("processed"), F.sum("clusters_failed").alias("failed"), F.avg(F.when(F.col("episodes_processed") > 0, F.col("episodes_processed"))).alias("mean_processed"))


@query("ag20_first_challenge", "SELECT claim_id AS id, CAST(epoch(min(created_at)) AS BIGINT) AS first_challenged FROM claim_events WHERE event_type = 'challenged' GROUP BY claim_id")
def _(e):
    return temporal.first_challenges(e.claim_events).select("id", secs("first_challenged"))


@query("ag21_dedupe_records", "SELECT id, embedding_text FROM (SELECT id, embedding_text, row_number() OVER (PARTITION BY record_type, lower(trim(embedding_text)) ORDER BY length(embedding_text) DESC, id DESC) AS n FROM records) WHERE n = 1")
def _(e):
    from mnemolake.operators.consolidate import dedupe_records

    return dedupe_records(e.records, ["record_type", F.lower(F.trim("embedding_text"))], F.length("embedding_text"), "id").select("id", "embedding_text")


@query("ag24_hygiene_report", r"""
WITH spelled AS (SELECT id, content_type, content, array_to_string(tags, chr(10)) AS tags, replace(content, chr(304), 'i' || chr(775)) AS text FROM episodes WHERE NOT deleted),
low AS (SELECT id, content_type, content, lower(tags) AS tags, lower(text) AS raw, lower(trim(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r ]+', ' ', 'g'))) AS plain FROM spelled),
bucketed AS (SELECT id, CASE
    WHEN contains(raw, 'coding_agent_eval_test') OR contains(raw, '.tmp_coding_agent_eval') OR contains(raw, 'drift_000') OR contains(raw, 'drift_001') OR contains(raw, 'novelty_eval_test') OR contains(tags, 'smoke') OR contains(tags, 'test-run') THEN 'temp'
    WHEN content_type = 'exchange' THEN 'exchange'
    WHEN content_type = 'solution' AND (plain = '' OR (regexp_matches(plain, '^(?:(?:completed|implemented|final audit|health check)(?:[^\p{L}\p{Nd}\p{Mn}_]|$)|[\w-]+ v\d+\.\d|all \d+ tests pass)')
        AND NOT (contains(plain, 'problem:') OR contains(plain, '"problem"') OR regexp_matches(plain, '[\w.-]+/[\w.-]+\.\w+') OR regexp_matches(content, '(?:^|[\n\r\x{85}\x{2028}\x{2029}])[\t\n\x0B\f\r ]*(?:[iI][sS][sS][uU][eE]|[eE][rR][rR][oO][rR])[\t\n\x0B\f\r ]*:')))) THEN 'noise_journal'
    ELSE 'would_remain' END AS bucket FROM low)
SELECT bucket, count(*) AS n, list_sort(list(id))[1:8] AS samples FROM bucketed GROUP BY bucket
""")
def _(e):
    from mnemolake.operators.consolidate import hygiene_report

    return hygiene_report(lifecycle.hygiene_buckets(e.episodes))


@query("wn01_latest_run", "SELECT id, status FROM runs ORDER BY started_at DESC, id LIMIT 1")
def _(e):
    return reads.newest(e.runs, "started_at", 1).select("id", "status")


@query("wn03_cluster_truncation", "SELECT project_slug, id, n FROM (SELECT project_slug, id, CAST(row_number() OVER (PARTITION BY project_slug ORDER BY surprise_score DESC, id) AS INTEGER) AS n FROM episodes) WHERE n <= 20")
def _(e):
    from pyspark.sql import Window

    return e.episodes.select("project_slug", "id", F.row_number().over(Window.partitionBy("project_slug").orderBy(F.desc("surprise_score"), "id")).alias("n")).filter("n <= 20")


@query("wn04_version_retention", "SELECT claim_id, n FROM (SELECT claim_id, n, row_number() OVER (PARTITION BY claim_id ORDER BY created_at DESC, n) AS r FROM claim_events) WHERE r <= 3")
def _(e):
    return reads.newest(e.claim_events, "created_at", 3, "n", ["claim_id"]).select("claim_id", "n")


@query("wn07_event_gaps", "SELECT claim_id, CAST(max(gap) AS BIGINT) AS longest_gap FROM (SELECT claim_id, epoch(created_at) - lag(epoch(created_at)) OVER (PARTITION BY claim_id ORDER BY created_at, n) AS gap FROM claim_events) GROUP BY claim_id")
def _(e):
    from pyspark.sql import Window

    at = F.unix_seconds(F.col("created_at").cast("timestamp"))
    return e.claim_events.withColumn("gap", at - F.lag(at).over(Window.partitionBy("claim_id").orderBy("created_at", "n"))).groupBy("claim_id").agg(F.max("gap").alias("longest_gap"))


@query("wn08_nearest_rank", "SELECT confidence AS value FROM outcomes WHERE confidence IS NOT NULL ORDER BY confidence LIMIT 1 OFFSET (SELECT CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) FROM outcomes)")
def _(e):
    return reads.nearest_rank(e.outcomes, "confidence", 0.95)


@query("se02_two_directions", "SELECT id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT from_claim_id AS id, count(*) AS n FROM claim_edges GROUP BY 1 UNION ALL SELECT to_claim_id, count(*) FROM claim_edges GROUP BY 1) GROUP BY id")
def _(e):
    a = e.claim_edges.groupBy(F.col("from_claim_id").alias("id")).agg(F.count("*").alias("n"))
    b = e.claim_edges.groupBy(F.col("to_claim_id").alias("id")).agg(F.count("*").alias("n"))
    return a.unionAll(b).groupBy("id").agg(F.sum("n").alias("n"))


@query("se03_ordered_union", "SELECT id, min(rank) AS rank FROM (SELECT id, 0 AS rank FROM episodes WHERE content_type = 'fact' UNION ALL SELECT id, 1 FROM episodes WHERE consolidated = 0 UNION ALL SELECT episode_id, 2 FROM anchors) GROUP BY id")
def _(e):
    parts = [e.episodes.filter("content_type = 'fact'").select("id"), e.episodes.filter("consolidated = 0").select("id"), e.anchors.select(F.col("episode_id").alias("id"))]
    out = None
    for rank, p in enumerate(parts):
        p = p.withColumn("rank", F.lit(rank))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("id").agg(F.min("rank").alias("rank"))


@query("se05_tag_overlap", "SELECT id, len(list_intersect(tags, ['en', 'src1', 'k2'])) AS overlap FROM episodes")
def _(e):
    return e.episodes.select("id", F.size(F.array_intersect("tags", F.array(F.lit("en"), F.lit("src1"), F.lit("k2")))).cast("long").alias("overlap"))


@query("se07_source_union", "SELECT claim_id, list_sort(list_distinct(list(source_episode_id))) AS source_episodes FROM claim_sources WHERE source_episode_id IS NOT NULL GROUP BY claim_id")
def _(e):
    return e.claim_sources.filter("source_episode_id IS NOT NULL").groupBy("claim_id").agg(F.array_sort(F.collect_set("source_episode_id")).alias("source_episodes"))


_OUTCOMES_SQL = """outcome AS (
  SELECT claim_id, count(*) AS validation_count, count(*) FILTER (outcome_type = 'success') AS success_count, count(*) FILTER (outcome_type = 'partial_success') AS partial_success_count,
    count(*) FILTER (outcome_type IN ('failure', 'reverted', 'superseded')) AS failure_count, count(*) FILTER (outcome_type = 'failure') AS explicit_failure_count, count(*) FILTER (outcome_type = 'reverted') AS reverted_count,
    count(*) FILTER (outcome_type = 'superseded') AS superseded_count, count(*) FILTER (trim(provenance) NOT IN ('', '{}', 'null')) AS outcomes_with_provenance_count, max(observed_at) AS last_observed_at
  FROM outcomes WHERE observed_at <= TIMESTAMP '2024-01-20' GROUP BY claim_id)"""
_EVENTS_SQL = """event AS (
  SELECT claim_id, count(*) FILTER (event_type = 'contradiction') AS contradiction_count, count(*) FILTER (event_type = 'challenged') AS challenged_count,
    count(*) FILTER (event_type = 'code_drift_detected') AS drift_event_count, count(*) FILTER (event_type IN ('expire', 'auto_expired_challenged')) AS expiry_event_count
  FROM claim_events GROUP BY claim_id)"""
_SOURCES_SQL = """source AS (
  SELECT s.claim_id, count(*) AS source_link_count, count(DISTINCT s.source_episode_id) AS source_episode_count, count(DISTINCT s.source_topic_id) AS source_topic_count,
    count(DISTINCT s.source_record_id) AS source_record_count, count(DISTINCT a.anchor_type || ':' || a.anchor_value) AS source_anchor_count
  FROM claim_sources s LEFT JOIN anchors a ON a.episode_id = s.source_episode_id GROUP BY s.claim_id)"""


@query("ag03_outcome_evidence", f"WITH {_OUTCOMES_SQL} SELECT * EXCLUDE (last_observed_at), CAST(epoch(last_observed_at) AS BIGINT) AS last_observed_at FROM outcome")
def _(e):
    return evidence.outcome_evidence(e.outcomes, EVENTS_AT).withColumn("last_observed_at", F.round(F.unix_micros(F.col("last_observed_at").cast("timestamp")) / 1_000_000).cast("long"))


@query("ag04_event_evidence", f"WITH {_EVENTS_SQL} SELECT * FROM event")
def _(e):
    return evidence.event_evidence(e.claim_events)


@query("ag05_source_evidence", f"WITH {_SOURCES_SQL} SELECT * FROM source")
def _(e):
    return evidence.source_evidence(e.claim_sources, e.anchors)


def _evidence(e):
    return evidence.assemble(e.claims, evidence.outcome_evidence(e.outcomes, EVENTS_AT), evidence.event_evidence(e.claim_events), evidence.source_evidence(e.claim_sources, e.anchors))


_COUNTS = evidence.OUTCOME_COUNTS + evidence.EVENT_COUNTS + evidence.SOURCE_COUNTS
ASSEMBLED_SQL = f"{_OUTCOMES_SQL}, {_EVENTS_SQL}, {_SOURCES_SQL}, ev AS (SELECT c.id, c.status, c.claim_type, c.canonical_text, c.confidence, c.precision_, c.valid_from, c.valid_until, c.updated_at, o.last_observed_at, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _COUNTS)} FROM claims c LEFT JOIN outcome o ON o.claim_id = c.id LEFT JOIN event v ON v.claim_id = c.id LEFT JOIN source s ON s.claim_id = c.id)"


@query("ag06_assembled_evidence", f"WITH {ASSEMBLED_SQL} SELECT id, {', '.join(_COUNTS)} FROM ev")
def _(e):
    return _evidence(e).select("id", *_COUNTS)
