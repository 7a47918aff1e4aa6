"""The driver's tables in the roles of the engine's entities.

Each role is a list of expressions that Spark SQL and DuckDB read alike, but for a few functions filled in by
dialect, so that a query and its check start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"array": "array", "text": "STRING", "ts": "timestamp_seconds", "to": ""}
_DUCK = {"array": "list_value", "text": "VARCHAR", "ts": "make_us", "to": ""}

#: role: (table, expressions, filter)
ROLES: dict[str, tuple[str, list[str], str | None]] = {
    "episodes": ("documents", [
        "doc_id AS id", "text AS content",
        "CASE doc_id % 5 WHEN 0 THEN 'exchange' WHEN 1 THEN 'fact' WHEN 2 THEN 'solution' WHEN 3 THEN 'preference' ELSE 'procedure' END AS content_type",
        "{array}(lang, source, concat('k', CAST(doc_id % 7 AS {text}))) AS tags",
        "CAST(doc_id * 37 % 91 + 10 AS DOUBLE) / 100 AS surprise_score", "CAST(doc_id * 7 % 23 AS INT) AS access_count",
        "{ts}(1704067200 + doc_id % 720 * 3600) AS created_at", "{ts}(1704067200 + doc_id % 500 * 3600) AS updated_at",
        "CAST(doc_id % 3 AS INT) AS consolidated", "{ts}(1704067200 + doc_id % 600 * 3600) AS consolidated_at",
        "doc_id % 7 <> 0 AS indexed", "doc_id % 11 = 0 AS deleted", "doc_id % 13 = 0 AS protected", "CAST(doc_id % 6 AS INT) AS consolidation_attempts",
        "'default' AS namespace_slug", "lang AS project_slug", "source AS app_client_name",
    ], None),
    "claims": ("orders", [
        "o_orderkey AS id",
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'fact' WHEN '2' THEN 'solution' WHEN '3' THEN 'preference' WHEN '4' THEN 'procedure' ELSE 'strategy' END AS claim_type",
        "concat('claim ', o_orderpriority, ' of ', CAST(o_custkey AS {text})) AS canonical_text",
        "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'challenged' ELSE 'expired' END AS status",
        "CAST(o_orderkey % 100 AS DOUBLE) / 100 AS confidence", "CAST(o_orderkey % 11 AS DOUBLE) / 10 AS precision_",
        "o_orderdate AS valid_from", "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 400 DAY END AS valid_until",
        "o_orderdate AS created_at", "o_orderdate + INTERVAL 30 DAY AS updated_at",
    ], None),
    "claim_sources": ("lineitem", [
        "l_orderkey AS claim_id", "CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey END AS source_episode_id",
        "CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS source_topic_id", "CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END AS source_record_id", "l_shipdate AS created_at",
    ], None),
    "claim_events": ("lineitem", [
        "l_orderkey AS claim_id", "l_linenumber AS n",
        "CASE WHEN l_returnflag = 'R' THEN 'challenged' WHEN l_returnflag = 'A' THEN 'contradiction' WHEN l_linenumber % 2 = 0 THEN 'code_drift_detected' WHEN l_linenumber % 5 = 0 THEN 'expire' ELSE 'update' END AS event_type",
        "l_shipdate AS created_at",
    ], None),
    "claim_edges": ("lineitem", ["l_orderkey AS from_claim_id", "l_partkey AS to_claim_id", "'contradicts' AS edge_type", "l_shipdate AS created_at"], "l_returnflag = 'A'"),
    "outcomes": ("events", [
        "event_id AS id", "user_id AS claim_id",
        "CASE WHEN event_type = 'purchase' THEN 'success' WHEN event_type = 'signup' THEN 'partial_success' WHEN event_type = 'error' THEN 'failure' WHEN event_id % 10 = 0 THEN 'reverted' WHEN event_id % 15 = 1 THEN 'superseded' ELSE 'neutral' END AS outcome_type",
        "value AS confidence", "props AS provenance", "ts AS observed_at", "ts AS created_at", "concat('act ', event_type) AS action_summary",
    ], None),
    "topics": ("supplier", [
        "s_suppkey AS id", "s_name AS title", "concat(s_name, '.md') AS filename", "CAST(s_suppkey % 50 + 50 AS DOUBLE) / 100 AS confidence",
        "CAST(s_suppkey % 9 AS INT) AS access_count", "{ts}(1704067200 + s_suppkey % 300 * 7200) AS updated_at", "CAST(s_nationkey AS {text}) AS project_slug", "'default' AS namespace_slug",
    ], None),
    "records": ("part", [
        "p_partkey AS id", "p_partkey % 10 + 1 AS topic_id",
        "CASE p_size % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'solution' WHEN 2 THEN 'preference' WHEN 3 THEN 'procedure' ELSE 'strategy' END AS record_type",
        "concat(p_name, ' ', p_type) AS embedding_text", "CAST(p_size AS DOUBLE) / 50 AS confidence", "CAST(p_partkey % 8 AS INT) AS access_count",
        "{ts}(1703000000 + p_partkey % 900 * 3600) AS created_at", "{ts}(1704067200 + p_size * 86400) AS valid_from",
        "CASE WHEN p_partkey % 4 = 0 THEN {ts}(1704067200 + (p_size + 20) * 86400) END AS valid_until", "p_partkey % 17 = 0 AS deleted", "'default' AS namespace_slug", "p_brand AS project_slug",
    ], None),
    "contradictions": ("events", [
        "event_id AS id", "CASE WHEN event_id % 9 <> 0 THEN user_id % 14 + 1 END AS topic_id", "event_id % 500 AS old_record_id", "event_id % 700 AS new_record_id",
        "CASE event_id % 3 WHEN 0 THEN 'expired_old' WHEN 1 THEN 'competing_hypotheses' ELSE 'silent_drop' END AS resolution", "ts AS detected_at",
    ], "event_type = 'error'"),
    "runs": ("nation", [
        "n_nationkey AS id", "{ts}(1704067200 + n_nationkey * 86400) AS started_at", "{ts}(1704067200 + n_nationkey * 86400 + 64800) AS completed_at",
        "CASE WHEN n_nationkey % 4 = 3 THEN 'failed' ELSE 'completed' END AS status", "CAST(n_nationkey * 3 AS INT) AS episodes_processed", "CAST(n_nationkey % 6 AS INT) AS clusters_failed",
    ], None),
    "anchors": ("documents", ["doc_id AS episode_id", "'path' AS anchor_type", "concat('src/', lang, '/', source, '.py') AS anchor_value", "{ts}(1704067200 + doc_id % 720 * 3600) AS created_at"], None),
    "vectors": ("embeddings", ["vec_id AS id", "embedding", "label", "vec_id % 19 = 0 AS tombstoned"], None),
    "turns": ("conversations", ["conv_id", "turn", "role", "text"], None),
    "principals": ("nation", ["n_nationkey AS id", "CASE WHEN n_nationkey % 2 = 0 THEN 'app_client_name' ELSE 'agent_name' END AS principal_type", "n_name AS principal_key"], None),
    "policies": ("region", ["r_regionkey AS id", "CASE WHEN r_regionkey % 2 = 0 THEN 'default' END AS namespace_slug", "CASE WHEN r_regionkey % 3 = 0 THEN 'en' END AS project_slug", "r_regionkey <> 4 AS enabled"], None),
    "acl_entries": ("nation", ["n_nationkey AS id", "n_regionkey AS policy_id", "n_nationkey AS principal_id", "CASE WHEN n_nationkey % 5 = 0 THEN 'deny' ELSE 'allow' END AS write_mode", "CASE n_nationkey % 3 WHEN 0 THEN 'private' WHEN 1 THEN 'project' ELSE 'namespace' END AS read_visibility"], None),
}


class Entities:
    """Roles as DataFrames: `e.claims`, and any table of the driver by `e.table(name)`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, role: str) -> DataFrame:
        if role not in ROLES:
            raise AttributeError(role)
        table, columns, where = ROLES[role]
        df = self.table(table)
        if where:
            df = df.filter(where)
        return df.selectExpr(*[c.format(**_SPARK) for c in columns])


def _duck(role: str) -> str:
    table, columns, where = ROLES[role]
    body = ", ".join(c.format(**_DUCK) for c in columns)
    # make_us(seconds): a timestamp from seconds since the epoch
    while (at := body.find("make_us(")) >= 0:
        depth, end = 1, at + 8
        while depth:
            depth += {"(": 1, ")": -1}.get(body[end], 0)
            end += 1
        body = f"{body[:at]}make_timestamp(CAST(({body[at + 8 : end - 1]}) AS BIGINT) * 1000000){body[end:]}"
    return f"{role} AS (SELECT {body} FROM {table}" + (f" WHERE {where}" if where else "") + ")"


def with_entities(sql: str) -> str:
    """The statement with the roles it names put before it as common tables."""
    used = [r for r in ROLES if re.search(rf"\b{r}\b", sql)]
    head = ", ".join(_duck(r) for r in used)
    sql = sql.strip()
    if not head:
        return sql
    if sql[:5].upper() == "WITH ":
        return f"WITH {head}, {sql[5:]}"
    return f"WITH {head} {sql}"
