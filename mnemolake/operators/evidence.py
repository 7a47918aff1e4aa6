"""Evidence about claims, gathered from outcomes, events and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.scope import left_join
from mnemolake.operators.temporal import instant

OUTCOME_COUNTS = ["validation_count", "success_count", "partial_success_count", "failure_count", "explicit_failure_count", "reverted_count", "superseded_count", "outcomes_with_provenance_count"]
EVENT_COUNTS = ["contradiction_count", "challenged_count", "drift_event_count", "expiry_event_count"]
SOURCE_COUNTS = ["source_link_count", "source_episode_count", "source_topic_count", "source_record_count", "source_anchor_count"]


def outcome_evidence(outcomes: DataFrame, as_of: str | None = None) -> DataFrame:
    """Counts of a claim's outcomes by kind up to as_of, and the last one's time."""
    rows = outcomes if as_of is None else outcomes.filter(F.col("observed_at") <= instant(as_of))
    kind = F.col("outcome_type")
    held = F.col("provenance").isNotNull() & ~F.trim("provenance").isin("", "{}", "null")
    return rows.groupBy("claim_id").agg(
        F.count("*").alias("validation_count"),
        F.count_if(kind == "success").alias("success_count"),
        F.count_if(kind == "partial_success").alias("partial_success_count"),
        F.count_if(kind.isin("failure", "reverted", "superseded")).alias("failure_count"),
        F.count_if(kind == "failure").alias("explicit_failure_count"),
        F.count_if(kind == "reverted").alias("reverted_count"),
        F.count_if(kind == "superseded").alias("superseded_count"),
        F.count_if(held).alias("outcomes_with_provenance_count"),
        F.max("observed_at").alias("last_observed_at"),
    )


def event_evidence(events: DataFrame, as_of: str | None = None) -> DataFrame:
    rows = events if as_of is None else events.filter(F.col("created_at") <= instant(as_of))
    kind = F.col("event_type")
    return rows.groupBy("claim_id").agg(
        F.count_if(kind == "contradiction").alias("contradiction_count"),
        F.count_if(kind == "challenged").alias("challenged_count"),
        F.count_if(kind == "code_drift_detected").alias("drift_event_count"),
        F.count_if(kind.isin("expire", "auto_expired_challenged")).alias("expiry_event_count"),
    )


def source_evidence(sources: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links and distinct sources of a claim. A link counts once for each anchor of its episode.

    Links are counted by their episodes' numbers of anchors, and distinct values as rows (claim, kind, value), so no
    row of links times anchors is made.
    """
    a = anchors.select(F.col("episode_id").alias("source_episode_id"), F.concat_ws(":", "anchor_type", "anchor_value").alias("value")).distinct()
    held = a.groupBy("source_episode_id").agg(F.count("*").alias("n"))
    links = left_join(sources.select("claim_id", "source_episode_id"), held, "source_episode_id").groupBy("claim_id").agg(F.sum(F.coalesce("n", F.lit(1))).alias("source_link_count"))
    kinds = {"episode": "source_episode_id", "topic": "source_topic_id", "record": "source_record_id"}
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in kinds.items()]))
    values = sources.select("claim_id", named.alias("s")).select("claim_id", "s.kind", "s.value").filter("value IS NOT NULL").distinct()
    anchored = sources.select("claim_id", "source_episode_id").distinct().join(a, "source_episode_id").select("claim_id", F.lit("anchor").alias("kind"), "value").distinct()
    counts = values.unionByName(anchored).groupBy("claim_id").agg(*[F.count_if(F.col("kind") == k).alias(f"source_{k}_count") for k in (*kinds, "anchor")])
    return links.join(counts, "claim_id", "left").fillna(0)


def assemble(claims: DataFrame, outcome: DataFrame, event: DataFrame, source: DataFrame) -> DataFrame:
    """Claims with all counts, zero where there is no evidence."""
    rows = claims
    for part in (outcome, event, source):
        rows = rows.join(part.withColumnRenamed("claim_id", "id"), "id", "left")
    return rows.fillna(0, OUTCOME_COUNTS + EVENT_COUNTS + SOURCE_COUNTS)
