"""Scans, lookups, filters, aggregates and rankings over the entity tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.temporal import instant, valid_at


def visible(episodes: DataFrame) -> DataFrame:
    """Episodes that reads may return: not deleted, vector durable."""
    return episodes.filter("NOT deleted AND indexed")


def active_episodes(episodes: DataFrame) -> DataFrame:
    """Neither deleted nor pruned."""
    return episodes.filter("NOT deleted AND consolidated <> 2")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id", missing: bool = False) -> DataFrame:
    """Rows whose key is among ids, or the ids that no row has. Join strategy is left to statistics."""
    wanted = ids.select(key).distinct()
    return wanted.join(rows.select(key), key, "left_anti") if missing else rows.join(wanted, key, "left_semi")


def search_episodes(episodes: DataFrame, query: str | None = None, content_types: Sequence[str] | None = None, tags: Sequence[str] | None = None, after: str | None = None, before: str | None = None, limit: int | None = 20) -> DataFrame:
    """Substring in any case, type, any tag, created strictly between; newest first. Vectors need not be durable yet."""
    out = episodes.filter("NOT deleted")
    if query:
        out = out.filter(F.contains(F.lower("content"), F.lower(F.lit(query))))
    if content_types:
        out = out.filter(F.col("content_type").isin(list(content_types)))
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if after:
        out = out.filter(F.col("created_at") > instant(after))
    if before:
        out = out.filter(F.col("created_at") < instant(before))
    out = out.orderBy(F.desc("created_at"), "id")
    return out if limit is None else out.limit(max(1, limit))


def unconsolidated(episodes: DataFrame, priority: DataFrame | None = None, max_attempts: int = 5, limit: int | None = None) -> DataFrame:
    """Pending episodes with attempts left: those named in priority first, then the newest."""
    out = episodes.filter(f"NOT deleted AND indexed AND consolidated = 0 AND consolidation_attempts < {max_attempts}")
    flag = F.lit(1)
    if priority is not None:
        out = out.join(priority.select("id").distinct().withColumn("first", F.lit(0)), "id", "left")
        flag = F.coalesce("first", F.lit(1))
    out = out.withColumn("priority", flag).drop("first").orderBy("priority", F.desc("created_at"), "id")
    return out if limit is None else out.limit(limit)


def prunable(episodes: DataFrame, now: str, days: int) -> DataFrame:
    """Consolidated before the cutoff, not protected, not deleted."""
    return episodes.filter(F.expr("NOT deleted AND NOT protected AND consolidated = 1") & (F.col("consolidated_at") < instant(now) - F.expr(f"INTERVAL {int(days)} DAYS")))


def preview(c: Column, n: int) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def records_with_topics(records: DataFrame, topics: DataFrame, now: str | None = None) -> DataFrame:
    """Records that are not deleted (and valid, if a time is given) with their topic's title and confidence."""
    out = records.filter("NOT deleted")
    if now is not None:
        out = out.filter(valid_at(now))
    return out.join(topics.select(F.col("id").alias("topic_id"), F.col("title").alias("topic_title"), F.col("confidence").alias("topic_confidence")), "topic_id")


def low_confidence(records: DataFrame, topics: DataFrame, now: str, below: float = 0.5) -> DataFrame:
    return records_with_topics(records, topics, now).filter(F.col("confidence") < below).orderBy("confidence", "id")


def contradictions(log: DataFrame, topics: DataFrame, topic_id: int | None = None, limit: int = 50) -> DataFrame:
    """Newest contradictions with their topic, if they have one."""
    rows = log if topic_id is None else log.filter(F.col("topic_id") == topic_id)
    return rows.join(topics.select(F.col("id").alias("topic_id"), "title"), "topic_id", "left").orderBy(F.desc("detected_at"), "id").limit(limit)


def stats(episodes: DataFrame, topics: DataFrame, records: DataFrame, now: str) -> DataFrame:
    """One row of counters over the buffer and the knowledge."""
    live = F.expr("NOT deleted")
    a = episodes.agg(
        F.count_if(live).alias("episodes"), F.count_if(live & (F.col("consolidated") == 0)).alias("pending"), F.count_if(live & (F.col("consolidated") == 1)).alias("consolidated"),
        F.count_if(live & (F.col("consolidated") == 2)).alias("pruned"), F.count_if(F.col("deleted")).alias("deleted"), F.count_if(live & F.col("protected")).alias("protected"), F.count_if(live & ~F.col("indexed")).alias("unindexed"),
    )
    b = topics.agg(F.count("*").alias("topics"), F.coalesce(F.sum("access_count"), F.lit(0)).alias("topic_reads"))
    c = records.agg(F.count_if(live).alias("records"), F.count_if(live & valid_at(now)).alias("current_records"))
    return a.crossJoin(b).crossJoin(c)  # one row each


#: Rows that are ordered in one task to find a value by its place; more are narrowed down first.
ORDERED_ROWS = 1_000_000


def at_place(rows: DataFrame, column: str, place: Callable[[int], int], name: str, ordered: int = ORDERED_ROWS) -> DataFrame:
    """One row: the value at the place (from 0, of the number of values) in the sorted column; null if there is none.

    Bounds around the place come from approximate percentiles, and rows below them are counted, until few enough are
    between them; only these, as counts of each value, are ordered. The driver gets bounds and counts.
    """
    held = rows.select(F.col(column).alias("v")).filter("v IS NOT NULL")
    n = inside = held.count()
    at, below = place(n), 0
    while inside > ordered:
        share = [min(1.0, max(0.0, (at - below) / inside + d)) for d in (-1e-3, 1e-3)]
        lo, hi = held.agg(F.percentile_approx("v", share, 10_000).alias("p")).first()["p"]
        less = held.filter(F.col("v") < F.lit(lo)).count()
        held = held.filter(F.col("v").between(F.lit(lo), F.lit(hi)))
        now = held.count()
        if now > inside / 2:  # one value holds most of them: its count is one row
            below += less
            break
        below, inside = below + less, now
    upto = F.sum("count").over(Window.orderBy("v")) + below
    return held.groupBy("v").count().withColumn("upto", upto).filter(F.col("upto") > at).agg(F.min("v").alias(name))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """The value at place n div 2 of the sorted column: of two middle values the larger."""
    return at_place(rows, column, lambda n: n // 2, "median")


def trust_coverage(claims: DataFrame, sources: DataFrame, anchors: DataFrame, as_of: str) -> DataFrame:
    """Valid, active, challenged, sourced and anchored claims, and the shares of sources and anchors."""
    sourced = sources.select(F.col("claim_id").alias("id")).distinct().withColumn("sourced", F.lit(True))
    held = anchors.select(F.col("episode_id").alias("source_episode_id")).distinct()
    anchored = sources.join(held, "source_episode_id", "left_semi").select(F.col("claim_id").alias("id")).distinct().withColumn("anchored", F.lit(True))
    rows = claims.filter(valid_at(as_of)).join(sourced, "id", "left").join(anchored, "id", "left")
    out = rows.agg(F.count("*").alias("valid"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "challenged").alias("challenged"), F.count("sourced").alias("sourced"), F.count("anchored").alias("anchored"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 3)).otherwise(F.lit(0.0))
    return out.withColumn("source_ratio", ratio("sourced", "valid")).withColumn("anchor_ratio", ratio("anchored", "sourced"))


def failure_rate(outcomes: DataFrame, since: str) -> DataFrame:
    out = outcomes.filter(F.col("observed_at") >= instant(since)).agg(F.count("*").alias("outcomes"), F.count_if(F.col("outcome_type").isin("failure", "reverted", "superseded")).alias("failures"))
    return out.withColumn("failure_rate", F.when(F.col("outcomes") > 0, F.col("failures") / F.col("outcomes")).otherwise(F.lit(0.0)))


def tag_pairs(episodes: DataFrame) -> DataFrame:
    """Unordered pairs of an episode's distinct tags, how many episodes have both, and when last."""
    tags = F.array_sort(F.array_distinct("tags"))
    pairs = F.flatten(F.transform(tags, lambda a, i: F.transform(F.slice(tags, i + 2, F.greatest(F.size(tags), F.lit(1))), lambda b: F.struct(a.alias("tag_a"), b.alias("tag_b")))))
    rows = episodes.select("created_at", F.explode(pairs).alias("p"))
    return rows.groupBy("p.tag_a", "p.tag_b").agg(F.count("*").alias("count"), F.max("created_at").alias("last_seen"))


def cooccurring(pairs: DataFrame, tags: Sequence[str], min_count: int = 2) -> DataFrame:
    """Tags seen with the given ones, counted over both directions, without the given ones."""
    kept = pairs.filter(F.col("count") >= min_count)
    both = kept.select(F.col("tag_a").alias("given"), F.col("tag_b").alias("tag"), "count").unionByName(kept.select(F.col("tag_b").alias("given"), F.col("tag_a").alias("tag"), "count"))
    return both.filter(F.col("given").isin(list(tags)) & ~F.col("tag").isin(list(tags))).groupBy("tag").agg(F.sum("count").alias("count"))


def newest(rows: DataFrame, by: str, n: int, key: str = "id", per: Sequence[str] = ()) -> DataFrame:
    """The n newest rows, of each group if any is named; ties go to the smaller key."""
    if not per:
        return rows.orderBy(F.desc(by), key).limit(n)
    w = Window.partitionBy(*per).orderBy(F.desc(by), key)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def in_windows(runs: DataFrame, events: DataFrame, step_seconds: int = 86400) -> DataFrame:
    """Events inside each run's window, both ends included: counted by an equi-join on buckets of time, then exact ends.

    A run is listed in every bucket that it overlaps, an event in one, so no run meets all events.
    """
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    spans = runs.select(F.col("id").alias("run_id"), "started_at", "completed_at", F.explode(F.sequence(F.floor(seconds("started_at") / step_seconds), F.floor(seconds("completed_at") / step_seconds))).alias("bucket"))
    dated = events.select("detected_at", F.floor(seconds("detected_at") / step_seconds).alias("bucket"))
    hits = spans.join(dated, "bucket").filter(F.col("detected_at").between(F.col("started_at"), F.col("completed_at")))
    counted = hits.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("contradictions"))
    return runs.join(counted, "id", "left").withColumn("contradictions", F.coalesce("contradictions", F.lit(0)))


def nearest_rank(rows: DataFrame, column: str, p: float) -> DataFrame:
    """The value at place round-half-even(p (n - 1)) of the sorted column."""
    return at_place(rows, column, lambda n: round((n - 1) * p), "value")
