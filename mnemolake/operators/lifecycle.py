"""Changes to claims, episodes, records and topics, as new versions of their tables.

Functions take and return DataFrames; `sources.catalog` publishes several tables as one snapshot.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.scope import left_join
from mnemolake.operators.temporal import instant, valid_at


def merge(current: DataFrame, changes: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Upsert: changed rows replace current ones with the same keys; columns in keep stay where there was a row."""
    cur = current.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*current.columns).alias("__cur"))
    new = changes.select(*keys, F.struct(*[c for c in current.columns if c in changes.columns]).alias("__new"))
    on = [F.col(f"__k_{k}").eqNullSafe(F.col(k)) for k in keys]
    both = cur.join(new, on, "full_outer")
    have = set(changes.columns)

    def pick(c: str):
        if c not in have:
            return F.col(f"__cur.{c}")
        fresh = F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__cur.{c}"))
        return F.when(F.col("__cur").isNotNull(), F.col(f"__cur.{c}")).otherwise(fresh) if c in keep else fresh

    return both.select(*[pick(c).alias(c) for c in current.columns])


def update(rows: DataFrame, ids: DataFrame, changes: dict, key: str = "id") -> DataFrame:
    """Rows with the columns in changes set where the key is among ids."""
    flag = ids.select(F.col(key)).distinct().withColumn("__hit", F.lit(True))
    joined = rows.join(flag, key, "left")
    return joined.withColumns({c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).select(*rows.columns)


def append_new(rows: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Appends rows whose keys are not there yet, each once."""
    fresh = new.dropDuplicates(list(keys)).join(rows.select(*keys), list(keys), "left_anti")
    return rows.unionByName(fresh.select(*rows.columns))


def orphans(claims: DataFrame, sources: DataFrame, episodes: DataFrame) -> DataFrame:
    """Active claims without sources, or with none but deleted episodes: (id, reason)."""
    active = claims.filter("status = 'active'").select("id")
    has = sources.select(F.col("claim_id").alias("id")).distinct()
    gone = episodes.filter("deleted").select(F.col("id").alias("source_episode_id"))
    dead = sources.join(gone, "source_episode_id", "left_semi").select("claim_id", "source_episode_id", "source_topic_id", "source_record_id")
    alive = sources.join(gone, "source_episode_id", "left_anti").select(F.col("claim_id").alias("id"))
    only = dead.filter("source_topic_id IS NULL AND source_record_id IS NULL").select(F.col("claim_id").alias("id"))
    other = dead.filter("source_topic_id IS NOT NULL OR source_record_id IS NOT NULL").select(F.col("claim_id").alias("id"))
    none = active.join(has, "id", "left_anti").withColumn("reason", F.lit("no_sources"))
    deleted = active.join(only, "id", "left_semi").join(alive.unionByName(other).distinct(), "id", "left_anti").withColumn("reason", F.lit("deleted_sources"))
    return none.unionByName(deleted)


def deleted_with_claims(episodes: DataFrame, sources: DataFrame) -> DataFrame:
    """Deleted episodes that still are some claim's source."""
    return episodes.filter("deleted").select("id").join(sources.select(F.col("source_episode_id").alias("id")), "id", "left_semi")


def event(ids: DataFrame, kind: str, now: str) -> DataFrame:
    return ids.select(F.col("id").alias("claim_id"), F.lit(kind).alias("event_type"), instant(now).alias("created_at"))


def expire(claims: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Expired as of now; an earlier end stays."""
    t = instant(now)
    return update(claims, ids, {"valid_until": F.least(F.coalesce(F.col("valid_until"), t), t), "updated_at": t, "status": F.lit("expired")})


def expire_unsourced(claims: DataFrame, sources: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(claims, expire events) after active claims without sources have ended."""
    ids = claims.filter("status <> 'expired'").select("id").join(sources.select(F.col("claim_id").alias("id")), "id", "left_anti")
    return expire(claims, ids, now), event(ids, "expire", now)


def challenge(claims: DataFrame, ids: DataFrame, now: str, kind: str = "challenged") -> tuple[DataFrame, DataFrame]:
    """(claims, events) after the active ones among ids are challenged."""
    hit = claims.filter((F.col("status") == "active") & valid_at(now)).select("id").join(ids.select("id").distinct(), "id", "left_semi")
    return update(claims, hit, {"status": F.lit("challenged"), "updated_at": instant(now)}), event(hit, kind, now)


def with_ttl(events: DataFrame, now: str, hours: float = 168) -> DataFrame:
    """`lifecycle_state` at a time, and claims that have been challenged for `hours` or longer expired: id, last, state.

    A claim counts as challenged since its first `challenged` event, else since the event that casts doubt on it.
    """
    past = events.filter(F.col("created_at") <= instant(now))
    first = past.filter("event_type = 'challenged'").groupBy(F.col("claim_id").alias("id")).agg(F.min("created_at").alias("since"))
    rows = lifecycle_state(past).join(first, "id", "left")
    over = (F.col("state") == "challenged") & (F.coalesce("since", "at") <= instant(now) - F.make_dt_interval(hours=F.lit(int(hours)), mins=F.lit(round(hours % 1 * 60))))
    return rows.select("id", F.when(over, "auto_expired_challenged").otherwise(F.col("last")).alias("last"), F.when(over, "expired").otherwise(F.col("state")).alias("state"))


def stale_challenged(claims: DataFrame, events: DataFrame, now: str, hours: int = 168, limit: int | None = 200) -> DataFrame:
    """Claims challenged for longer than a time to live, longest first: (id, challenged_at)."""
    first = events.filter("event_type = 'challenged'").groupBy(F.col("claim_id").alias("id")).agg(F.min("created_at").alias("challenged_at"))
    out = claims.filter("status = 'challenged'").filter(valid_at(now)).select("id").join(first, "id").filter(F.col("challenged_at") <= instant(now) - F.expr(f"INTERVAL {int(hours)} HOURS")).orderBy("challenged_at", "id")
    return out if limit is None else out.limit(limit)


def detach_sources(sources: DataFrame, episode_ids: DataFrame) -> DataFrame:
    """Sources without the given episodes: links with another source keep it, others go."""
    gone = episode_ids.select(F.col("id").alias("source_episode_id")).distinct().withColumn("__gone", F.lit(True))
    rows = left_join(sources, gone, "source_episode_id")
    kept = rows.filter("__gone IS NULL OR source_topic_id IS NOT NULL OR source_record_id IS NOT NULL")
    return kept.withColumn("source_episode_id", F.when(F.col("__gone").isNull(), F.col("source_episode_id"))).select(*sources.columns)


def forget(episodes: DataFrame, vectors: DataFrame, claims: DataFrame, sources: DataFrame, ids: DataFrame, now: str) -> dict[str, DataFrame]:
    """Deletes episodes softly, marks their vectors, detaches them from claims, ends claims left without sources."""
    left = detach_sources(sources, ids)
    ended, events = expire_unsourced(claims, left, now)
    return {"episodes": update(episodes, ids, {"deleted": F.lit(True), "updated_at": instant(now)}), "vectors": update(vectors, ids, {"tombstoned": F.lit(True)}), "claim_sources": left, "claims": ended, "claim_events": events}


def restore(episodes: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Episodes with the softly deleted ones among ids back."""
    return update(episodes, episodes.filter("deleted").select("id").join(ids.select("id"), "id", "left_semi"), {"deleted": F.lit(False), "updated_at": instant(now)})


def hard_delete(tables: Mapping[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables, each given with its column that names an episode, without the rows of the episodes among ids."""
    gone = ids.select("id").distinct()
    return {name: rows.join(gone.withColumnRenamed("id", key), key, "left_anti").select(*rows.columns) for name, (rows, key) in tables.items()}


def retained(versions: DataFrame, keep: int, per: str = "topic_id", by: str = "superseded_at") -> DataFrame:
    """The `keep` newest rows of each topic; of equally new ones those that come last by what they say."""
    w = Window.partitionBy(per).orderBy(F.desc(by), *[F.desc_nulls_last(c) for c in versions.columns if c not in (per, by)])
    return versions.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= keep).drop("__n")


def fold_access(rows: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    """Adds logged reads to access counters; reads themselves change nothing."""
    n = log.groupBy(key).agg(F.count("*").alias("__n"))
    return rows.join(n, key, "left").withColumn("access_count", (F.col("access_count") + F.coalesce("__n", F.lit(0))).cast("int")).select(*rows.columns)


def reset_attempts(episodes: DataFrame, now: str, most: int = 5, hours: int = 24) -> DataFrame:
    """Episodes out of attempts get new ones once their last is a day old."""
    stale = (F.col("consolidation_attempts") >= most) & (F.col("updated_at") <= instant(now) - F.expr(f"INTERVAL {hours} HOURS"))
    return episodes.withColumn("consolidation_attempts", F.when(stale, F.lit(0)).otherwise(F.col("consolidation_attempts")))


def path_variants(path, root: str):
    """The spellings under which a path may have been noted: plain, ./, Windows, and absolute."""
    p = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"^(\./)+", "")
    win = F.replace(p, F.lit("/"), F.lit("\\"))
    full = F.concat(F.lit(root.rstrip("/") + "/"), p)
    return F.array_distinct(F.array(p, F.concat(F.lit("./"), p), win, F.concat(F.lit(".\\"), win), full, F.replace(full, F.lit("/"), F.lit("\\"))))


def drifted(changed: DataFrame, anchors: DataFrame, sources: DataFrame, claims: DataFrame, root: str, now: str, ignored: Sequence[str] = ("terminals/", "agent-tools/", "mcps/", ".tmp_")) -> DataFrame:
    """Claims whose episodes name a changed path: (id, paths)."""
    rows = changed.select(F.col("path"), F.explode(path_variants(F.col("path"), root)).alias("anchor_value"))
    for prefix in ignored:
        rows = rows.filter(~F.startswith("path", F.lit(prefix)))
    hits = rows.join(anchors.filter("anchor_type = 'path'").select("anchor_value", F.col("episode_id").alias("source_episode_id")), "anchor_value").join(sources.select("claim_id", "source_episode_id"), "source_episode_id")
    live = claims.filter((F.col("status") != "expired") & valid_at(now)).select(F.col("id").alias("claim_id"))
    return hits.join(live, "claim_id", "left_semi").groupBy(F.col("claim_id").alias("id")).agg(F.array_sort(F.collect_set("path")).alias("paths"))


# Strings that only trial runs leave in texts and in tags.
TRIAL_TEXTS = ("coding_agent_eval_test", ".tmp_coding_agent_eval", "drift_000", "drift_001", "novelty_eval_test")
TRIAL_TAGS = ("smoke", "test-run")
#: How journals of finished work begin, as patterns over small letters; callers know more of their own.
JOURNAL_OPENERS = (r"completed\b", r"implemented\b", r"final audit\b", r"[\w-]+ v\d+\.\d", r"all \d+ tests pass", r"health check\b")


def hygiene_buckets(episodes: DataFrame, openers: Sequence[str] = JOURNAL_OPENERS) -> DataFrame:
    """First matching bucket of live episodes: temp, exchange, noise_journal, or null.

    Journals are solutions that are empty, or that open with one of `openers` and name neither a problem nor a path.
    """
    # White space counts as one space, so openers of several words are found however they are set.
    low = F.lower(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")))
    opens = low.rlike("^(?:" + "|".join(openers) + ")") if openers else F.lit(False)
    trial = F.lit(False)
    for mark in TRIAL_TEXTS:  # without white space, so the texts are searched as they are
        trial = trial | F.contains(F.lower("content"), F.lit(mark))
    for mark in TRIAL_TAGS:
        trial = trial | F.contains(F.lower(F.array_join("tags", "\n")), F.lit(mark))
    trial = F.coalesce(trial, F.lit(False))
    findable = F.contains(low, F.lit("problem:")) | F.contains(low, F.lit('"problem"')) | F.col("content").rlike(r"(?im)^\s*(issue|error)\s*:") | low.rlike(r"[\w.-]+/[\w.-]+\.\w+")
    journal = (low == "") | (opens & ~findable)
    bucket = F.when(trial, "temp").when(F.col("content_type") == "exchange", "exchange").when((F.col("content_type") == "solution") & journal, "noise_journal")
    return episodes.filter("NOT deleted").withColumn("bucket", bucket)


#: States from the mildest to the gravest, and the state that each type of event leaves a claim in.
GRAVITY = ("active", "challenged", "expired")
STATES = {"create": "active", "update": "active", "correct": "active", "challenged": "challenged", "code_drift_detected": "challenged", "contradiction": "challenged", "expire": "expired", "auto_expired_challenged": "expired"}


def gravity(event_type: Column) -> Column:
    """0 to 2: how grave the state is that an event leaves; null for events that change no state."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (k, GRAVITY.index(v))]), event_type)


def lifecycle_state(events: DataFrame) -> DataFrame:
    """Each claim's state after its last event that changes it (id, last, state, at): active, challenged or expired.

    Of events at one time with one number the gravest counts: what ends a claim, then what casts doubt on it; of equally
    grave ones the one whose type comes last by name. So the state does not depend on the order of rows.
    """
    kinds = events.filter(F.col("event_type").isin(*STATES))
    last = kinds.groupBy(F.col("claim_id").alias("id")).agg(F.max(F.struct("created_at", "n", gravity(F.col("event_type")).alias("gravity"), "event_type")).alias("e"))
    return last.select("id", F.col("e.event_type").alias("last"), F.element_at(F.array(*[F.lit(s) for s in GRAVITY]), F.col("e.gravity") + 1).alias("state"), F.col("e.created_at").alias("at"))
