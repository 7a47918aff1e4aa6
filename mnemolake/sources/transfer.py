"""A scope's part of a store for export, and the ids under which an exported part comes into another store."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.operators import scope
from mnemolake.sources.catalog import _NAMED_BY, IMPORTED, conform

#: Which tables' ids the columns of a table hold; lists of ids among them.
REFERENCES: dict[str, dict[str, str]] = {
    "episode_anchors": {"episode_id": "episodes"},
    "knowledge_topics": {"source_episodes": "episodes"},
    "knowledge_records": {"topic_id": "knowledge_topics", "source_episodes": "episodes"},
    "claim_edges": {"from_claim_id": "claims", "to_claim_id": "claims"},
    "claim_sources": {"claim_id": "claims", "source_episode_id": "episodes", "source_topic_id": "knowledge_topics", "source_record_id": "knowledge_records"},
    "claim_events": {"claim_id": "claims"},
    "contradiction_log": {"topic_id": "knowledge_topics", "old_record_id": "knowledge_records", "new_record_id": "knowledge_records"},
    "action_outcome_sources": {"outcome_id": "action_outcomes", "source_claim_id": "claims", "source_record_id": "knowledge_records", "source_episode_id": "episodes"},
    "action_outcome_refs": {"outcome_id": "action_outcomes"},
}
#: What makes two rows of one id the same thing.
SAME = {"episodes": ("content", "content_type", *scope.EQUALITY_KEYS), "knowledge_topics": ("filename", *scope.EQUALITY_KEYS), "knowledge_records": ("record_type", "embedding_text"), "claims": ("claim_type", "canonical_text"), "action_outcomes": ("action_key", "outcome_type", "observed_at")}


def scoped(read: Callable[[str], DataFrame], claims: DataFrame, where: Mapping[str, str | None]) -> dict[str, DataFrame]:
    """The rows of one scope: its entities, and the links whose ends are all among them; claims as the caller sees them."""
    own = {t: read(t).filter(scope.equality(where)) for t in ("episodes", "knowledge_topics", "knowledge_records", "action_outcomes")} | {"claims": claims}
    ids = {t: df.select("id") for t, df in own.items()}
    out = dict(own)
    for table in IMPORTED:
        if table in own:
            continue
        rows = read(table)
        for column, of in REFERENCES[table].items():
            # A link may leave an end open; an end that is given has to be there.
            there = ids[of].withColumnRenamed("id", column).distinct().withColumn("__there", F.lit(True))
            rows = rows.join(there, column, "left").filter(F.col(column).isNull() | F.col("__there")).drop("__there")
        out[table] = rows
    return out


def id_map(new: DataFrame, held: DataFrame, table: str, batch: str) -> DataFrame:
    """(old, id, fresh) of an import's rows: the id that each comes under, and whether it has to be added.

    A row that is there already keeps its id; one whose id stands for something else there gets another, the same in every run of the
    batch; topics of one scope and file name are one topic.
    """
    print_of = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit(scope.DEFAULTS.get(c, ""))).alias(c) for c in SAME[table]])), 256)
    a = new.select(F.col("id").alias("old"), print_of.alias("print")).dropDuplicates(["old"])
    b = held.select("id", print_of.alias("there"))
    other = F.concat(F.col("old"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", F.lit(batch), "old", "print"), 256), 1, 12))
    rows = a.join(b, a["old"] == b["id"], "left")
    if table == "knowledge_topics":
        named = b.groupBy("there").agg(F.min("id").alias("named")).withColumnRenamed("there", "print")
        rows = rows.join(named, "print", "left")
        return rows.select("old", F.coalesce("named", F.when(F.col("id").isNull(), F.col("old")).otherwise(other)).alias("new"), F.col("named").isNull().alias("fresh"))
    same = F.coalesce(F.col("there") == F.col("print"), F.lit(False))
    free = F.col("id").isNull()
    moved = rows.select("old", F.when(free | same, F.col("old")).otherwise(other).alias("new"), (~same).alias("fresh"))
    # An import that is repeated finds what it has moved before.
    return moved.join(held.select(F.col("id").alias("new")).distinct().withColumn("__held", F.lit(True)), "new", "left").select("old", "new", (F.col("fresh") & F.col("__held").isNull()).alias("fresh"))


def renamed(rows: DataFrame, table: str, maps: Mapping[str, DataFrame]) -> DataFrame:
    """Rows with their references, and their own id, as the maps have them."""
    columns = rows.columns
    for column, of in REFERENCES.get(table, {}).items():
        m = maps[of].select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        if dict(rows.dtypes)[column].startswith("array"):
            each = rows.select("id", F.posexplode(column).alias("__at", "__old")).join(m, "__old", "left")
            lists = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("__new", "__old").alias("__id")))).alias("__l"))  # one row's own list
            rows = rows.join(lists, "id", "left").withColumn(column, F.coalesce(F.transform("__l", lambda x: x["__id"]), F.col(column))).drop("__l")
        else:
            rows = rows.join(m, rows[column] == m["__old"], "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")
    if table in maps:
        m = maps[table].select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        rows = rows.join(m, rows["id"] == m["__old"], "left").withColumn("id", F.coalesce("__new", "id"))
    return rows.select(*columns)


def incoming(new: Mapping[str, DataFrame], read: Callable[[str], DataFrame], batch: str, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The rows to add to a store that an import brings, by table, under ids that are free in it and with their references after them."""
    maps = {t: stage(id_map(new[t], read(t), t, batch)) for t in SAME}
    out = {}
    for table, rows in new.items():
        held = read(table)
        if table in maps:
            rows = rows.dropDuplicates(["id"]).join(maps[table].filter("fresh").select(F.col("old").alias("id")), "id", "left_semi")
            out[table] = renamed(rows, table, maps)
            continue
        moved = renamed(rows, table, maps)
        if table in _NAMED_BY:
            moved = conform(moved.drop("id"), table)  # named by what it says now
        else:
            changed = maps["action_outcomes"].filter("old <> new").select(F.col("new").alias("outcome_id")).distinct().withColumn("__moved", F.lit(True))
            moved = moved.join(changed, "outcome_id", "left").withColumn("id", F.when(F.col("__moved"), F.concat_ws("-", "outcome_id", "id")).otherwise(F.col("id"))).drop("__moved")
        out[table] = moved.dropDuplicates(["id"]).join(held.select("id"), "id", "left_anti").select(*held.columns)
    return out
