"""Tables as immutable snapshots: each publish writes new directories, lists them in a manifest, and then moves one pointer."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemolake.operators.scope import DEFAULTS, FIELDS, with_defaults

_S, _T, _D, _I, _B = T.StringType(), T.TimestampType(), T.DoubleType(), T.IntegerType(), T.BooleanType()
_A, _M = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


_SCOPE = dict.fromkeys(FIELDS, _S)
SCHEMAS: dict[str, T.StructType] = {
    "episodes": _struct(id=_S, created_at=_T, updated_at=_T, content=_S, content_type=_S, tags=_A, surprise_score=_D, indexed=_B, access_count=_I, source_session=_S, consolidated=_I, consolidated_at=_T, consolidated_to=_S, deleted=_B, consolidation_attempts=_I, last_consolidation_attempt=_T, protected=_B, **_SCOPE),
    "episode_anchors": _struct(id=_S, episode_id=_S, anchor_type=_S, anchor_value=_S, created_at=_T),
    "vectors": _struct(id=_S, embedding=T.ArrayType(T.FloatType()), tombstoned=_B),
    "knowledge_topics": _struct(id=_S, filename=_S, storage_filename=_S, title=_S, summary=_S, created_at=_T, updated_at=_T, source_episodes=_A, fact_count=_I, access_count=_I, confidence=_D, **_SCOPE),
    "topic_versions": _struct(topic_id=_S, superseded_at=_T, title=_S, summary=_S, content=_S),
    "knowledge_records": _struct(id=_S, topic_id=_S, record_type=_S, content=_M, embedding_text=_S, source_episodes=_A, confidence=_D, created_at=_T, updated_at=_T, access_count=_I, deleted=_B, valid_from=_T, valid_until=_T, **_SCOPE),
    "claims": _struct(id=_S, claim_type=_S, canonical_text=_S, payload=_M, status=_S, confidence=_D, precision_=_D, valid_from=_T, valid_until=_T, created_at=_T, updated_at=_T),
    "claim_edges": _struct(id=_S, from_claim_id=_S, to_claim_id=_S, edge_type=_S, confidence=_D, details=_S, created_at=_T),
    "claim_sources": _struct(id=_S, claim_id=_S, source_episode_id=_S, source_topic_id=_S, source_record_id=_S, created_at=_T),
    "claim_events": _struct(id=_S, claim_id=_S, event_type=_S, details=_S, created_at=_T),
    "contradiction_log": _struct(id=_S, topic_id=_S, old_record_id=_S, new_record_id=_S, old_content=_S, new_content=_S, resolution=_S, reason=_S, detected_at=_T),
    "action_outcomes": _struct(id=_S, action_key=_S, action_summary=_S, outcome_type=_S, summary=_S, details=_S, confidence=_D, provenance=_S, observed_at=_T, created_at=_T, updated_at=_T, **_SCOPE),
    "action_outcome_sources": _struct(id=_S, outcome_id=_S, source_claim_id=_S, source_record_id=_S, source_episode_id=_S, created_at=_T),
    "action_outcome_refs": _struct(id=_S, outcome_id=_S, ref_type=_S, ref_key=_S, ref_value=_S, created_at=_T),
    "tag_cooccurrence": _struct(tag_a=_S, tag_b=_S, count=T.LongType(), last_seen=_T),
    "policy_principals": _struct(id=_S, principal_type=_S, principal_key=_S),
    "access_policies": _struct(id=_S, namespace_slug=_S, project_slug=_S, enabled=_B),
    "policy_acl_entries": _struct(id=_S, policy_id=_S, principal_id=_S, write_mode=_S, read_visibility=_S),
    "consolidation_runs": _struct(id=_S, started_at=_T, completed_at=_T, status=_S, episodes_processed=_I, clusters_formed=_I, clusters_failed=_I),
    "consolidation_reports": _struct(run_id=_S, created_at=_T, report=_S),
    "consolidation_metrics": _struct(run_id=_S, timestamp=_T, clusters_succeeded=_I, clusters_failed=_I, avg_confidence=_D, fast_path_hits=_I, llm_fallbacks=_I),
    "embedding_cache": _struct(namespace=_S, id=_S, hash=_S, embedding=T.ArrayType(T.FloatType())),
    "ingest_log": _struct(batch=_S, id=_S, status=_S, duplicate_of=_S, advice=_A, created_at=_T),
    "drift_impacts": _struct(run_id=_S, claim_id=_S, paths=_A, created_at=_T),
    "access_log": _struct(kind=_S, id=_S, at=_T),
    "vector_centroids": _struct(cell=_I, centroid=T.ArrayType(_D), fitted_on=T.LongType()),
    "vector_cells": _struct(cell=_I, id=_S, embedding=T.ArrayType(T.FloatType()), distance=_D),
    "keyword_postings": _struct(term=_S, id=_S, tf=T.LongType(), length=_I),
    "keyword_lengths": _struct(id=_S, length=_I),
}
#: What makes a row that comes without an id what it is.
_NAMED_BY = {
    "claim_sources": ("claim_id", "source_episode_id", "source_topic_id", "source_record_id"), "claim_events": ("claim_id", "event_type", "details", "created_at"),
    "claim_edges": ("from_claim_id", "to_claim_id", "edge_type"), "contradiction_log": ("topic_id", "old_record_id", "new_record_id", "resolution", "detected_at"),
    "episode_anchors": ("episode_id", "anchor_type", "anchor_value"),
}
#: Tables whose files each hold a range of a column, in order, so that a filter on it reads few of them.
_SORTED_BY = {"keyword_postings": ("term", "id"), "vector_cells": ("cell", "id")}
#: Directories of a table that are read together, at most.
MOST_PARTS = 64
_EMPTY = {"surprise_score": 0.5, "indexed": True, "deleted": False, "protected": False, "consolidated": 0, "consolidation_attempts": 0, "access_count": 0, "confidence": 0.8, "precision_": 1.0, "tombstoned": False}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with just the table's columns and types: missing ones get their defaults, scopes too; others are dropped.

    Rows of links and events that have no id get one from what they say.
    """
    have = set(df.columns)
    cols = []
    for f in SCHEMAS[table]:
        default = F.lit(_EMPTY.get(f.name, DEFAULTS.get(f.name)))
        value = F.coalesce(F.col(f.name), default) if f.name in have and (f.name in _EMPTY or f.name in DEFAULTS) else F.col(f.name) if f.name in have else default
        cols.append(value.cast(f.dataType).alias(f.name))
    out = df.select(*cols)
    if table in _NAMED_BY:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in _NAMED_BY[table]]
        out = out.withColumn("id", F.coalesce("id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)))
    return out


#: What an import brings in: the tables whose rows have ids of their own.
IMPORTED = ("episodes", "episode_anchors", "knowledge_topics", "knowledge_records", "claims", "claim_edges", "claim_sources", "claim_events", "contradiction_log", "action_outcomes", "action_outcome_sources", "action_outcome_refs")


def _fill_scopes(catalog: Catalog) -> dict[str, DataFrame]:
    """Scope columns trimmed, blank ones filled as absent ones are."""
    return {t: with_defaults(catalog.read(t)) for t, s in SCHEMAS.items() if set(FIELDS) <= set(s.names) and catalog.pointer()["tables"].get(t)}


#: What brings a store to a schema version from the one before: the tables to be written again. Columns that a table lacks need no step, reads fill them.
MIGRATIONS: dict[int, Callable[[Catalog], dict[str, DataFrame]]] = {2: _fill_scopes}
SCHEMA_VERSION = max(MIGRATIONS)


class Catalog:
    """A folder of tables. Readers see the snapshot that the pointer names; a failed write leaves it where it was.

    One writer at a time: the pointer is replaced by a rename, but two writers would each drop the other's changes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read_text(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _replace(self, source: str, target: str) -> None:
        """Renames source to target in one step, over what is there: at no time is there no target."""
        jvm = self.spark.sparkContext._jvm
        _, at = self._fs(source)
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(at, self._fs(target)[1], options)

    def _versions(self) -> list[int]:
        """Versions that were current at some time, in order."""
        fs, p = self._fs(f"{self.root}/_pointers")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def pointer(self) -> dict[str, object]:
        """{version, tables: {name: its directories}} of the current snapshot; should the pointer be lost, of the last one noted."""
        raw = self._read_text(f"{self.root}/_current.json")
        if raw is None and (known := self._versions()):
            raw = self._read_text(f"{self.root}/_pointers/{known[-1]}.json")
        return json.loads(raw) if raw else {"version": 0, "tables": {}}

    def _point(self, text: str) -> None:
        """Makes a snapshot current, and then notes it among the versions."""
        self._write_text(f"{self.root}/_next.json", text)
        self._replace(f"{self.root}/_next.json", f"{self.root}/_current.json")
        self._write_text(f"{self.root}/_pointers/{json.loads(text)['version']}.json", text)

    def read(self, table: str) -> DataFrame:
        now = self.pointer()
        if now.get("schema", 1) > SCHEMA_VERSION:
            raise ValueError(f"a store of schema version {now['schema']}; this reads up to {SCHEMA_VERSION}")
        at = now["tables"].get(table)
        if not at:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return conform(self.spark.read.schema(SCHEMAS[table]).parquet(*[f"{self.root}/{x}" for x in at]), table)

    def migrate(self) -> list[int]:
        """Brings the store to this schema, one version after the other, each as one snapshot; the versions gone through."""
        done = []
        while (now := self.pointer())["version"] and now.get("schema", 1) < SCHEMA_VERSION:
            step = now.get("schema", 1) + 1
            self.publish(MIGRATIONS[step](self), schema=step)
            done.append(step)
        return done

    def publish(self, tables: Mapping[str, DataFrame], added: Mapping[str, DataFrame] | None = None, schema: int | None = None) -> int:
        """Writes `tables` whole and the rows `added` beside what their tables hold, and makes all of it current together.

        A new store is of this schema version; others stay at theirs until `migrate`.
        Tables not named stay as they are. A table of more than MOST_PARTS directories is put into one when rows are added.
        """
        now = self.pointer()
        version = max(int(now["version"]), *self._versions(), 0) + 1
        held = {k: list(v) for k, v in now["tables"].items()}
        added = dict(added or {})
        whole = dict(tables)
        for name in [k for k in added if len(held.get(k, ())) >= MOST_PARTS]:
            whole[name] = self.read(name).unionByName(conform(added.pop(name), name))
        for name, df in (*whole.items(), *added.items()):
            at = f"{name}/v{version}-{uuid.uuid4().hex[:8]}"
            rows = conform(df, name)
            if name in _SORTED_BY:
                rows = rows.repartitionByRange(*_SORTED_BY[name]).sortWithinPartitions(*_SORTED_BY[name])
            rows.write.parquet(f"{self.root}/{at}")
            held[name] = [at] if name in whole else [*held.get(name, ()), at]
        schema = schema or (now.get("schema", 1) if now["version"] else SCHEMA_VERSION)
        self._point(json.dumps({"version": version, "schema": schema, "tables": held}))
        return version

    def append(self, tables: Mapping[str, DataFrame]) -> int:
        """Adds rows; what is there is not written again."""
        return self.publish({}, tables)

    @contextlib.contextmanager
    def staged(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Gives a function that writes a table of one run and rereads it; such tables go when the block ends."""
        at = f"{self.root}/_staged/{uuid.uuid4().hex}"

        def stage(df: DataFrame) -> DataFrame:
            path = f"{at}/{uuid.uuid4().hex[:8]}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield stage
        finally:
            fs, p = self._fs(at)
            fs.delete(p, True)

    def at(self, version: int) -> dict[str, list[str]]:
        raw = self._read_text(f"{self.root}/_pointers/{version}.json")
        if raw is None and (now := self.pointer())["version"] == version:
            return now["tables"]
        if raw is None:
            raise ValueError(f"no version {version}")
        return json.loads(raw)["tables"]

    def rollback(self, version: int) -> None:
        """Makes a former version current again; publishes after it take new numbers."""
        raw = self._read_text(f"{self.root}/_pointers/{version}.json")
        self._point(raw or json.dumps(self.pointer() | {"version": version, "tables": self.at(version)}))

    def export(self, path: str, tables: tuple[str, ...] = tuple(SCHEMAS), given: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """A snapshot as JSON, one directory per table, and a manifest of row counts; given: these rows in place of whole tables."""
        rows = []
        for name in tables if given is None else given:
            df = self.read(name) if given is None else given[name]
            df.write.mode("overwrite").json(f"{path}/{name}")
            rows.append((name, df.count(), "1.3"))
        manifest = self.spark.createDataFrame(rows, "entity string, n long, version string")
        manifest.write.mode("overwrite").json(f"{path}/manifest")
        return manifest

    def exported(self, path: str, tables: tuple[str, ...] = IMPORTED) -> dict[str, DataFrame]:
        """The tables of an exported snapshot; refused if one is missing or of a version that this cannot read."""
        known = {r["entity"]: r["version"] for r in self.spark.read.json(f"{path}/manifest").collect()}
        missing = set(tables) - set(known)
        if missing or any(not v.startswith("1.") for v in known.values()):
            raise ValueError(f"not a snapshot this can read: {sorted(missing) or known}")
        return {name: self.spark.read.schema(SCHEMAS[name]).json(f"{path}/{name}") for name in tables}

    def snapshots(self, root: str) -> list[str]:
        """Names of the directories below root, in order."""
        fs, p = self._fs(root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
