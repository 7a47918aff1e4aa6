"""The engine: one object over a catalog that stores, recalls, checks and consolidates."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.config import DEFAULTS, EngineConfig
from mnemolake.functions.text import action_key, anchors_udf, claim_id, embedding_text, record_text, shape_warnings
from mnemolake.hooks import Hooks
from mnemolake.operators import consolidate as co
from mnemolake.operators import evidence, extraction, keyword, lifecycle, reads, recall, scope, temporal, trust, vector_index, vectors
from mnemolake.sources import markdown, transfer
from mnemolake.sources.catalog import SCHEMAS, Catalog, conform
from mnemolake.sources.embeddings import HashEncoder, WordHashEncoder, encode, incremental

CONTENT_TYPES = ("exchange", "fact", "solution", "preference", "procedure")
T = TypeVar("T")
OUTCOMES = ("success", "partial_success", "failure", "reverted", "superseded")


class MemoryEngine:
    """Reads return DataFrames and change nothing; writes publish one snapshot each. Times are always given."""

    def __init__(self, spark: SparkSession, root: str, config: EngineConfig = DEFAULTS, encoder: HashEncoder | None = None, owner: scope.Scope | None = None, model: extraction.Model | None = None):
        self.spark, self.catalog, self.config, self.model = spark, Catalog(spark, root), config, model
        self.encoder, self.scope, self.hooks = encoder or WordHashEncoder(config.dim), owner or scope.Scope(), Hooks()

    def _read(self, table: str, where: object = None) -> DataFrame:
        df = self.catalog.read(table)
        held = scope.coerce(where) if where is not None else self.scope
        return df.filter(scope.equality(held.read_filter())) if "namespace_slug" in df.columns else df

    def _own(self, table: str) -> DataFrame:
        """What the caller may change."""
        return self.catalog.read(table).filter(scope.equality(self.scope.mutation_filter()))

    def _claims(self, where: object = None, own: bool = False) -> DataFrame:
        """Claims all of whose sources the caller may read, or change."""
        held = scope.coerce(where) if where is not None else self.scope
        c = self.catalog
        sources = scope.source_scopes(c.read("claim_sources"), c.read("episodes"), c.read("knowledge_records"), c.read("knowledge_topics"), scope.EQUALITY_KEYS)
        return scope.claims_in_scope(c.read("claims"), sources, held.mutation_filter() if own else held.read_filter())

    def _scoped(self, df: DataFrame) -> DataFrame:
        return df.withColumns({k: F.lit(v).cast("string") for k, v in self.scope.mutation_filter().items()})

    def _coded(self, namespace: str, rows: DataFrame) -> DataFrame:
        """(id, embedding) of (id, text): kept vectors where the text is as it was, others encoded anew."""
        cache = self.catalog.read("embedding_cache").filter(F.col("namespace") == namespace)
        return incremental(rows, cache, self.encoder).select("id", "embedding")

    def warm_up(self) -> int:
        """Keeps the vectors of all topics, records and claims as they are now, for the recalls to come; how many there are."""
        texts = {"topics": self.catalog.read("knowledge_topics").select("id", _topic_text().alias("text")), "records": self.catalog.read("knowledge_records").filter("NOT deleted").select("id", F.col("embedding_text").alias("text")), "claims": self.catalog.read("claims").select("id", _claim_text().alias("text"))}
        held = self.catalog.read("embedding_cache")
        rows = [incremental(df, held.filter(F.col("namespace") == n), self.encoder).withColumn("namespace", F.lit(n)) for n, df in texts.items()]
        self.catalog.publish({"embedding_cache": rows[0].unionByName(rows[1]).unionByName(rows[2])})
        return self.catalog.read("embedding_cache").count()

    # --- episodes

    def ingest(self, episodes: DataFrame, now: str) -> DataFrame:
        """Stores episodes (content, and content_type, tags, surprise_score if given).

        Returns for every row given (id, status, duplicate_of, advice): stored; known, if its scope, type and content are
        there already; duplicate, if its text is nearer than the dedup bound to a stored one of the scope or to one
        before it in the batch. advice says what will make a solution hard to find.
        """
        self.scope.require_write()
        have = set(episodes.columns)
        rows = episodes.withColumns({"content_type": F.coalesce("content_type", F.lit("exchange")) if "content_type" in have else F.lit("exchange"), "tags": F.coalesce("tags", F.array().cast("array<string>")) if "tags" in have else F.array().cast("array<string>")})
        key = F.concat_ws("|", *[F.lit(v or "") for v in self.scope.mutation_filter().values()], "content_type", "content")
        batch, t = uuid.uuid4().hex, temporal.instant(now)
        with self.catalog.staged() as stage:
            rows = stage(rows.withColumns({"id": F.substring(F.sha2(key, 256), 1, 32), "row": F.monotonically_increasing_id()}))
            if not rows.filter(~F.col("content_type").isin(*CONTENT_TYPES) | (F.trim(F.coalesce("content", F.lit(""))) == "")).isEmpty():
                raise ValueError(f"episodes need content and a content_type of {CONTENT_TYPES}")
            first = rows.groupBy("id").agg(F.min("row").alias("row"))
            stored = self.catalog.read("episodes").select("id")
            fresh = rows.join(first.select("row"), "row", "left_semi").join(stored, "id", "left_anti").withColumn("text", F.pandas_udf(_embedding_texts, "string")("content", "content_type", "tags"))
            coded = stage(fresh.join(encode(fresh, self.encoder), "id"))
            if not coded.filter(~vectors.valid(F.col("embedding"), self.encoder.dim)).isEmpty():
                raise ValueError(f"the encoder gave vectors that are not {self.encoder.dim} finite numbers")
            vector_table = self.catalog.read("vectors").filter("NOT tombstoned").join(self._own("episodes").filter("NOT deleted").select("id"), "id", "left_semi")
            near = vectors.nearest_duplicates(coded, vector_table, self.config.dedup_similarity)
            inside = vectors.greedy_dedup(coded.join(near, "id", "left_anti").withColumn("batch", F.lit(batch)), ["batch"], "row", self.config.dedup_similarity)
            refused = stage(near.unionByName(inside.filter("duplicate_of IS NOT NULL")))
            kept = coded.join(refused, "id", "left_anti")
            stamped = kept.withColumns({k: F.coalesce(F.col(k).cast("timestamp"), t) if k in have else t for k in ("created_at", "updated_at")})
            pairs = reads.tag_pairs(stamped).unionByName(self.catalog.read("tag_cooccurrence")).groupBy("tag_a", "tag_b").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))
            anchored = stamped.select(F.col("id").alias("episode_id"), F.explode(anchors_udf()("content")).alias("a")).select("episode_id", "a.anchor_type", "a.anchor_value", t.alias("created_at"))
            told = rows.join(first.withColumnRenamed("row", "first"), "id").join(refused, "id", "left").join(stored.distinct().withColumn("there", F.lit(True)), "id", "left")
            again = F.col("row") != F.col("first")
            status = F.when(F.col("there"), "known").when(F.col("duplicate_of").isNotNull() | again, "duplicate").otherwise("stored")
            same = F.when(F.col("there") | again, F.col("id"))
            log = told.select(F.lit(batch).alias("batch"), "id", status.alias("status"), F.coalesce("duplicate_of", same).alias("duplicate_of"), F.pandas_udf(_advice, "array<string>")("content", "content_type").alias("advice"), t.alias("created_at"))
            postings, lengths = keyword.term_tables(kept)
            self.catalog.publish({"tag_cooccurrence": pairs}, {"episodes": self._scoped(stamped), "vectors": kept, "episode_anchors": anchored, "keyword_postings": postings, "keyword_lengths": lengths, "ingest_log": log, **self._celled(kept)})
        result = self.catalog.read("ingest_log").filter(F.col("batch") == batch).select("id", "status", "duplicate_of", "advice")
        self.hooks.fire("store", count=result.filter("status = 'stored'").count())
        return result

    def recall(self, query: recall.RecallQuery | str, now: str | None = None, where: object = None) -> dict[str, DataFrame]:
        """A DataFrame per section asked for: episodes, topics, records, claims.

        Episodes that the best records are made of are left out where both are asked for. Records weigh by their claims'
        precision, and say if they are unsure or their topic has lately been contradicted; claims come with those that contradict them.
        """
        q = query if isinstance(query, recall.RecallQuery) else recall.RecallQuery(query, now or "")
        vec = self.encoder.encode([q.text])[0].tolist()
        sim = lambda kind, rows, text: self._coded(kind, rows.select("id", text.alias("text"))).select("id", vectors.dot(F.col("embedding"), vectors.literal(vec)).alias("similarity"))
        as_of = q.as_of or q.now
        out = {}
        named = recall.entity_links(q.entity, self.catalog.read("episode_anchors"), self.catalog.read("claim_sources"), self._claims(where)) if q.entity else {}
        if "episodes" in q.sections:
            out["episodes"] = recall.episodes_section(self._read("episodes", where), self.catalog.read("vectors"), vec, q, self.catalog.read("tag_cooccurrence"), named.get("episodes"), config=self.config, keywords=self._keywords, nearest=self._nearest)
        if "topics" in q.sections:
            topics = self._read("knowledge_topics", where)
            out["topics"] = recall.topics_section(topics, sim("topics", topics, _topic_text()), q, self.config)
        if "records" in q.sections:
            records = self._read("knowledge_records", where).filter("NOT deleted").filter(temporal.valid_at(as_of))
            links = self.catalog.read("claim_sources").filter("source_record_id IS NOT NULL").select(F.col("source_record_id").alias("id"), "claim_id")
            precise = links.join(self.catalog.read("claims").select(F.col("id").alias("claim_id"), "precision_"), "claim_id").groupBy("id").agg(F.min("precision_").alias("precision_"))
            found = recall.records_section(records.join(precise, "id", "left"), sim("records", records, F.col("embedding_text")), q, self.config, linked=named.get("records"))
            lately = self.catalog.read("contradiction_log").filter(F.col("detected_at").between(temporal.instant(as_of) - F.expr("INTERVAL 30 DAYS"), temporal.instant(as_of)))
            out["records"] = recall.uncertainty(found, lately.select("topic_id"))
            if "episodes" in out:
                out["episodes"] = recall.without_covered(out["episodes"], found).orderBy(F.desc("score"), "id")
        if "claims" in q.sections:
            claims = self.search_claims(q.text, as_of, 15, where, q.entity, named.get("claims"))
            rivals = recall.partners(self.catalog.read("claim_edges"), self._claims(where), claims).groupBy("id").agg(F.array_sort(F.collect_set("partner")).alias("contradicted_by"))
            out["claims"] = claims.join(rivals, "id", "left").orderBy(F.desc("relevance"), F.desc("updated_at"), "id")
        self.hooks.fire("recall", query=q.text)
        return out

    def recall_within(self, query: recall.RecallQuery | str, seconds: float, now: str | None = None, where: object = None) -> tuple[dict[str, DataFrame], list[str]]:
        """Sections of `recall` one after the other until the time is over, as tables that are there, and what was left out.

        Episodes have three quarters of what is left; if that is not enough, or their vectors fail, they are found by words alone in the
        rest. A section whose time runs out is stopped on the cluster. Each section stands for itself: episodes that records cover are not left out.
        """
        q = query if isinstance(query, recall.RecallQuery) else recall.RecallQuery(query, now or "")
        began, out, left_out = time.monotonic(), {}, []
        left = lambda: seconds - (time.monotonic() - began)
        for section in q.sections:
            if left() <= 0:
                left_out.append(f"{section}: left out, the time is over")
                continue
            full = lambda section=section: self.recall(replace(q, sections=(section,)), where=where)[section].toArrow()  # noqa: E731  50 rows at most
            rows, why = within(self.spark, full, left() * (0.75 if section == "episodes" else 1.0))
            if rows is None and section == "episodes":
                kept = recall.filtered(self._read("episodes", where), q)
                words = lambda kept=kept: self._keywords(kept, q.text, q.n_results).join(kept, "id").withColumn("score", F.col("keyword")).orderBy(F.desc("score"), "id").toArrow()
                left_out.append(f"episodes: by words alone ({why})")
                rows, why = within(self.spark, words, max(0.0, left()))
            if rows is None:
                left_out.append(f"{section}: left out ({why})")
            else:
                out[section] = self.spark.createDataFrame(rows)
        return out, left_out

    def _cells(self) -> vector_index.Cells | None:
        """The vector index's centroids and radii; None if there is no index yet."""
        rows = sorted(self.catalog.read("vector_centroids").select("cell", "centroid").collect())  # a row for each cell
        return vector_index.cells_of(self.catalog.read("vector_cells"), np.array([r["centroid"] for r in rows])) if rows else None

    def _nearest(self, ids: DataFrame, vector: Sequence[float], k: int) -> DataFrame:
        """The k nearest of ids: by the index if there is one, with what it does not hold compared beside it, else by comparing all."""
        live = self.catalog.read("vectors").filter("NOT tombstoned")
        cells = self._cells()
        if cells is None or cells.centroids.shape[1] != len(vector):
            return vectors.top_k(live.join(ids, "id", "left_semi"), vector, k)
        rows = self.catalog.read("vector_cells")
        found = vector_index.nearest(rows, cells, vector, k, self.config.index_probes, among=live.select("id").join(ids, "id", "left_semi"))
        outside = live.select("id").join(ids, "id", "left_semi").join(rows.select("id"), "id", "left_anti")
        if outside.isEmpty():
            return found
        beside = vectors.top_k(live.join(outside, "id", "left_semi"), vector, k)
        return found.unionByName(beside).orderBy(F.desc("similarity"), "id").limit(k)

    def _indexed(self, live: DataFrame) -> dict[str, DataFrame]:
        """The index's tables over live vectors, fitted anew."""
        centres = vector_index.centroids(live)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
        held = self.spark.createDataFrame(rows, "cell int, centroid array<double>").withColumn("fitted_on", F.lit(live.count()).cast("long"))
        return {"vector_centroids": held, "vector_cells": vector_index.assigned(live, centres) if rows else self.spark.createDataFrame([], SCHEMAS["vector_cells"])}

    def _celled(self, new: DataFrame) -> dict[str, DataFrame]:
        """What new vectors (id, embedding) add to the index, if there is one."""
        centres = sorted(self.catalog.read("vector_centroids").select("cell", "centroid").collect())  # a row for each cell
        return {"vector_cells": vector_index.assigned(new, np.array([r["centroid"] for r in centres]))} if centres else {}

    def build_index(self) -> int:
        """Fits the vector index to all live vectors; how many it holds. `ingest` adds to it from then on."""
        self.scope.require_write()
        self.catalog.publish(self._indexed(self.catalog.read("vectors").filter("NOT tombstoned")))
        return self.catalog.read("vector_cells").count()

    def index_status(self) -> dict[str, object]:
        """none, small (a scan will do), stale (the store has outgrown what it was fitted on, or much in it is gone) or ready."""
        fitted = self.catalog.read("vector_centroids").agg(F.max("fitted_on")).first()[0]
        live = self.catalog.read("vectors").filter("NOT tombstoned").select("id")
        held = self.catalog.read("vector_cells").select("id")
        n, out = live.count(), {"live": live.count(), "indexed": held.join(live, "id", "left_semi").count(), "gone": held.join(live, "id", "left_anti").count()}
        grown = fitted is not None and n > self.config.index_refit * fitted
        state = ("none" if n >= self.config.index_from else "small") if fitted is None else "stale" if grown or out["gone"] > self.config.compact_ratio * max(1, out["indexed"] + out["gone"]) else "ready"
        return out | {"state": state}

    def _keywords(self, docs: DataFrame, query: str, k: int) -> DataFrame:
        """The k best of docs by the query's words, from the kept index and what it does not know yet."""
        return keyword.search_index(self.catalog.read("keyword_postings"), self.catalog.read("keyword_lengths"), docs, query, k)

    def reindex_keywords(self) -> int:
        """Builds the keyword index anew from all live episodes; how many there are. Deleted and pruned ones leave it."""
        self.scope.require_write()
        self.catalog.publish(self._keyword_tables(self.catalog.read("episodes")))
        return self.catalog.read("keyword_lengths").count()

    @staticmethod
    def _keyword_tables(episodes: DataFrame) -> dict[str, DataFrame]:
        postings, lengths = keyword.term_tables(episodes.filter("NOT deleted AND consolidated <> 2"))
        return {"keyword_postings": postings, "keyword_lengths": lengths}

    def keyword_coverage(self) -> dict[str, int]:
        """Live episodes, how many of them the keyword index knows, and what it holds of others (until `compact`)."""
        live = self.catalog.read("episodes").filter("NOT deleted").select("id")
        held = self.catalog.read("keyword_lengths").select("id")
        return {"live": live.count(), "indexed": live.join(held, "id", "left_semi").count(), "stale": held.join(live, "id", "left_anti").count()}

    def search(self, query: str | None = None, where: object = None, **filters: object) -> DataFrame:
        return reads.search_episodes(self._read("episodes", where), query, **filters)

    def forget(self, ids: DataFrame, now: str) -> int:
        """Deletes the caller's episodes among ids, with all that follows for claims."""
        self.scope.require_write()
        own = self._own("episodes").filter("NOT deleted").join(ids.select("id"), "id", "left_semi").select("id")
        n = own.count()
        c = {t: self.catalog.read(t) for t in ("episodes", "vectors", "claims", "claim_sources")}
        new = lifecycle.forget(c["episodes"], c["vectors"], c["claims"], c["claim_sources"], own, now)
        self.catalog.publish(new, {"claim_events": new.pop("claim_events")})
        self.hooks.fire("forget", count=n)
        return n

    def restore(self, ids: DataFrame, now: str) -> int:
        """Brings the caller's softly deleted episodes among ids back, with their vectors; claims that ended with them stay ended."""
        self.scope.require_write()
        own = self._own("episodes").filter("deleted").join(ids.select("id"), "id", "left_semi").select("id")
        n = own.count()
        episodes, held = self.catalog.read("episodes"), self.catalog.read("vectors")
        self.catalog.publish({"episodes": lifecycle.restore(episodes, own, now), "vectors": lifecycle.update(held, own, {"tombstoned": F.lit(False)})})
        return n

    def hard_delete(self, ids: DataFrame, now: str) -> int:
        """Removes the caller's episodes among ids, deleted before or not, and all that is kept of them; claims follow as with `forget`."""
        self.scope.require_write()
        own = self._own("episodes").join(ids.select("id"), "id", "left_semi").select("id")
        n = own.count()
        c = {t: self.catalog.read(t) for t in ("episodes", "vectors", "claims", "claim_sources")}
        new = lifecycle.forget(c["episodes"], c["vectors"], c["claims"], c["claim_sources"], own, now)
        events = new.pop("claim_events")
        held = {"episodes": (new["episodes"], "id"), "vectors": (new["vectors"], "id")} | {t: (self.catalog.read(t), k) for t, k in (("episode_anchors", "episode_id"), ("keyword_postings", "id"), ("keyword_lengths", "id"), ("vector_cells", "id"))}
        self.catalog.publish(new | lifecycle.hard_delete(held, own), {"claim_events": events})
        self.hooks.fire("forget", count=n)
        return n

    def protect(self, ids: DataFrame | None = None, tag: str | None = None) -> int:
        """Marks the caller's episodes among ids, or with a tag; how many."""
        self.scope.require_write()
        own = self._own("episodes").filter("NOT deleted")
        hit = own.filter(F.array_contains("tags", tag)).select("id") if tag else own.join(ids.select("id"), "id", "left_semi").select("id")
        n = hit.count()
        self.catalog.publish({"episodes": lifecycle.update(self.catalog.read("episodes"), hit, {"protected": F.lit(True)})})
        return n

    # --- claims and outcomes

    def _evidence(self, claims: DataFrame, as_of: str, more: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """Claims with what is known for and against them; more: rows that a change in the making adds to tables."""
        more = more or {}
        read = lambda t: self.catalog.read(t).unionByName(conform(more[t], t)) if t in more else self.catalog.read(t)
        links = read("action_outcome_sources").filter("source_claim_id IS NOT NULL").select("outcome_id", F.col("source_claim_id").alias("claim_id")).distinct()
        outcomes = read("action_outcomes").withColumnRenamed("id", "outcome_id").join(links, "outcome_id")
        return evidence.assemble(temporal.claims_as_of(claims, read("claim_events"), as_of), evidence.outcome_evidence(outcomes, as_of), evidence.event_evidence(read("claim_events"), as_of), evidence.source_evidence(read("claim_sources"), self.catalog.read("episode_anchors")))

    def _with_precision(self, claims: DataFrame, ids: DataFrame, now: str, more: Mapping[str, DataFrame] | None = None) -> DataFrame:
        """claims with the precision of those among ids as their evidence has it now; only these are looked at."""
        touched = claims.join(ids.select("id").distinct(), "id", "left_semi")
        new = self._evidence(touched, now, more).select("id", trust.precision().alias("p"))
        return claims.join(new, "id", "left").withColumn("precision_", F.coalesce("p", "precision_")).select(*claims.columns)

    def browse_claims(self, as_of: str, claim_type: str | None = None, limit: int = 50, where: object = None) -> DataFrame:
        if not 1 <= limit <= 200:
            raise ValueError("limit must be 1 to 200")
        rows = trust.with_reuse(trust.with_reliability(self._evidence(self._claims(where), as_of), as_of), as_of)
        return (rows if claim_type is None else rows.filter(F.col("claim_type") == claim_type)).orderBy(F.desc("updated_at"), "id").limit(limit)

    def search_claims(self, query: str, as_of: str, limit: int = 50, where: object = None, entity: str | None = None, linked: DataFrame | None = None) -> DataFrame:
        """Claims by relevance; those that an entity names (`linked`, its claims' ids) come first and are never below the threshold."""
        if not 1 <= limit <= 200:
            raise ValueError("limit must be 1 to 200")
        vec = self.encoder.encode([query])[0].tolist()
        rows = trust.with_reliability(self._evidence(self._claims(where), as_of), as_of)
        text = _claim_text()
        sims = self._coded("claims", rows.select("id", text.alias("text"))).select("id", vectors.dot(F.col("embedding"), vectors.literal(vec)).alias("semantic"))
        rows = rows.join(sims, "id").withColumn("keyword", keyword.share_of_words(query, text)).withColumn("phrase", F.contains(F.lower(text), F.lit(query.lower())).cast("double"))
        score = trust.claim_rank(F.col("semantic"), F.col("keyword"), F.col("phrase"), as_of, precision_=F.col("precision_"))
        rows = rows.withColumn("relevance", score)
        lexical, named = (F.col("keyword") > 0) | (F.col("phrase") > 0), F.lit(False)
        if entity:
            rows = recall.boosted(rows, rows.select("id").limit(0) if linked is None else linked, "relevance", entity, text)
            named = F.col("linked")
        # A claim below the threshold stays if it has the query's words (at 0.08 at least) or is named by the entity.
        low = F.col("relevance") < self.config.claim_threshold
        rows = rows.filter(~low | lexical | named).withColumn("relevance", F.when(low & lexical, F.greatest("relevance", F.lit(0.08))).otherwise(F.col("relevance")))
        return rows.orderBy(F.desc("relevance"), F.desc("updated_at"), "id").limit(limit)

    def record_outcome(self, summary: str, outcome_type: str, now: str, claim_ids: Sequence[str] = (), episode_ids: Sequence[str] = (), refs: Sequence[tuple[str, str, str]] = (), confidence: float = 0.8, provenance: str = "{}") -> str:
        """One observed outcome with its links, and the linked claims' precision, all published together.

        Sources are the caller's own claims and episodes.
        """
        self.scope.require_write()
        if outcome_type not in OUTCOMES:
            raise ValueError(f"outcome_type must be one of {OUTCOMES}")
        claim_ids, episode_ids = id_tokens(claim_ids), id_tokens(episode_ids)
        if not claim_ids and not episode_ids:
            raise ValueError("an outcome needs a source")
        for name, ids, rows in (("claims", claim_ids, self._claims(own=True)), ("episodes", episode_ids, self._own("episodes"))):
            wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
            if ids and not reads.by_ids(rows, wanted, missing=True).isEmpty():
                raise ValueError(f"{name} that are unknown, or not the caller's")
        key = action_key(summary)
        own = f"out_{hashlib.sha256(f'{key}|{outcome_type}|{now}|{claim_ids}|{episode_ids}'.encode()).hexdigest()[:32]}"
        one = self.spark.createDataFrame([(own, key, summary, outcome_type, float(confidence), provenance)], "id string, action_key string, action_summary string, outcome_type string, confidence double, provenance string").withColumn("observed_at", temporal.instant(now))
        links = self.spark.createDataFrame([(f"{own}-{i}", own, c, e) for i, (c, e) in enumerate([(c, None) for c in claim_ids] + [(None, e) for e in episode_ids])], "id string, outcome_id string, source_claim_id string, source_episode_id string")
        held = self.spark.createDataFrame([(f"{own}-r{i}", own, *r) for i, r in enumerate(refs)], "id string, outcome_id string, ref_type string, ref_key string, ref_value string")
        added = {"action_outcomes": self._scoped(one), "action_outcome_sources": links, "action_outcome_refs": held}
        touched = links.filter("source_claim_id IS NOT NULL").select(F.col("source_claim_id").alias("id"))
        changed = {"claims": self._with_precision(self.catalog.read("claims"), touched, now, {k: added[k] for k in ("action_outcomes", "action_outcome_sources")})} if claim_ids else {}
        self.catalog.publish(changed, added)
        return own

    def browse_outcomes(self, limit: int = 50) -> DataFrame:
        if not 1 <= limit <= 200:
            raise ValueError("limit must be 1 to 200")
        links = self.catalog.read("action_outcome_sources").groupBy(F.col("outcome_id").alias("id")).agg(F.array_sort(F.collect_set("source_claim_id")).alias("claims"), F.array_sort(F.collect_set("source_episode_id")).alias("episodes"))
        refs = self.catalog.read("action_outcome_refs").groupBy(F.col("outcome_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("ref_type", "ref_key", "ref_value"))).alias("refs"))
        return self._read("action_outcomes").join(links, "id", "left").join(refs, "id", "left").orderBy(F.desc("observed_at"), F.desc("created_at"), "id").limit(limit)

    def detect_drift(self, paths: DataFrame, now: str, root: str = "/") -> DataFrame:
        """Challenges the caller's active claims whose sources name a changed path; returns (id, paths), kept as the run's impacts."""
        self.scope.require_write()
        c = {t: self.catalog.read(t) for t in ("episode_anchors", "claim_sources", "claims")}
        own = self._claims(own=True)
        run = uuid.uuid4().hex
        with self.catalog.staged() as stage:
            hit = stage(lifecycle.drifted(paths, c["episode_anchors"], c["claim_sources"], own, root, now))
            claims, events = lifecycle.challenge(c["claims"], hit, now, "code_drift_detected")
            events = events.unionByName(lifecycle.event(events.select(F.col("claim_id").alias("id")), "challenged", now))
            claims = self._with_precision(claims, hit, now, {"claim_events": events})
            self.catalog.publish({"claims": claims}, {"claim_events": events, "drift_impacts": hit.select(F.lit(run).alias("run_id"), F.col("id").alias("claim_id"), "paths", temporal.instant(now).alias("created_at"))})
        return self.catalog.read("drift_impacts").filter(F.col("run_id") == run).select(F.col("claim_id").alias("id"), "paths")

    # --- knowledge

    def consolidate(self, now: str) -> dict[str, int]:
        """One run over the pending episodes of all scopes, each scope's on their own.

        Clusters that rules can read become topics of their scope or are merged into those that are there; topics, their
        versions, records, claims with sources and events, contradictions with edges, the run and its report are published together.
        """
        self.scope.require_write()
        self.hooks.fire("consolidation_start")
        t, read = temporal.instant(now), self.catalog.read
        run = f"run-{now}"
        with self.catalog.staged() as stage:
            got = co.consolidate(scope.with_defaults(read("episodes")), read("vectors"), scope.EQUALITY_KEYS, now, claims=read("claims"), config=self.config, model=self.model, stage=stage)
            members, clusters, records, told = got["members"].drop("embedding"), stage(got["clusters"]), got["records"], got["told"]
            drafted = co.drafts(records, members, clusters, told)
            topics = read("knowledge_topics")
            placed = stage(drafted.join(co.assign_topics(drafted, topics, self.encoder, self.config), "cluster"))
            new = co.merge_into_topics(placed, records, topics, read("knowledge_records"), now)
            added = stage(new["added"])
            ended = stage(new["ended"])
            claims, known = read("claims"), read("claims").select("id")
            fresh = conform(got["claims"].withColumn("created_at", t), "claims").join(known, "id", "left_anti")
            events = stage(new["claim_events"].unionByName(lifecycle.event(fresh.select("id"), "create", now)))
            sources = records.join(placed.select("cluster", "topic_id", F.explode("source_episodes").alias("source_episode_id")), "cluster").join(added.select("topic_id", "claim_id", F.col("id").alias("source_record_id")), ["topic_id", "claim_id"], "left").select("claim_id", "source_episode_id", F.col("topic_id").alias("source_topic_id"), "source_record_id", t.alias("created_at")).distinct()
            sources = stage(conform(sources, "claim_sources").join(read("claim_sources").select("id"), "id", "left_anti"))
            claims = lifecycle.expire(claims.unionByName(fresh), stage(new["expired_claims"]), now)
            touched = events.filter("event_type = 'contradiction'").select(F.col("claim_id").alias("id"))
            claims = self._with_precision(claims, touched, now, {"claim_events": events, "claim_sources": sources})
            kept = lifecycle.update(read("knowledge_records"), ended, {"valid_until": F.least(F.coalesce(F.col("valid_until"), t), t), "updated_at": t})
            counts = {"records": added.count(), "clusters": placed.count(), "topics_created": placed.filter("NOT known").select("topic_id").distinct().count(), "topics_updated": placed.filter("known").select("topic_id").distinct().count(), "contradictions": ended.count()}
            asked = told.agg(F.count_if(F.col("records").isNotNull()).alias("told"), F.count_if(F.col("tried") & F.col("records").isNull()).alias("refused"), F.count_if(~F.col("tried")).alias("not_asked"), F.count_if(F.size("faults") > 0).alias("faulty"), F.coalesce(F.sum("calls"), F.lit(0)).alias("calls")).first() if told is not None else None
            counts |= {f"model_{k}": v for k, v in asked.asDict().items()} if asked else {}
            formed = clusters.select("cluster").distinct().count()
            report = self.spark.createDataFrame([(run, json.dumps(counts | {"clusters_formed": formed}, sort_keys=True))], "run_id string, report string").withColumn("created_at", t)
            row = report.select(F.col("run_id").alias("id"), t.alias("started_at"), t.alias("completed_at"), F.lit("completed").alias("status"), F.lit(members.count()).alias("episodes_processed"), F.lit(formed).alias("clusters_formed"), F.lit(formed - counts["clusters"]).alias("clusters_failed"))
            metrics = report.select("run_id", t.alias("timestamp"), F.lit(counts["clusters"]).alias("clusters_succeeded"), F.lit(formed - counts["clusters"]).alias("clusters_failed"), F.lit(counts["clusters"] - counts.get("model_told", 0)).alias("fast_path_hits"), F.lit(counts.get("model_told", 0)).alias("llm_fallbacks"))
            self.catalog.publish(
                {"knowledge_topics": new["knowledge_topics"], "knowledge_records": kept.unionByName(conform(added, "knowledge_records")), "claims": claims, "episodes": got["episodes"], "topic_versions": self._kept_versions(new["topic_versions"])},
                {"claim_sources": sources, "claim_events": events, "contradiction_log": new["contradiction_log"], "claim_edges": new["claim_edges"], "consolidation_runs": row, "consolidation_metrics": metrics, "consolidation_reports": report},
            )
        self.warm_up()
        self.hooks.fire("consolidation_complete", records=counts["records"])
        return counts

    def compact(self, now: str, days: int | None = None) -> None:
        """Prunes old consolidated episodes and drops marked vectors, and both from the kept indexes."""
        episodes, rest = co.prune(self.catalog.read("episodes"), self.catalog.read("vectors"), now, days or self.config.prune_days)
        live = episodes.filter("NOT deleted AND consolidated <> 2").select("id")
        held = {t: self.catalog.read(t).join(live, "id", "left_semi") for t in ("keyword_postings", "keyword_lengths", "vector_cells")}
        self.catalog.publish({"episodes": episodes, "vectors": rest.filter("NOT tombstoned"), **held})
        self.hooks.fire("prune")

    def reindex(self) -> int:
        """Encodes every live episode of all scopes anew, as after a change of encoder; how many there are.

        The vectors take the place of all that were there, and the episodes count as indexed, in one snapshot: a reader sees
        the old vectors or the new ones. Deleted episodes lose theirs.
        """
        self.scope.require_write()
        episodes = self.catalog.read("episodes")
        live = episodes.filter("NOT deleted").withColumn("text", F.pandas_udf(_embedding_texts, "string")("content", "content_type", "tags"))
        marked = episodes.withColumn("indexed", F.col("indexed") | ~F.col("deleted"))
        with self.catalog.staged() as stage:
            coded = stage(encode(live, self.encoder))
            index = self._indexed(coded) if self._cells() is not None else {}
            self.catalog.publish({"vectors": coded, "episodes": marked, **self._keyword_tables(episodes), **index})
        self.warm_up()
        return self.catalog.read("vectors").count()

    def browse(self) -> DataFrame:
        topics = self._read("knowledge_topics").select(F.col("id").alias("topic_id"), "title", "summary", "confidence")
        n = self._read("knowledge_records").filter("NOT deleted").groupBy("topic_id").pivot("record_type", list(markdown.SECTIONS)).count().fillna(0)
        return n.join(topics, "topic_id", "left")

    def read_topic(self, topic_id: str) -> DataFrame:
        return markdown.topic_lines(self._read("knowledge_records").filter((F.col("topic_id") == topic_id) & ~F.col("deleted")))

    def topic_as_of(self, topic_id: str, as_of: str) -> DataFrame:
        """What a topic said at a time before its last change (title, summary, content); no row if it has not changed since."""
        own = self._read("knowledge_topics").filter(F.col("id") == topic_id).select(F.col("id").alias("topic_id"))
        return markdown.version_as_of(self.catalog.read("topic_versions").join(own, "topic_id", "left_semi"), temporal.instant(as_of))

    def correct(self, topic_id: str, text: str, now: str) -> int:
        """Replaces the records of one of the caller's topics by those of an edited markdown text; the old ones end now.

        Claims follow: the new records' are linked to them, and claims that nothing else supports end.
        """
        self.scope.require_write()
        topic = self._own("knowledge_topics").filter(F.col("id") == topic_id)
        if topic.isEmpty():
            raise ValueError("a topic that is unknown, or not the caller's")
        new, t, read = markdown.parse(text), temporal.instant(now), self.catalog.read
        rows, sources, claims = read("knowledge_records"), read("claim_sources"), read("claims")
        old = rows.filter((F.col("topic_id") == topic_id) & F.col("valid_until").isNull() & ~F.col("deleted"))
        ended = lifecycle.update(rows, old.select("id"), {"valid_until": t, "updated_at": t})
        kind = "id string, topic_id string, record_type string, content map<string,string>, embedding_text string, claim_id string"
        made = self.spark.createDataFrame([(hashlib.sha256(f"{topic_id}|{claim_id(r['type'], r)}|{now}".encode()).hexdigest()[:32], topic_id, r["type"], r, record_text(r), claim_id(r["type"], r)) for r in new], kind).withColumns({"created_at": t, "updated_at": t, "valid_from": t})
        made = made.join(topic.select(F.col("id").alias("topic_id"), *scope.FIELDS), "topic_id").withColumn("claim_id", scope.claim_key(F.col("claim_id"), scope.key()))
        told = co.to_claims(made.select("claim_id", F.col("content").alias("record"), F.lit(0).alias("position")), now).withColumn("created_at", t)
        fresh = told.join(claims.select("id"), "id", "left_anti")
        linked = made.select("claim_id", F.col("topic_id").alias("source_topic_id"), F.col("id").alias("source_record_id"), t.alias("created_at"))
        left = sources.join(old.select(F.col("id").alias("source_record_id")), "source_record_id", "left_anti").select(*sources.columns).unionByName(conform(linked, "claim_sources"))
        # Claims of the old records that have no source left.
        lost = sources.join(old.select(F.col("id").alias("source_record_id")), "source_record_id", "left_semi").select(F.col("claim_id").alias("id")).distinct().join(left.select(F.col("claim_id").alias("id")), "id", "left_anti")
        events = lifecycle.event(fresh.select("id"), "create", now).unionByName(lifecycle.event(told.select("id").join(claims.select("id"), "id", "left_semi"), "correct", now)).unionByName(lifecycle.event(lost, "expire", now))
        version = topic.select(F.col("id").alias("topic_id"), t.alias("superseded_at"), "title", "summary").join(markdown.topic_lines(old).withColumnRenamed("body", "content"), "topic_id", "left")
        self.catalog.publish(
            {"knowledge_records": ended.unionByName(conform(made, "knowledge_records")), "claim_sources": left, "claims": lifecycle.expire(claims.unionByName(conform(fresh, "claims")), lost, now), "knowledge_topics": lifecycle.update(read("knowledge_topics"), topic.select("id"), {"fact_count": F.lit(len(new)), "updated_at": t}), "topic_versions": self._kept_versions(version)},
            {"claim_events": events},
        )
        self.hooks.fire("topic_updated", topic=topic_id)
        return len(new)

    def _kept_versions(self, new: DataFrame) -> DataFrame:
        """The topics' newest versions with the new ones, as many of each as the configuration keeps."""
        return lifecycle.retained(self.catalog.read("topic_versions").unionByName(conform(new, "topic_versions")), self.config.keep_versions)

    def revise(self, topic_id: str, instruction: str, now: str) -> int:
        """Has the text model edit one of the caller's topics as told, and takes the result as `correct` does.

        Refused if the model gives no records, or loses more than half of four or more.
        """
        self.scope.require_write()
        if self.model is None:
            raise ValueError("there is no text model")
        topic = self._own("knowledge_topics").filter(F.col("id") == topic_id).first()
        if topic is None:
            raise ValueError("a topic that is unknown, or not the caller's")
        live = self.catalog.read("knowledge_records").filter((F.col("topic_id") == topic_id) & F.col("valid_until").isNull() & ~F.col("deleted"))
        records = [dict(r["content"]) for r in live.orderBy("id").collect()]  # one topic's
        body = markdown.render(topic["title"], topic["summary"] or "", [], topic["confidence"], records)
        return self.correct(topic_id, extraction.revision(self.model, body, instruction, len(records)), now)

    def timeline(self, query: str, as_of: str) -> DataFrame:
        rows = self._read("knowledge_records")
        vec = self.encoder.encode([query])[0].tolist()
        coded = rows.join(self._coded("records", rows.select("id", F.col("embedding_text").alias("text"))), "id")
        sims = coded.select("id", vectors.dot(F.col("embedding"), vectors.literal(vec)).alias("similarity"))
        replaced = coded.filter(F.col("valid_until") <= temporal.instant(as_of)).select("topic_id", "id", "embedding", "valid_until").alias("o").join(coded.select("topic_id", F.col("id").alias("b"), F.col("embedding").alias("y"), "created_at"), "topic_id").filter("created_at >= valid_until AND b <> id").withColumn("s", vectors.dot(F.col("embedding"), F.col("y"))).filter(F.col("s") >= self.config.supersession_similarity)
        return recall.timeline(rows, sims, replaced.groupBy("id").agg(F.max_by("b", F.struct("s", "created_at", "b")).alias("superseded_by")), as_of)

    def contradictions(self, limit: int = 50) -> DataFrame:
        """Newest contradictions in topics that the caller may read."""
        if not 1 <= limit <= 200:
            raise ValueError("limit must be 1 to 200")
        topics = self._read("knowledge_topics")
        log = self.catalog.read("contradiction_log").join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
        return reads.contradictions(log, topics, limit=limit)

    # --- upkeep

    def status(self, now: str) -> dict[str, object]:
        row = reads.stats(self._read("episodes"), self._read("knowledge_topics"), self._read("knowledge_records"), now).first().asDict()
        cover = reads.trust_coverage(self._claims(), self.catalog.read("claim_sources"), self.catalog.read("episode_anchors"), now).first().asDict()
        v = self.catalog.read("vectors").agg(F.count("*").alias("n"), F.count_if("tombstoned").alias("gone")).first()
        ratio = v["gone"] / v["n"] if v["n"] else 0.0
        return row | {f"claims_{k}": x for k, x in cover.items()} | {"version": self.catalog.pointer()["version"], "health": trust.health(True, ratio, 1.0, None), "posture": trust.posture(cover["valid"], cover["challenged"], cover["source_ratio"])}

    def decay_report(self, now: str) -> DataFrame:
        return co.surprise_update(self._read("episodes"), now, self.config)

    def consolidation_log(self, n: int = 10) -> DataFrame:
        if not 1 <= n <= 20:
            raise ValueError("n must be 1 to 20")
        return reads.in_windows(reads.newest(self.catalog.read("consolidation_runs"), "started_at", n), self.catalog.read("contradiction_log"))

    def hygiene_scan(self) -> DataFrame:
        return co.hygiene_report(self._buckets(self._read("episodes")))

    def _buckets(self, episodes: DataFrame) -> DataFrame:
        return lifecycle.hygiene_buckets(episodes, (*lifecycle.JOURNAL_OPENERS, *self.config.journal_openers))

    def hygiene_apply(self, now: str, dry_run: bool = True) -> DataFrame:
        """The caller's orphaned claims, and episodes that buckets name; without dry_run both are removed."""
        c = {t: self.catalog.read(t) for t in ("episodes", "vectors", "claims", "claim_sources")}
        found = lifecycle.orphans(self._claims(own=True), c["claim_sources"], c["episodes"])
        if not dry_run:
            self.scope.require_write()
            junk = self._buckets(self._own("episodes")).filter("bucket IN ('temp', 'noise_journal')").select("id")
            n = junk.count()
            # Frames read the snapshot that they were made from, so `found` stays what it is.
            new = lifecycle.forget(c["episodes"], c["vectors"], lifecycle.expire(c["claims"], found, now), c["claim_sources"], junk, now)
            self.catalog.publish(new, {"claim_events": new.pop("claim_events").unionByName(lifecycle.event(found, "expire", now))})
            self.hooks.fire("forget", count=n)
        return found

    def policy_grant(self, principal: tuple[str, str], write_mode: str = "allow", read_visibility: str = "private", namespace: str | None = None, project: str | None = None) -> None:
        scope.Scope(write_mode=write_mode, read_visibility=read_visibility)  # checks both
        ids = [f"{k}:{'|'.join(str(x) for x in v)}" for k, v in (("p", principal), ("a", (namespace, project)), ("e", (*principal, namespace, project)))]
        one = lambda row, kind: self.spark.createDataFrame([row], kind)
        self.catalog.publish({
            "policy_principals": lifecycle.merge(self.catalog.read("policy_principals"), one((ids[0], *principal), "id string, principal_type string, principal_key string"), ["id"]),
            "access_policies": lifecycle.merge(self.catalog.read("access_policies"), one((ids[1], namespace, project, True), "id string, namespace_slug string, project_slug string, enabled boolean"), ["id"]),
            "policy_acl_entries": lifecycle.merge(self.catalog.read("policy_acl_entries"), one((ids[2], ids[1], ids[0], write_mode, read_visibility), "id string, policy_id string, principal_id string, write_mode string, read_visibility string"), ["id"]),
        })

    def policy_list(self) -> DataFrame:
        return scope.policy_listing(self.catalog.read("access_policies"), self.catalog.read("policy_acl_entries"), self.catalog.read("policy_principals"))

    def export(self, path: str, where: object = None, everything: bool = True) -> DataFrame:
        """The whole store, or what a scope holds (`where`, or with everything=False the caller's own) with the links inside it."""
        asked = scope.audit_filter(self.scope, where, everything and where is None)
        if asked is None:
            return self.catalog.export(path)
        return self.catalog.export(path, given=transfer.scoped(self.catalog.read, self._claims(where), asked))

    def backup(self, root: str, now: str, keep: int = 5) -> list[str]:
        """An export of the whole store below root, named by the time; only the `keep` newest stay. Their names."""
        self.export(f"{root}/export-{now}")
        held = [n for n in self.catalog.snapshots(root) if n.startswith("export-")]
        for name in held[:-keep]:
            self.catalog.drop(f"{root}/{name}")
        return held[-keep:]

    def import_(self, path: str) -> dict[str, int]:
        """Adds what an export holds and is not here yet; how many rows of each table.

        Ids that stand for something else here are replaced, and all that refers to them; topics of one scope and name become one. New episodes
        are encoded by this store's encoder, whatever the export's was, and enter both kept indexes.
        """
        self.scope.require_write()
        with self.catalog.staged() as stage:
            # The same export comes under the same ids each time.
            new = {t: stage(df) for t, df in transfer.incoming(self.catalog.exported(path), self.catalog.read, "import", stage).items()}
            added = {t: df.count() for t, df in new.items()}
            if any(added.values()):
                live = new["episodes"].filter("NOT deleted")
                coded = stage(encode(live.withColumn("text", F.pandas_udf(_embedding_texts, "string")("content", "content_type", "tags")), self.encoder))
                postings, lengths = keyword.term_tables(live)
                self.catalog.append({t: df for t, df in new.items() if added[t]} | {"vectors": coded, "keyword_postings": postings, "keyword_lengths": lengths, **self._celled(coded)})
        return added

    def migrate(self) -> list[int]:
        """Brings the store to this version's schema; the schema versions gone through."""
        self.scope.require_write()
        return self.catalog.migrate()

    def repair(self, dry_run: bool = True) -> dict[str, int]:
        """Mends what tables of all scopes should not hold, in one snapshot; how many rows of each kind there are (with dry_run only that).

        Rows that repeat an id (the latest change stays), vectors of no episode or of another dimension, live episodes that count as indexed without
        a vector, and anchors and claim sources whose episode or claim is not there.
        """
        read = self.catalog.read
        episodes, held = read("episodes"), read("vectors")
        newest = co.dedupe_records(episodes, ["id"], F.coalesce(F.unix_micros("updated_at"), F.lit(0)), "created_at")
        sound = held.filter(vectors.valid(F.col("embedding"), self.encoder.dim)).join(newest.select("id"), "id", "left_semi").dropDuplicates(["id"])
        blind = newest.filter("NOT deleted AND indexed").select("id").join(sound.select("id"), "id", "left_anti")
        anchors = read("episode_anchors").join(newest.select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
        sources = read("claim_sources").join(read("claims").select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
        lost = sources.filter("source_episode_id IS NOT NULL").join(newest.select(F.col("id").alias("source_episode_id")), "source_episode_id", "left_anti").select(F.col("source_episode_id").alias("id"))
        kept = lifecycle.detach_sources(sources, lost)
        found = {"repeated_episodes": episodes.count() - newest.count(), "stray_vectors": held.count() - sound.count(), "unindexed": blind.count(), "stray_anchors": read("episode_anchors").count() - anchors.count(), "stray_sources": read("claim_sources").count() - kept.count()}
        if not dry_run and any(found.values()):
            self.scope.require_write()
            columns = {t: SCHEMAS[t].names for t in ("episode_anchors", "claim_sources", "vectors")}
            self.catalog.publish({"episodes": lifecycle.update(newest, blind, {"indexed": F.lit(False)}), "vectors": sound.select(*columns["vectors"]), "episode_anchors": anchors.select(*columns["episode_anchors"]), "claim_sources": kept.select(*columns["claim_sources"])})
        return found

    def expire_stale(self, now: str) -> int:
        """Ends the caller's claims that have been challenged for longer than the configured time, the oldest first; how many."""
        self.scope.require_write()
        claims = self.catalog.read("claims")
        with self.catalog.staged() as stage:
            hit = stage(lifecycle.stale_challenged(self._claims(own=True), self.catalog.read("claim_events"), now, self.config.challenge_ttl_hours, self.config.challenge_batch))
            n = hit.count()
            self.catalog.publish({"claims": lifecycle.expire(claims, hit, now)}, {"claim_events": lifecycle.event(hit, "auto_expired_challenged", now)})
        return n

    # --- short forms

    def remember(self, text: str, now: str, kind: str = "fact", tags: Sequence[str] = ()) -> DataFrame:
        return self.ingest(self.spark.createDataFrame([(text, kind, list(tags))], "content string, content_type string, tags array<string>"), now)

    def ask(self, text: str, now: str, n: int = 5) -> DataFrame:
        q = recall.RecallQuery(text, now, n, sections=("episodes", "records"))
        got = self.recall(q)
        a = recall.simple_view(got["episodes"], "episode")
        return a.unionByName(recall.simple_view(got["records"], "record", "embedding_text")).orderBy(F.desc("score"), "id").limit(n)


def within(spark: SparkSession, run: Callable[[], T], seconds: float) -> tuple[T | None, str | None]:
    """(what run gives, None), or (None, why): its jobs are stopped when the time is over."""
    tag, context = f"within-{uuid.uuid4().hex}", spark.sparkContext

    def tagged() -> T:
        context.addJobTag(tag)
        try:
            return run()
        finally:
            context.removeJobTag(tag)

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(tagged).result(seconds), None
    except TimeoutError:
        context.cancelJobsWithTag(tag)
        return None, "the time is over"
    except Exception as x:  # whatever fails in a part must not take the others with it
        return None, str(x).partition("\n")[0][:200] or type(x).__name__
    finally:
        pool.shutdown(wait=False)


def _topic_text() -> Column:
    """What a topic is searched by."""
    return F.concat_ws(". ", "title", "summary")


def _claim_text() -> Column:
    """What a claim is searched by: its text and its payload in order of its keys."""
    return F.concat_ws(" ", "canonical_text", F.array_join(F.transform(F.array_sort(F.map_entries("payload")), lambda p: F.concat_ws(" ", p["key"], p["value"])), " "))


def id_tokens(values: Iterable[object]) -> list[str]:
    """Ids trimmed, blank ones dropped, each once, in order."""
    return list(dict.fromkeys(x for x in (str(v).strip() for v in values if v is not None) if x))


def _embedding_texts(content: pd.Series, kind: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([embedding_text(c, k, list(t) if t is not None else []) for c, k, t in zip(content, kind, tags, strict=True)])


def _advice(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([shape_warnings(c) if k == "solution" else [] for c, k in zip(content, kind, strict=True)])


__all__ = ["MemoryEngine", "SCHEMAS"]
