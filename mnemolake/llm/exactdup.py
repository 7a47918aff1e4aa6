"""Exact dedup: mergeable counting quotient filters, then byte verification of what they flag."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import ascii_lower, documents, materialize, released, scratch, sieve, small_batches, spread_join, utf8


class CountingQuotientFilter:
    """Counts of 64-bit fingerprints, stored as runs of remainders in the order of their quotients.

    The high `qbits` of a fingerprint (its quotient) name a run; the run holds the rest of each distinct
    fingerprint (its remainder) in order, with a counter where it was seen more than once. Nothing is lost:
    a filter gives back its fingerprints, so two filters merge by a walk over their sorted remainders.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray, qbits: int = 12):
        self.qbits, rbits = qbits, np.uint64(64 - qbits)
        quotient = (fingerprints >> rbits).astype(np.int64)
        self.runs = np.bincount(quotient, minlength=1 << qbits).astype(np.uint32)
        self.remainders = fingerprints & np.uint64((1 << (64 - qbits)) - 1)
        self.repeated = np.flatnonzero(counts > 1).astype(np.uint32)
        self.counters = counts[self.repeated].astype(np.uint64)

    @classmethod
    def of(cls, fingerprints: np.ndarray, qbits: int = 12) -> CountingQuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True), qbits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints in order, and their counts."""
        quotient = np.repeat(np.arange(1 << self.qbits, dtype=np.uint64), self.runs)
        counts = np.ones(self.remainders.size, np.uint64)
        counts[self.repeated] = self.counters
        return quotient << np.uint64(64 - self.qbits) | self.remainders, counts

    @classmethod
    def merged(cls, filters: Iterable[CountingQuotientFilter]) -> CountingQuotientFilter:
        filters = list(filters)
        parts = [f.items() for f in filters]
        fp, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(fp, kind="stable")  # merges the presorted parts
        fp, n = fp[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1]))) if fp.size else np.zeros(0, np.int64)
        return cls(fp[first], np.add.reduceat(n, first) if fp.size else n, max(f.qbits for f in filters))

    def dumps(self) -> bytes:
        """Run lengths, remainders without their empty high bytes, and the counters."""
        width = (64 - self.qbits + 7) // 8
        packed = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([self.qbits, self.remainders.size, self.repeated.size], "<u4")
        return b"".join((head.tobytes(), self.runs.astype("<u4").tobytes(), packed.tobytes(), self.repeated.astype("<u4").tobytes(), self.counters.astype("<u8").tobytes()))

    @classmethod
    def loads(cls, raw: bytes) -> CountingQuotientFilter:
        self = cls.__new__(cls)
        qbits, n, repeated = (int(x) for x in np.frombuffer(raw, "<u4", 3))
        at, width = 12, (64 - qbits + 7) // 8
        self.qbits, self.runs = qbits, np.frombuffer(raw, "<u4", 1 << qbits, at)
        at += 4 << qbits
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
        self.remainders, at = wide.reshape(-1).view("<u8"), at + n * width
        self.repeated = np.frombuffer(raw, "<u4", repeated, at)
        self.counters = np.frombuffer(raw, "<u8", repeated, at + 4 * repeated)
        return self


def _digests(column: pa.Array) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Normalised texts, their SHA-256, and 64-bit fingerprints cut from it."""
    texts = [t.lower() for t in utf8(column)]  # bytes.lower() changes A-Z alone
    shas = [hashlib.sha256(t).digest() for t in texts]
    return texts, shas, np.frombuffer(b"".join(s[:8] for s in shas), ">u8").astype(np.uint64)


def filter_segments(docs: DataFrame, segments: int) -> DataFrame:
    """One counting quotient filter per partition, cut into ranges of fingerprints: (segment, filter)."""
    # A segment is a power-of-two range, so its fingerprints share their top bits; the filter stores the others.
    bits = max(1, (segments - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.unique(fp, return_counts=True) for b in batches for fp in (_digests(b.column(0))[2],)]
        if not seen:
            return
        fp, n = np.concatenate([s[0] for s in seen]), np.concatenate([s[1] for s in seen])
        order = np.argsort(fp, kind="stable")
        fp, n = fp[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
        fp, n = fp[first], np.add.reduceat(n, first)
        seg = (fp >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            q = CountingQuotientFilter(fp[a:b] << np.uint64(bits), n[a:b], qbits=max(1, min(12, int(b - a).bit_length())))
            yield pa.record_batch([pa.array([int(seg[a])], pa.int64()), pa.array([q.dumps()], pa.binary())], ["segment", "filter"])

    return docs.select("text").mapInArrow(released(build), "segment long, filter binary")


def repeated_fingerprints(docs: DataFrame, segments: int | None = None) -> DataFrame:
    """Fingerprints (as signed longs) that the merged filters count more than once."""
    segments = segments or max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = max(1, (segments - 1).bit_length())

    def merge(key, frame):
        fp, n = CountingQuotientFilter.merged([CountingQuotientFilter.loads(x) for x in frame["filter"]]).items()
        fp = fp[n > 1] >> np.uint64(bits) | np.uint64(int(key[0]) << (64 - bits))
        return pd.DataFrame({"key": fp.view(np.int64)})

    return filter_segments(docs, segments).groupBy("segment").applyInPandas(merge, "key long")


def classify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts count as equal if their bytes are after A-Z are lower-cased; a null text is an empty one. Of equal
    texts the largest doc_id stays. Rows that repeat both doc_id and text all count towards group_size and are
    all marked kept (`dedup` leaves one of them); a null doc_id stays only where its group has no other. No rows
    give no rows; other columns are ignored, whatever their names. A very long text is held whole by one task.

    Filters built per partition merge by ranges of fingerprints. The fingerprints that they count more than once are a
    table; a filter sized by its rows tells texts that may be among them, and these alone are grouped by digest and
    whole text, so equality is decided by bytes; copies meet in map-side partial groups first.
    """
    small_batches(docs)
    spark = docs.sparkSession
    with scratch(spark) as keep:
        # Written first: two Python operators in one stage would keep two workers per task alive from then on.
        flagged = spark.sparkContext.broadcast(sieve(materialize(repeated_fingerprints(docs), "exact-fingerprints")))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, shas, fp = _digests(b.column(1))
                hit = flagged.value.passes(fp)
                yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(shas, pa.binary()), pa.array(hit), pa.array([t if h else None for t, h in zip(texts, hit, strict=True)], pa.binary())], ["doc_id", "sha", "again", "body"])

        rows = keep(materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(route), "doc_id long, sha binary, again boolean, body binary"), "exact-routed"))
        groups = rows.filter("again").groupBy("sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        shas = keep(materialize(groups.groupBy("sha").agg(F.count("*").alias("bodies"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")), "exact-groups"))
    alone = rows.filter("NOT again").select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    # One body per digest: its bytes were compared above, so members are found by digest alone.
    same = spread_join(rows.filter("again").select("doc_id", "sha"), shas.filter("bodies = 1").drop("bodies"), ["sha"], "doc_id")
    cols = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    out = alone.select(*cols).unionByName(same.select(*cols))
    clashes = shas.filter("bodies > 1").select("sha")
    if not clashes.isEmpty():  # different texts under one digest are told apart by their bytes again
        clash = rows.filter("again").select("doc_id", "sha", "body").join(clashes, "sha", "left_semi")
        clashed = clash.join(clash.groupBy("sha", "body").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), ["sha", "body"])
        out = out.unionByName(clashed.select(*cols))
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever their names; of rows repeated whole, one.

    Only rows whose doc_id may be in a group of copies (a filter of the groups' ids tells) are shuffled. No rows give none.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        groups = keep(materialize(classify(docs).filter("group_size > 1").select(F.xxhash64("doc_id").alias("key"), "doc_id", "kept", "text_sha256"), "exact-copies"))
    near = spark.sparkContext.broadcast(sieve(groups.select("key")))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(near.value.passes(h.to_numpy()))

    own = F.col("doc_id").cast("long")
    marked = docs.select(F.struct("*").alias("row"), own.alias("id"), maybe(F.xxhash64(own)).alias("maybe"))
    lowered = F.coalesce(ascii_lower(F.col("row.text")), F.lit(""))
    suspects = marked.filter("maybe").select("row", "id", F.sha2(lowered, 256).alias("sha"))
    gone = groups.filter("NOT kept").select(F.col("doc_id").alias("out"), F.col("text_sha256").alias("out_sha")).distinct()
    staying = suspects.join(gone, (F.col("sha") == F.col("out_sha")) & F.col("id").eqNullSafe(F.col("out")), "left_anti").dropDuplicates(["id", "sha"])
    return marked.filter("NOT maybe").select("row.*").unionByName(staying.select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
