"""Line dedup by content-defined chunks of lines and by whole repeated runs of lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import documents, materialize, mix, released, scratch, sieve, small_batches, spread_join, utf8

#: A boundary follows a line if the rolling hash of it and the line before is a multiple of this.
MEAN_LINES = 3
#: Words that a line needs to form a chunk of its own, and that a chunk needs to be compared at all.
LONG_LINE, LEAST_WORDS = 50, 10


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, number of lines) of a document's chunks, in order.

    Boundaries depend on lines' content alone: the rolling hash of two neighbouring lines, and long lines, which are
    chunks of their own. Lines put in before a passage shift it without changing the boundaries inside.
    """
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    rolling = h.copy()
    rolling[1:] ^= (h[:-1] << np.uint64(23)) | (h[:-1] >> np.uint64(41))
    ends = (mix(rolling) % np.uint64(MEAN_LINES) == 0).tolist()
    long_ = [x.count(b" ") >= LONG_LINE - 1 and len(x.split()) >= LONG_LINE for x in lines]
    out, first = [], 0
    for i in range(len(lines)):
        if i + 1 == len(lines) or ends[i] or long_[i] or long_[i + 1]:
            out.append((first, i + 1 - first))
            first = i + 1
    return out


def compared(lines: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) of the chunks that count: of several lines or one long line, with enough words."""
    for first, n in chunks(lines):
        body = b"\n".join(lines[first : first + n])
        if (n > 1 and len(body.split()) >= LEAST_WORDS) or (n == 1 and len(body.split()) >= LONG_LINE):
            yield first, n, body


def _key(body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body) - (1 << 63)


def _listed(docs: DataFrame) -> DataFrame:
    """doc_id with a hash of its text: together they name a row, whose repeats are the same row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text"))


def runs(words: np.ndarray, seen: np.ndarray) -> list[tuple[int, int]]:
    """(first line, number of lines) of the least runs of LONG_LINE words whose lines are all `seen`: one from each line and one up to each line.

    A longer repeated run is the union of the least ones inside it: from a line that has the words after it in the
    run, and up to the run's end for the others.
    """
    at = np.arange(len(words))
    total = np.concatenate(([0], np.cumsum(words)))
    unseen = np.concatenate(([0], np.cumsum(~seen)))
    first = np.concatenate((at, np.searchsorted(total, total[1:] - LONG_LINE, side="right") - 1))
    end = np.concatenate((np.searchsorted(total, total[:-1] + LONG_LINE), at + 1))
    held = (first >= 0) & (end <= len(words))
    first, end = first[held], end[held]
    held = unseen[end] == unseen[first]
    return list(zip(first[held].tolist(), (end - first)[held].tolist(), strict=True))


def removals(docs: DataFrame, whole_runs: bool = False) -> DataFrame:
    """Passages that are removed: doc_id, text_hash, first line, lines.

    Passages are the chunks that are compared, and with `whole_runs` also the least runs of LONG_LINE words, so spans may
    overlap. One that occurs more than once over all documents stays where doc_id (null first), text_hash and line are
    smallest, and goes everywhere else but where it overlaps the one that stays; so every line that goes stands before
    it. Hashes of lines are counted with map-side sums; a filter sized by the repeated ones routes the passages all of whose lines
    repeat, and these are grouped by their bytes.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([_key(x) for t in utf8(b.column(0)) for x in t.split(b"\n")], pa.int64())], ["key"])

    repeated = materialize(docs.select("text").mapInArrow(released(keys), "key long").groupBy("key").count().filter("count > 1").select("key"), "line-hashes")
    flagged = docs.sparkSession.sparkContext.broadcast(sieve(repeated))

    def passages(lines: list[bytes], seen: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        held = {(first, n) for first, n, _ in compared(lines) if seen[first : first + n].all()}
        if whole_runs:
            held.update(runs(np.array([len(x.split()) if ok else 0 for x, ok in zip(lines, seen.tolist(), strict=True)]), seen))
        for first, n in sorted(held):
            yield first, n, b"\n".join(lines[first : first + n])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "first", "lines", "key", "body"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            texts = [t.split(b"\n") for t in utf8(b.column(2))]
            hit = flagged.value.passes(np.array([_key(x) for lines in texts for x in lines], np.int64))
            rows, at = [], 0
            for d, h, lines in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, strict=True):
                seen = hit[at : at + len(lines)]
                at += len(lines)
                if seen.any():
                    rows += [(d, h, first, n, _key(body), body) for first, n, body in passages(lines, seen)]
            yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    found = materialize(_listed(docs).mapInArrow(released(route), "doc_id long, text_hash long, first int, lines int, key long, body binary"), "line-chunks")
    place = F.struct("doc_id", "text_hash", "first")
    bodies = found.groupBy("key", "body").agg(F.count("*").alias("n"), F.min(place).alias("stays"))
    by_key = materialize(bodies.groupBy("key").agg(F.count("*").alias("bodies"), F.max("n").alias("n"), F.min("stays").alias("stays")).filter("n > 1"), "line-keys")
    cols = ["doc_id", "text_hash", "first", "lines"]
    stays = F.col("stays")
    apart = (place != stays) & ~(F.col("doc_id").eqNullSafe(stays["doc_id"]) & (F.col("text_hash") == stays["text_hash"]) & (F.col("first") < stays["first"] + F.col("lines")))
    # One body per hash: its bytes were compared above, so members are found by hash alone; others by bytes again.
    same = spread_join(found.drop("body"), by_key.filter("bodies = 1"), ["key"], "doc_id").filter(apart)
    out = same.select(*cols)
    clashes = by_key.filter("bodies > 1").select("key")
    if not clashes.isEmpty():
        clash = found.join(clashes, "key", "left_semi")
        clashed = clash.join(clash.groupBy("key", "body").agg(F.min(place).alias("stays")), ["key", "body"]).filter(apart)
        out = out.unionByName(clashed.select(*cols))
    return out.distinct()


def _disjoint(spans: list) -> list[dict[str, int]]:
    """Sorted spans (first, lines) with those that overlap put together."""
    out: list[dict[str, int]] = []
    for s in spans:
        if out and s["first"] < out[-1]["first"] + out[-1]["lines"]:
            out[-1]["lines"] = max(out[-1]["lines"], s["first"] + s["lines"] - out[-1]["first"])
        else:
            out.append({"first": s["first"], "lines": s["lines"]})
    return out


def strip(docs: DataFrame, whole_runs: bool = False) -> DataFrame:
    """One row per document: doc_id, n_lines, removed (array of struct<first, lines>), text without those lines.

    Lines end at line feeds; a null text counts as empty and has one line. Chunks are compared byte for byte. Rows that
    repeat doc_id and text are one document, so a passage is not removed for being in both, and each gets a row.
    With `whole_runs` every repeated run of lines of LONG_LINE words goes as well, wherever chunks' boundaries are.
    A text all of whose lines go becomes empty. Only documents that may lose lines (a filter of those that do tells) are shuffled. No rows give no rows; a very
    long text is held whole by one task; other columns are ignored, whatever their names.
    """
    small_batches(docs)
    with scratch(docs.sparkSession) as keep:
        named = removals(docs, whole_runs).withColumn("key", F.xxhash64("doc_id", "text_hash"))
        gone = keep(materialize(named, "line-removals"))

    @F.pandas_udf("array<struct<first:int,lines:int>>")
    def disjoint(spans: pd.Series) -> pd.Series:
        return spans.map(_disjoint)

    per_document = gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first", "lines"))).alias("removed")).withColumn("removed", disjoint("removed"))
    name = F.xxhash64("doc_id", "text_hash")
    near = docs.sparkSession.sparkContext.broadcast(sieve(gone.select("key")))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(near.value.passes(h.to_numpy()))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, removed, strict=True):
            lines = (text or "").split("\n")
            for s in reversed(spans):
                del lines[s["first"] : s["first"] + s["lines"]]
            out.append("\n".join(lines))
        return pd.Series(out)

    text = F.coalesce("text", F.lit(""))
    rows = _listed(docs).withColumn("n_lines", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")).withColumn("maybe", maybe(name))
    none = F.array().cast("array<struct<first:int,lines:int>>")
    whole = rows.filter("NOT maybe").select("doc_id", "n_lines", none.alias("removed"), text.alias("text"))
    there = per_document.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "removed")
    # The lists grow with the input, so the join is not left to be a broadcast on small ones.
    suspects = rows.filter("maybe").join(there.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    suspects = suspects.withColumn("removed", F.coalesce("removed", none))
    return whole.unionByName(suspects.select("doc_id", "n_lines", "removed", cut(text, F.col("removed")).alias("text")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r["lines"])
    return strip(documents(spark, sf_dir), whole_runs=True).select("doc_id", "n_lines", F.size("removed").cast("long").alias("chunks_removed"), lines.alias("lines_removed"), F.length("text").cast("long").alias("chars_left"), F.sha2("text", 256).alias("text_sha256"))
