"""Importance resampling towards a target distribution over bucket-partitioned inverted postings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import IS_WORD, documents, in_chunks, materialize, released, scratch, table, utf8

BUCKETS = 10_000
#: A bucket's postings are dealt over tasks in shares of 1 / SHARES of all postings (SHARE_ROWS rows at least).
SHARES, SHARE_ROWS = 20_000, 1024
#: The bytes of a word that are worked on together with other words' bytes; what a longer word has beyond goes on its own.
TOGETHER = 64


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected CRC-32 with polynomial 0xEDB88320."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def _fed(state: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes buf[start:end] of each word, one byte of all words at a time."""
    state, length = state.copy(), end - start
    active = np.flatnonzero(length > 0)
    for j in range(TOGETHER):
        if not active.size:
            return state
        s = state[active]
        state[active] = _TABLE[(s ^ buf[start[active] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
        active = active[length[active] > j + 1]
    for w in active:
        state[w] = zlib.crc32(buf[start[w] + TOGETHER : end[w]].tobytes(), int(state[w]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return state


def word_runs(texts: list[bytes], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to `longest` words, joined by one space: the crc32 of each and the index of its text."""
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if not buf.size:
        return
    edge = np.flatnonzero(np.diff(np.concatenate(([False], IS_WORD[buf], [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum(np.array([0] + [len(t) + 1 for t in texts[:-1]], dtype=np.int64))
    text = np.searchsorted(begin, start, side="right") - 1
    buf = _LOWERED[buf]
    state = _fed(np.full(start.size, 0xFFFFFFFF, np.uint32), buf, start, end)
    yield state ^ np.uint32(0xFFFFFFFF), text
    for n in range(1, longest):
        one = np.arange(max(0, start.size - n))
        one = one[text[one] == text[one + n]] if one.size else one
        state = state[: start.size - n] if start.size > n else state[:0]
        spaced = _TABLE[(state ^ np.uint32(32)) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
        state = _fed(spaced, buf, start[n:], end[n:])
        yield state[one] ^ np.uint32(0xFFFFFFFF), text[one]


def postings(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(row, doc_id, n_words, bucket, n): how often a row's features fall into a bucket; one more row, bucket -1, for each row itself.

    texts has the columns doc_id and text. `row` is unique to an input row; in its own row n is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, whole = b.column(0).to_numpy(zero_copy_only=False), utf8(b.column(1))
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, part in in_chunks(whole):
                here, keys, words = np.arange(len(part)), [], np.zeros(len(part), np.int64)
                for n, (crc, text) in enumerate(word_runs(part, longest)):
                    if not n:
                        words += np.bincount(text, minlength=len(part))
                    keys.append(text * buckets + (crc % np.uint32(buckets)).astype(np.int64))
                key, count = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_counts=True)
                at = np.concatenate([here, key // buckets])
                bucket = np.concatenate([np.full(len(part), -1), key % buckets])
                doc = pa.array(np.where(known, ids, 0)[first + at].astype(np.int64), mask=~known[first + at])
                columns = [pa.array(made + at), doc, pa.array(words[at]), pa.array(bucket.astype(np.int32)), pa.array(np.concatenate([np.zeros(len(part), np.int64), count]))]
                yield pa.record_batch(columns, ["row", "doc_id", "n_words", "bucket", "n"])
                made += len(part)

    return texts.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), "row long, doc_id long, n_words long, bucket int, n long")


def bucket_gains(own: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, docs, gain) from two corpora's (bucket, docs, n), co-grouped by bucket: at most `buckets` rows."""
    s_all, t_all = (float(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) for df in (own, target))
    both = own.join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
    ratio = (F.coalesce("t", F.lit(0)).cast("double") + 1) * (s_all + buckets) / ((F.col("n").cast("double") + 1) * (t_all + buckets))
    return both.select("bucket", "docs", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every row of docs: the floored mean gain of its features.

    docs has doc_id and text, target has text. Postings (bucket, row, count) of docs are shuffled by bucket, a bucket with many of
    them over several tasks; each meets its bucket's gain there, and the contributions are added up by row. Texts that
    are null, empty or without a word have no features and weight 0; a very long text is counted whole by one task; equal rows are
    rows of their own; an empty target has no features; no rows give no rows; other columns are ignored, whatever their names.
    """
    counted = materialize(postings(docs, longest, buckets), "postings")
    held = lambda df: df.filter("bucket >= 0").groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
    aims = held(postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets))
    gains = materialize(bucket_gains(materialize(held(counted), "buckets"), materialize(aims, "aims"), buckets), "gains")
    share = max(SHARE_ROWS, counted.count() // SHARES)
    parts = F.ceil(F.col("docs") / share).cast("int")
    # As many rows as buckets at most, so their list is safe to broadcast.
    dealt = counted.filter("bucket >= 0").join(F.broadcast(gains.select("bucket", parts.alias("parts"))), "bucket").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    copied = gains.select("bucket", "gain", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    given = dealt.join(copied.hint("shuffle_hash"), ["bucket", "part"]).select("row", (F.col("n") * F.col("gain")).alias("gain"), "n")
    rows = counted.filter("bucket = -1").select("row", "doc_id", "n_words", F.lit(0).cast("long").alias("gain"), "n")
    sums = rows.unionByName(given, allowMissingColumns=True).groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "n_words")), F.sum("gain").alias("gain"), F.sum("n").alias("n_features"))
    # Whole numbers only, floored: a double could round a large sum up.
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (gain - pmod(gain, n_features)) DIV n_features END")
    return sums.select("row", "doc_id", "n_words", "n_features", mean.alias("weight"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: str = "2024", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank; the rows with a rank are a draw without replacement, best first.

    A row's score is its weight plus 1000 times a Gumbel number that seed and doc_id alone decide, so reruns agree. Of the N rows with
    at least `least_words` words the floor(percent * N / 100) highest scores are drawn, ties by smaller doc_id (null ones
    first), then by place in the input. A null doc_id draws as the empty text. Otherwise as `weights`.
    """
    with scratch(docs.sparkSession) as keep:
        scored = keep(materialize(weights(docs, target, longest, buckets), "weights"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    scored = scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))
    enough = F.col("n_words") >= least_words
    # Ranges of tasks hold falling scores; a row's rank is its place in its range and the rows of the ranges before.
    order = (F.desc("score"), F.asc("doc_id"), F.asc("row"))
    placed = scored.filter(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place")), "placed")
    sizes = sorted((r["range"], r["count"]) for r in placed.groupBy("range").count().toLocalIterator())  # one for each task
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = docs.sparkSession.createDataFrame(before, "range long, before long")
    rank = F.col("before") + F.col("place") + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = placed.join(F.broadcast(starts), "range").select(*columns, F.when(rank <= total * percent // 100, rank).alias("rank"))
    return ranked.unionByName(scored.filter(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


#: crc32 byte by byte over the distinct words; step(c) is eight shifts of the low byte.
OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT CAST(range AS BIGINT) AS b FROM range(256))),
lookup AS (SELECT list(v ORDER BY b) AS t FROM steps),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
own AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
aim AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
crc AS (
  SELECT w, 0 AS i, hex(encode(w)) AS bytes, CAST(4294967295 AS BIGINT) AS c FROM (SELECT w FROM own UNION SELECT w FROM aim)
  UNION ALL
  SELECT w, i + 1, bytes, xor(t[(xor(c, CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)) & 255) + 1], c // 256) FROM crc, lookup WHERE 2 * i < length(bytes)),
k AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(bytes)),
s AS (SELECT bucket, count(*) AS n FROM own JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM aim JOIN k USING (w) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((CAST(s.n AS DOUBLE) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM own JOIN k USING (w) JOIN g USING (bucket) GROUP BY r),
e AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (gain - ((gain % n) + n) % n) // n END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN f USING (r)),
x AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM x)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM o
"""
