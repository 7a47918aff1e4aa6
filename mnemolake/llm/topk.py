"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import released, table

#: Widths of the score histograms' bins, from coarse to single scores.
WIDTHS = (1 << 12, 1 << 6, 1)
#: Queries scored together: bounds what is broadcast (a few MB) and collected (one row for each).
BLOCK = 4096
TILE = 1024


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows with an id and a vector whose components are all there and finite, as (id, vector of doubles)."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), v.alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Components floored to 256ths, one row per vector; vectors shorter than dim end in zeros."""
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False))
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    out[np.arange(dim)[None, :] < size[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: doubles where no partial sum can leave their exact range."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return (whole(a) @ whole(b).T).astype(np.int64)


def _scores(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tiles of (candidate ids, scores by candidate and query, which of them count)."""
    order = np.argsort(ids, kind="stable")
    for b in batches:
        own, m = b.column(0).to_numpy(), _matrix(b.column(1), queries.shape[1])
        for at in range(0, len(own), TILE):
            cand, s = own[at : at + TILE], _product(m[at : at + TILE], queries)
            valid = np.ones(s.shape, dtype=bool)
            lo, hi = np.searchsorted(ids, cand, "left", order), np.searchsorted(ids, cand, "right", order)
            for r in np.flatnonzero(hi > lo):
                valid[r, order[lo[r] : hi[r]]] = False
            yield cand, s, valid


def _block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """The k best candidates of one block of queries: (query number, id, score)."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast((ids, queries))
    lowest = np.full(len(ids), np.iinfo(np.int64).min)
    for width in WIDTHS:
        floor = spark.sparkContext.broadcast(lowest)

        def histogram(batches: Iterator[pa.RecordBatch], width: int = width, floor=floor) -> Iterator[pa.RecordBatch]:
            """Scores per query and bin, for the bins that the task's own k best reach."""
            ids, queries = sent.value
            keys, counts = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
            least = floor.value.copy()
            for _, s, valid in _scores(batches, ids, queries):
                valid &= s >= least[None, :]
                row, q = np.nonzero(valid)
                if not len(row):
                    continue
                if len(s) > k and len(row) > k * len(ids):
                    # A query's k-th best of this tile bounds its k-th best overall from below.
                    held = np.where(valid, s, np.iinfo(np.int64).min)
                    least = np.maximum(least, np.partition(held, len(s) - k, axis=0)[len(s) - k] // width * width)
                    row, q = np.nonzero(valid & (s >= least[None, :]))
                new, n = np.unique(np.stack([q, s[row, q] // width], 1), axis=0, return_counts=True)
                keys, counts = np.concatenate([keys, new]), np.concatenate([counts, n])
                if len(keys) > 1 << 20:
                    keys, inverse = np.unique(keys, axis=0, return_inverse=True)
                    counts = np.bincount(inverse.ravel(), counts).astype(np.int64)
            keep = keys[:, 1] * width >= least[keys[:, 0]]
            yield pa.record_batch([pa.array(keys[keep, 0]), pa.array(keys[keep, 1]), pa.array(counts[keep])], ["q", "bin", "n"])

        bins = vectors.mapInArrow(released(histogram), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        above = bins.withColumn("above", F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))))
        # The highest bin that the k best reach down to; with fewer candidates than k, the lowest there is.
        found = above.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("above") >= k, F.col("bin"))), F.min("bin")).alias("bin"))
        for r in found.toLocalIterator():
            lowest[r["q"]] = r["bin"] * width
    kth = spark.sparkContext.broadcast(lowest)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All candidates above the k-th score, and of those at it the k smallest ids of the task."""
        ids, queries = sent.value
        tied = np.zeros((0, 2), np.int64)
        for cand, s, valid in _scores(batches, ids, queries):
            row, q = np.nonzero(valid & (s > kth.value[None, :]))
            if len(row):
                yield pa.record_batch([pa.array(q), pa.array(cand[row]), pa.array(s[row, q])], ["q", "id", "score"])
            row, q = np.nonzero(valid & (s == kth.value[None, :]))
            if len(row):
                tied = np.concatenate([tied, np.stack([q, cand[row]], 1)])
                tied = tied[np.lexsort((tied[:, 1], tied[:, 0]))]
                first = np.searchsorted(tied[:, 0], tied[:, 0])
                tied = tied[np.arange(len(tied)) - first < k]
        yield pa.record_batch([pa.array(tied[:, 0]), pa.array(tied[:, 1]), pa.array(kth.value[tied[:, 0]])], ["q", "id", "score"])

    return vectors.mapInArrow(released(pick), "q long, id long, score long")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Each query's k best candidates by integer inner product: query_id, rank, vec_id, score.

    Both inputs are `usable` rows (id, v). A query is a distinct (id, v); rows with the query's own id are no
    candidates for it, repeated candidate rows count as often as they occur. Components are floored to 256ths;
    vectors of unequal length are compared as if the shorter ended in zeros. Scores must fit a long. Queries with
    fewer than k candidates return all; no queries or no candidates return no rows.

    Queries go in blocks against all rows. Per block every score is computed once per histogram level: tasks count
    scores by query and bin, the counts add up, and the bin of the k-th score is refined to a single score.
    A last pass keeps what is above it and, among equals, the smallest ids.
    """
    spark = vectors.sparkSession
    distinct = queries.distinct()
    n, dim = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(1, dim or 0, vectors.agg(F.max(F.size("v"))).first()[0] or 0)
    blocks = -(-n // BLOCK)
    out = None
    for at in range(blocks):
        rows = distinct.filter(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == at).orderBy("id").toArrow()
        if not rows.num_rows:
            continue
        ids = rows.column("id").combine_chunks().to_numpy()
        part = _block(vectors, ids, _matrix(rows.column("v").combine_chunks(), dim), k)
        names = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": ids}))
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
        part = part.join(F.broadcast(names), "q")  # one block: at most a few thousand rows
        part = part.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("id") % 50 == 0), 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
