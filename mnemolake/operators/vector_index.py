"""A kept index for vector search: vectors by cells, so that a search reads the cells that may hold its answer.

Cells are the regions nearest to centroids. These are fitted on a bounded sample; every vector is in a cell. A search looks
at the cells nearest to its query first. In exact searches the k-th best of these bounds which other cells can
hold anything better (by each cell's radius), and only those are read too, so the result is that of comparing all.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemolake.operators.vectors import dot, literal, valid

#: Vectors that centroids are fitted on, components that these have together, and cells, at most.
SAMPLE, SAMPLE_COMPONENTS, MOST_CELLS = 65_536, 16 << 20, 4096
#: Queries that are searched together: what is broadcast and held by a task grows with them.
BLOCK = 4096


class Cells(NamedTuple):
    """Centroids by cell, and how far a cell's farthest vector is from its centroid."""

    centroids: np.ndarray
    radius: np.ndarray

    def bound(self, queries: np.ndarray) -> np.ndarray:
        """The highest inner product that a vector of each cell can have with each query."""
        return queries @ self.centroids.T + np.linalg.norm(queries, axis=1)[:, None] * self.radius[None, :]


def fitted(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids of a sample: nearest ones take their vectors' mean, round by round; those without any stay."""
    rng = np.random.default_rng(seed)
    held = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(sample, held)
        sums, n = np.zeros_like(held), np.bincount(near, minlength=len(held))
        np.add.at(sums, near, sample)
        held[n > 0] = sums[n > 0] / n[n > 0, None]
    return held


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    norm = (centroids * centroids).sum(1)
    return np.concatenate([np.zeros(0, np.int64), *((norm - 2 * (x[i : i + 2048] @ centroids.T)).argmin(1) for i in range(0, len(x), 2048))])


def centroids(vectors: DataFrame, cells: int | None = None) -> np.ndarray:
    """Centroids for the live vectors of the largest dimension: about as many as the root of their number, from a sample by hash of the id."""
    live = _live(vectors)
    n, dim = live.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return np.zeros((0, 0))
    most = max(1, min(SAMPLE, SAMPLE_COMPONENTS // max(1, dim)))
    sample = live.filter(valid(F.col("embedding"), dim)).orderBy(F.xxhash64("id"), "id").limit(most).select("embedding").toArrow()  # at most 128 MB
    if not sample.num_rows:
        return np.zeros((0, 0))
    return fitted(_matrix(sample.column("embedding").combine_chunks()), cells or min(MOST_CELLS, max(1, int(n**0.5))))


def _live(vectors: DataFrame) -> DataFrame:
    return vectors.filter("NOT tombstoned") if "tombstoned" in vectors.columns else vectors


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(cell, id, embedding, distance) of valid vectors of the centroids' dimension: the cell is the nearest centroid's."""
    dim, kind = centres.shape[1], dict(vectors.dtypes)["id"]
    sent = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                cell = _nearest(x, sent.value)
                far = np.linalg.norm(x - sent.value[cell], axis=1)
                yield pa.record_batch([pa.array(cell, pa.int32()), b.column(0), b.column(1), pa.array(far)], ["cell", "id", "embedding", "distance"])

    rows = _live(vectors).filter(valid(F.col("embedding"), dim)).select("id", F.col("embedding").cast("array<float>"))
    return rows.mapInArrow(run, f"cell int, id {kind}, embedding array<float>, distance double")


def cells_of(rows: DataFrame, centres: np.ndarray) -> Cells:
    """Centroids with their radii, from the assigned rows."""
    radius = np.zeros(len(centres))
    for r in rows.groupBy("cell").agg(F.max("distance").alias("r")).collect():  # a row for each cell
        radius[r["cell"]] = r["r"]
    return Cells(centres, radius)


def nearest(rows: DataFrame, cells: Cells, query: Sequence[float], k: int, probes: int = 8, exact: bool = True, among: DataFrame | None = None) -> DataFrame:
    """(id, similarity) of the k of highest inner product with one query, ties to smaller ids; `among`: only these ids count.

    Reads `probes` cells, and in exact searches those others that may hold one of the k best.
    """
    q = np.asarray(query, np.float64)
    bound = cells.bound(q[None, :])[0]
    order = np.argsort(-(cells.centroids @ q), kind="stable")

    def best(of: np.ndarray) -> DataFrame:
        held = rows.filter(F.col("cell").isin([int(c) for c in of]))
        held = held if among is None else held.join(among.select("id"), "id", "left_semi")
        return held.select("id", dot(F.col("embedding"), literal(q)).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)

    first, rest = order[:probes], order[probes:]
    found = best(first)
    if not exact or not len(rest):
        return found
    held = found.collect()  # k rows
    least = held[-1]["similarity"] if len(held) == k else -np.inf
    more = rest[bound[rest] >= least - 1e-6 * (1 + abs(least))]
    near = rows.sparkSession.createDataFrame(held, found.schema)
    return near if not len(more) else near.unionByName(best(more)).orderBy(F.desc("similarity"), "id").limit(k)


def nearest_each(rows: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int = 8, exact: bool = True) -> DataFrame:
    """(query_id, rank, id, similarity): each query's k nearest but itself, ties to smaller ids. Queries go in blocks of bounded size.

    A block's vectors are broadcast with the cells that each of them looks at; tasks multiply only these cells' vectors and keep k for each
    query. In exact searches a second pass reads what the first one's k-th best does not rule out.
    """
    spark = rows.sparkSession
    kind = dict(rows.dtypes)["id"]
    queries = queries.filter(valid(F.col("embedding"), cells.centroids.shape[1]))
    n = queries.count()
    blocks = -(-n // BLOCK)
    schema = f"q long, id {kind}, similarity double"
    out = None

    def searched(ids: list, m: np.ndarray, wanted: np.ndarray, least: np.ndarray) -> DataFrame:
        """What the cells that queries want hold above the queries' least similarity: k for each query and task."""
        sent = spark.sparkContext.broadcast((ids, m, wanted, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, m, wanted, least = sent.value
            place = {x: i for i, x in enumerate(ids)}
            held: dict[int, list] = {}
            for b in batches:
                cell, own = b.column(0).to_numpy(), b.column(1).to_pylist()
                x = _matrix(b.column(2)) if b.num_rows else np.zeros((0, m.shape[1]))
                mine = np.array([place.get(i, -1) for i in own], np.int64)
                for c in np.unique(cell):
                    at, ask = np.flatnonzero(cell == c), np.flatnonzero(wanted[:, c])
                    if not len(ask):
                        continue
                    s = np.round(m[ask] @ x[at].T, 12)  # equal vectors tie, wherever they stand in a product
                    s[ask[:, None] == mine[at][None, :]] = -np.inf
                    for row, q in enumerate(ask):
                        good = np.flatnonzero(s[row] >= least[q])
                        if len(good) > k:
                            bar = np.partition(s[row, good], len(good) - k)[len(good) - k]
                            good = good[s[row, good] >= bar]
                        if len(good):
                            both = held.setdefault(int(q), []) + [(-float(s[row, j]), own[at[j]]) for j in good if np.isfinite(s[row, j])]
                            held[int(q)] = sorted(both)[:k]
            rows = [(q, i, -s) for q, best in held.items() for s, i in best]
            kinds = (pa.int64(), kind_of, pa.float64())
            yield pa.record_batch([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["q", "id", "similarity"])

        kind_of = pa.string() if kind == "string" else pa.int64()
        asked = [int(c) for c in np.flatnonzero(wanted.any(0))]
        return rows.filter(F.col("cell").isin(asked)).select("cell", "id", "embedding").mapInArrow(run, schema)

    def top(df: DataFrame) -> DataFrame:
        w = Window.partitionBy("q").orderBy(F.desc("similarity"), "id")
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    for at in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == at).select("id", "embedding").toArrow()
        if not part.num_rows:
            continue
        ids, m = part.column("id").to_pylist(), _matrix(part.column("embedding").combine_chunks())
        order = np.argsort(-(m @ cells.centroids.T), axis=1, kind="stable")
        wanted = np.zeros((len(ids), len(cells.centroids)), bool)
        np.put_along_axis(wanted, order[:, :probes], True, axis=1)
        least = np.full(len(ids), -np.inf)
        found = top(searched(ids, m, wanted, least))
        if exact and probes < len(cells.centroids):
            rows_found = found.select("q", "id", "similarity", "rank").toArrow()  # k for each query of the block
            q, s, r = (rows_found.column(c).to_numpy() for c in ("q", "similarity", "rank"))
            full = r == k
            least[q[full]] = s[full]
            slack = np.where(np.isfinite(least), 1e-6 * (1 + np.abs(least)), 0.0)
            more = ~wanted & (cells.bound(m) >= (least - slack)[:, None])
            found = spark.createDataFrame(rows_found.select(["q", "id", "similarity"]))
            if more.any():
                found = found.unionByName(searched(ids, m, more, least - slack))
            found = top(found)
        names = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": pa.array(ids)}))
        found = found.join(F.broadcast(names), "q").select("query_id", "rank", "id", "similarity")  # a block's names
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id {kind}, rank int, id {kind}, similarity double")
