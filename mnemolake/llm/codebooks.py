"""Compression of vectors to codes: integer codebooks for parts of the vector, refined in rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import materialize, released, table

#: Components are floored to 1 / SCALE; beyond LIMIT they count as LIMIT, so that squared distances of parts of 16 fit a long.
SCALE, LIMIT = 1024.0, 1 << 28
#: Vectors whose distances are computed together: with 256 entries a work array of 2 MB.
TILE = 1024


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, v, label) of the rows whose vector is there, with all components there and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))


def integers(column: pa.ListArray, parts: int, width: int) -> np.ndarray:
    """Floored components by part, vector and position; vectors shorter than parts * width end in zeros."""
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), parts * width), np.int64)
    out[np.arange(parts * width)[None, :] < size[:, None]] = np.clip(flat, -LIMIT, LIMIT).astype(np.int64)
    return out.reshape(len(column), parts, width).transpose(1, 0, 2)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact int64 matrix product; by way of doubles where no partial sum can leave the range in which these are exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if most < 2.0**53 else a @ b


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest entry (the first of equals) and its squared distance: |x|^2 - 2 x.c + |c|^2 in whole numbers."""
    code, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norm = (book * book).sum(1)
    for at in range(0, len(x), TILE):
        tile = x[at : at + TILE]
        d = (tile * tile).sum(1)[:, None] - 2 * _product(tile, book.T) + norm[None, :]
        code[at : at + TILE] = d.argmin(1)
        distance[at : at + TILE] = d.min(1)
    return code, distance


def first_codebooks(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """The parts of the `entries` smallest ids' vectors, (parts, entries, width); None if there are no vectors."""
    widest = vectors.agg(F.max(F.size("v"))).first()[0]
    if widest is None:
        return None
    rows = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").toArrow()  # a codebook's rows
    return integers(rows.column("v").combine_chunks(), parts, -(-widest // parts))


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry becomes the floored mean of the parts nearest to it, unused ones stay."""
    parts, entries, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the task's vectors add to each entry: one row for each entry that is used."""
        sums, used = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            for p, x in enumerate(integers(b.column(0), parts, width)):
                code, _ = nearest(x, sent.value[p])
                order = np.argsort(code, kind="stable")
                own, first, n = np.unique(code[order], return_index=True, return_counts=True)
                used[p, own] += n
                if len(own):
                    sums[p, own] += np.add.reduceat(x[order], first, axis=0)
        part, entry = np.nonzero(used)
        offsets = np.arange(len(part) + 1, dtype=np.int32) * width
        yield pa.record_batch([pa.array(part), pa.array(entry), pa.array(used[part, entry]), pa.ListArray.from_arrays(offsets, sums[part, entry].ravel())], ["part", "entry", "n", "sums"])

    tallies = vectors.select("v").mapInArrow(released(tally), "part long, entry long, n long, sums array<long>")
    merged = tallies.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    out = books.copy()
    for r in merged.collect():  # a row for each entry
        out[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray | None:
    """Codebooks of `usable` vectors after `rounds` rounds; each round reads them once and shuffles one row per task and entry."""
    if not 1 <= entries <= 256:
        raise ValueError("a code holds one byte for each part: 1 to 256 entries")
    books = first_codebooks(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = refined(vectors, books)
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error): a byte for each part in two hex digits, and the squared distances of all parts together."""
    parts, _, width = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [nearest(x, sent.value[p]) for p, x in enumerate(integers(b.column(1), parts, width))]
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            yield pa.record_batch([b.column(0), b.column(2), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found))], ["id", "label", "code", "error"])

    schema = f"id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    return vectors.select("id", "v", "label").mapInArrow(released(run), schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Codes of `usable` vectors under codebooks trained on all of them: vec_id, code, error, label_error, codebooks_sha256.

    label_error adds the errors of equal labels, null ones together. Vectors are cut into `parts` equal parts; if the longest does not
    divide, and where one is shorter, zeros follow. With fewer vectors than entries there are fewer entries. Ties go to the lower entry;
    rows with equal ids each count, and come by their vectors among the first; null ids come last. No rows give no rows. Texts play no part.
    Five scans of the vectors: bring them as a stored table.
    """
    books = train(vectors, parts, entries, rounds)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(encode(vectors, books), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(usable(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    """The rounds written out. Distances are whole numbers in doubles; distance * 256 + entry finds the first of the nearest."""
    near = "min(CAST(list_dot_product(x.v, x.v) - 2 * list_dot_product(x.v, b.v) + list_dot_product(b.v, b.v) AS BIGINT) * 256 + b.c)"
    out = [
        """WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, vec_id, p, e[p * len(e) // 4 + 1 : (p + 1) * len(e) // 4] AS v FROM kept, (SELECT range AS p FROM range(4))),
b0 AS MATERIALIZED (SELECT p, c, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id, r) - 1 AS c FROM x) WHERE c < 256)"""
    ]
    for k in range(1, 5):
        out.append(f"""a{k} AS MATERIALIZED (SELECT x.r, x.p, {near} % 256 AS c FROM x JOIN b{k - 1} b USING (p) GROUP BY x.r, x.p),
m{k} AS (
  SELECT p, c, list(v ORDER BY i) AS v FROM (
    SELECT p, c, i, floor(sum(x.v[i]) / count(*)) AS v FROM a{k} JOIN x USING (r, p), (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM b0))) AS i) GROUP BY p, c, i)
  GROUP BY p, c),
b{k} AS MATERIALIZED (SELECT b.p, b.c, coalesce(m.v, b.v) AS v FROM b{k - 1} b LEFT JOIN m{k} m USING (p, c))""")
    out.append(f"""z AS MATERIALIZED (SELECT x.r, x.p, {near} AS n FROM x JOIN b4 b USING (p) GROUP BY x.r, x.p),
f AS (SELECT r, string_agg(lpad(lower(to_hex(n % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(n // 256) AS BIGINT) AS error FROM z GROUP BY r),
h AS (SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, c, i)) AS codebooks_sha256 FROM b4, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM b0))) AS i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f JOIN kept USING (r), h""")
    return ",\n".join(out)


OP12_SQL = _sql()
