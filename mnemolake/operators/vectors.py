"""Vector search, similarity joins and clustering."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def normalise(v: Column) -> Column:
    """Divided by its length; a vector of zeros stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def valid(v: Column, dim: int) -> Column:
    """Of the given length, with finite components only."""
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str = "id") -> DataFrame:
    """The k live vectors of highest inner product with one query, ties to smaller keys. One pass, k rows per task shuffled."""
    live = vectors.filter("NOT tombstoned") if "tombstoned" in vectors.columns else vectors
    return live.select(key, dot(F.col("embedding"), literal(query)).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """k nearest for each query, queries taken in blocks of bounded size against all rows.

    A block is broadcast as one matrix; tasks keep their own k best per query, so at most tasks x k rows per query
    are shuffled. Returns query_id, rank, id, similarity.
    """
    spark = vectors.sparkSession
    live = vectors.filter("NOT tombstoned") if "tombstoned" in vectors.columns else vectors
    n = queries.count()
    out = None
    for at in range(-(-n // block)):
        part = queries.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // block))) == at).select("id", "embedding").toPandas()
        if not len(part):
            continue
        sent = spark.sparkContext.broadcast((part["id"].to_numpy(), np.stack([np.asarray(v, float) for v in part["embedding"]])))

        def best(frames, sent=sent):
            ids, m = sent.value
            for pdf in frames:
                if not len(pdf):
                    continue
                s = np.stack([np.asarray(v, float) for v in pdf["embedding"]]) @ m.T
                own = pdf["id"].to_numpy()
                rows = []
                for q in range(len(ids)):
                    order = np.lexsort((own, -s[:, q]))
                    order = order[own[order] != ids[q]][:k]
                    rows.append(pd.DataFrame({"query_id": ids[q], "id": own[order], "similarity": s[order, q]}))
                yield pd.concat(rows)

        found = live.select("id", "embedding").mapInPandas(best, "query_id long, id long, similarity double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def similar_pairs(left: DataFrame, right: DataFrame, by: Sequence[str], at_least: float) -> DataFrame:
    """Pairs of the same group whose vectors' inner product reaches a bound: (by, a, b, similarity).

    Groups are a topic's or a scope's records, as the callers have them; without any, the whole tables are one.
    """
    a = left.select(*by, F.col("id").alias("a"), F.col("embedding").alias("x"))
    b = right.select(*by, F.col("id").alias("b"), F.col("embedding").alias("y"))
    pairs = a.join(b, list(by)) if by else a.crossJoin(b)
    return pairs.withColumn("similarity", dot(F.col("x"), F.col("y"))).filter(F.col("similarity") >= at_least).select(*by, "a", "b", "similarity")


def nearest_duplicates(new: DataFrame, stored: DataFrame, at_least: float, by: Sequence[str] = ()) -> DataFrame:
    """For each new item the most similar stored one of its group that reaches a bound (id, duplicate_of), ties to smaller ids.

    Exact: every new item is compared with every stored one of its group. New items go in blocks against one pass over the stored ones:
    tasks multiply matrices and keep one candidate for each item, so no pair is formed and what is shuffled is items x tasks at most.
    Similarities that agree to twelve decimals are ties. Items and stored ones without a vector, or without a group, match nothing.
    """
    spark, kind = new.sparkSession, dict(stored.dtypes)["id"]
    own = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by]) if by else F.lit("")
    grouped = [F.col(c).isNotNull() for c in by]
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    rows = lambda df: df.filter(reduce(lambda a, b: a & b, grouped, whole)).select("id", own.alias("g"), "embedding")
    asked, held = rows(new), rows(stored)
    blocks = -(-asked.count() // MATCH_BLOCK)
    out = None
    for at in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == at).toArrow()  # MATCH_BLOCK rows or so
        if not block.num_rows:
            continue
        groups: dict[tuple, list[int]] = {}
        vectors = block.column("embedding").to_pylist()
        for i, (g, v) in enumerate(zip(block.column("g").to_pylist(), vectors, strict=True)):
            groups.setdefault((g, len(v)), []).append(i)
        sent = spark.sparkContext.broadcast({k: (np.array(i), np.array([vectors[j] for j in i], float)) for k, i in groups.items()})
        n = block.num_rows

        def match(batches, sent=sent, n=n):
            """The best stored item of a task for each new one that has any: (place in the block, b, similarity)."""
            best, mate = np.full(n, -np.inf), np.empty(n, object)
            for b in batches:
                ids, lists = b.column(0).to_pylist(), b.column(2)
                flat, edge = lists.flatten().to_numpy(zero_copy_only=False).astype(float), lists.offsets.to_numpy()
                edge = edge - edge[0]
                there: dict[tuple, list[int]] = {}
                for i, g in enumerate(b.column(1).to_pylist()):
                    there.setdefault((g, int(edge[i + 1] - edge[i])), []).append(i)
                for key, at in there.items():
                    if key not in sent.value:
                        continue
                    place, m = sent.value[key]
                    x = flat.reshape(len(ids), key[1])[at] if len(there) == 1 else np.array([flat[edge[i] : edge[i + 1]] for i in at])
                    for first in range(0, len(at), 1024):
                        s = np.round(m @ x[first : first + 1024].T, 12)
                        top = s.max(axis=1)
                        for row in np.flatnonzero((top >= at_least) & (top >= best[place])):
                            least = min(ids[at[first + j]] for j in np.flatnonzero(s[row] == top[row]))
                            p = place[row]
                            if top[row] > best[p] or least < mate[p]:
                                best[p], mate[p] = top[row], least
            hit = np.flatnonzero(best > -np.inf)
            yield pa.record_batch([pa.array(hit), pa.array([mate[i] for i in hit], pa.string() if kind == "string" else pa.int64()), pa.array(best[hit])], ["q", "b", "s"])

        found = held.mapInArrow(match, f"q long, b {kind if kind == 'string' else 'long'}, s double").groupBy("q").agg(F.min(F.struct((-F.col("s")).alias("s"), "b")).alias("m"))
        names = spark.createDataFrame(pa.table({"q": np.arange(n), "id": block.column("id")}))
        found = found.join(F.broadcast(names), "q").select("id", F.col("m.b").cast(kind).alias("duplicate_of"))  # a block's names
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"id {dict(new.dtypes)['id']}, duplicate_of {kind}")


#: New items that are compared together: what is collected and broadcast at once grows with them.
MATCH_BLOCK = 8192


#: Rows of one group and side that a task compares at once, products of vectors that it holds, and bins that small groups share.
CELL_ROWS, CELL_STEP, CELL_BINS = 8192, 1024, 4096


def _in_order(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows x[i] and y[j], added up in the order of `dot`, so that equal ones are equal to the last bit."""
    s = np.zeros(len(i))
    for k in range(x.shape[1]):
        s += x[i, k] * y[j, k]
    return s


def _slack(x: np.ndarray, y: np.ndarray) -> float:
    """By how much a matrix product may differ from the sum in order, at most."""
    longest = [np.max(n, initial=0.0, where=np.isfinite(n)) for n in (np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))]
    return 4.0 * (x.shape[1] + 1) * np.finfo(float).eps * longest[0] * longest[1]


def _single(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both sides in single precision, and by how much more their product may then differ; unchanged, if that could overflow."""
    if not (np.abs(x).max(initial=0.0) <= 1e10 and np.abs(y).max(initial=0.0) <= 1e10):
        return x, y, 0.0
    return x.astype(np.float32), y.astype(np.float32), _slack(x, y) * float(np.finfo(np.float32).eps / np.finfo(float).eps) + 1e-20


def _classes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct vector, and each row's place among these."""
    if not x.shape[1]:
        return np.zeros(min(1, len(x)), int), np.zeros(len(x), int)
    _, first, place = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_index=True, return_inverse=True)
    return first, place


def _compared(left: DataFrame, right: DataFrame, by: Sequence[str], work: Callable, schema: str, same: bool = False) -> DataFrame:
    """`work` on blocks of both sides' rows (by, id, embedding, more) of one group: all blocks of one side meet all of the other.

    Groups above CELL_ROWS are cut into blocks, small ones share bins; a pair of blocks is a key of its own, so no task holds a
    group and no pair becomes a row. A row is sent once for each block of the other side. work(group's columns, rows, vectors,
    rows, vectors, diagonal) gives columns, which follow the group's. `same`: both sides are one table, a pair of its blocks meets once.
    Rows without a vector, or without a group, take no part, and vectors of different lengths do not meet.
    """
    keys = [*by, "__d"]
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by], F.col("id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    sides = [df.filter(whole).withColumn("__d", F.size("embedding")) for df in (left, right)]
    large = [df.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias(n)).filter(f"{n} > 1") for df, n in zip(sides, ("__na", "__nb"), strict=True)]
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * left.sparkSession.sparkContext.defaultParallelism)
    cells = ["__bin", "__i", "__j"]

    def dealt(df: DataFrame, own: str, other: str, first: bool) -> DataFrame:
        for n in large:  # one row for each CELL_ROWS of the table at most
            df = df.join(F.broadcast(n), keys, "left")
        mine = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int")
        df = df.withColumns({"__bin": F.pmod(F.xxhash64(*keys), F.lit(CELL_BINS)), own: mine, other: F.coalesce(other, F.lit(1)) - 1})
        start, end = (F.col(own) if same and first else F.lit(0)), (F.col(own) if same and not first else F.col(other))
        df = df.withColumn("__o", F.explode(F.sequence(start, end)))
        df = df.withColumns({"__i": F.col(own if first else "__o"), "__j": F.col("__o" if first else own)}).drop("__na", "__nb", "__o")
        return df.select(*[F.col(c).alias(c) for c in df.columns]).repartition(parts, *cells)  # aliases: both sides may be one table

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        def groups(t: pa.Table) -> dict[tuple, list[int]]:
            out: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*(t.column(c).to_pylist() for c in keys), strict=True)):
                out.setdefault(k, []).append(i)
            return out

        def matrix(t: pa.Table, d: int) -> np.ndarray:
            return t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, d)

        out, there = [], groups(b)
        for k, at in groups(a).items():
            if k in there:
                x, y = a.take(at), b.take(there[k])
                found = work(x, matrix(x, k[-1]), y, matrix(y, k[-1]), same and key[1].as_py() == key[2].as_py())
                n = len(found[0])
                out.append(pa.table([pa.repeat(x.column(c)[0], n) for c in by] + [pa.array(c) if not isinstance(c, pa.Array | pa.ChunkedArray) else c for c in found], names=names))
        return pa.concat_tables(out).cast(shape) if out else shape.empty_table()

    kinds = dict(left.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), schema])
    shape = to_arrow_schema(left.sparkSession.createDataFrame([], schema).schema)
    names = shape.names
    if same:
        sides[1], large[1] = sides[0], large[0].withColumnRenamed("__na", "__nb")
    a, b = dealt(sides[0], "__na", "__nb", True), dealt(sides[1], "__nb", "__na", False)
    return a.groupBy(*cells).cogroup(b.groupBy(*cells)).applyInArrow(run, schema)


def similar_pair_counts(rows: DataFrame, by: Sequence[str], at_least: float) -> DataFrame:
    """How many pairs a < b of a group reach a bound: (by, n), groups with a pair. Exact, by products of blocks."""

    def work(a: pa.Table, x: np.ndarray, b: pa.Table, y: np.ndarray, diagonal: bool) -> list:
        slack, n = _slack(x, y), 0
        before = np.full(len(y), len(x))
        if diagonal:
            ids = np.array(a.column("id").to_pylist())
            order = np.argsort(ids, kind="stable")
            x = y = x[order]
            before = np.searchsorted(ids[order], ids[order])  # rows with a smaller id than the column's
        for r in range(0, len(x), CELL_STEP):
            for c in range(r if diagonal else 0, len(y), CELL_STEP):
                s = x[r : r + CELL_STEP] @ y[c : c + CELL_STEP].T
                if diagonal:
                    s[np.arange(r, r + len(s))[:, None] >= before[c : c + CELL_STEP]] = -np.inf
                sure, likely = s.size - np.count_nonzero(s < at_least + slack), s.size - np.count_nonzero(s < at_least - slack)
                n += sure
                if likely > sure:
                    i, j = np.nonzero((s >= at_least - slack) & (s < at_least + slack))
                    n += int(np.count_nonzero(_in_order(x, y, i + r, j + c) >= at_least))
        return [[n]]

    found = _compared(rows.select(*by, "id", "embedding"), rows.select(*by, "id", "embedding"), by, work, "n long", same=True)
    return found.groupBy(*by).agg(F.sum("n").alias("n")).filter("n > 0")


def contradiction_candidates(new: DataFrame, old: DataFrame, by: Sequence[str] = ("topic_id",), at_least: float = 0.7, most: int = 24) -> DataFrame:
    """The most similar new x old pairs of each topic: (by, a, b, similarity, rank), ties to smaller a, then b.

    Each pair of blocks gives its best pairs only. Of equal vectors a block needs the `most` smallest ids. Products in single
    precision show which rows may have a pair good enough; those are multiplied again in doubles.
    """

    def first_ids(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        _, place = _classes(x)
        order = np.lexsort((ids, place))
        starts = np.searchsorted(place[order], place[order])
        return order[np.arange(len(order)) - starts < most]

    def work(a: pa.Table, x: np.ndarray, b: pa.Table, y: np.ndarray, diagonal: bool) -> list:
        slack, ids, mates = _slack(x, y), np.array(a.column("id").to_pylist()), np.array(b.column("id").to_pylist())
        p, q = first_ids(ids, x), first_ids(mates, y)
        x, ids, y, mates = x[p], ids[p], y[q], mates[q]
        best, least = (np.zeros(0, int), np.zeros(0, int), np.zeros(0)), at_least - slack
        u, w, rough = _single(x, y)
        for r in range(0, len(x), CELL_STEP):
            for c in range(0, len(y), CELL_STEP):
                top = (u[r : r + CELL_STEP] @ w[c : c + CELL_STEP].T).max(axis=1).astype(float)
                some = np.flatnonzero(~(top < least - rough))
                s = x[r + some] @ y[c : c + CELL_STEP].T
                i, j = np.nonzero(~(s < least))
                if len(i) > most:
                    kth = np.partition(s[i, j], -most)[-most]  # numbers that are none come last
                    keep = ~(s[i, j] < (np.inf if np.isnan(kth) else kth - 2 * slack))
                    i, j = i[keep], j[keep]
                if not len(i):
                    continue
                i, j = r + some[i], j + c
                v = _in_order(x, y, i, j)
                keep = ~(v < at_least)
                i, j, v = (np.concatenate(t) for t in zip(best, (i[keep], j[keep], v[keep]), strict=True))
                order = np.lexsort((mates[j], ids[i], -v, ~np.isnan(v)))[:most]
                best = i[order], j[order], v[order]
                if len(order) == most:
                    least = max(least, np.inf if np.isnan(v[order[-1]]) else v[order[-1]] - slack)
        return [a.column("id").take(pa.array(p[best[0]])), b.column("id").take(pa.array(q[best[1]])), best[2]]

    rows = lambda df: df.select(*by, "id", "embedding")
    found = _compared(rows(new), rows(old), by, work, f"a {dict(new.dtypes)['id']}, b {dict(old.dtypes)['id']}, similarity double")
    w = Window.partitionBy(*by).orderBy(F.desc("similarity"), "a", "b")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def most_similar(left: DataFrame, right: DataFrame, by: Sequence[str], at_least: float = float("-inf"), last: bool = False) -> DataFrame:
    """For each left row the most similar right one of its group: (by, id, mate, similarity), ties to smaller ids, to larger ones if `last`.

    Where left rows have a number `from` and right ones a number `at`, only mates with at >= from count. Exact: each pair of blocks
    gives one mate for each of its left rows.
    """
    timed = "from" in left.columns

    def work(a: pa.Table, x: np.ndarray, b: pa.Table, y: np.ndarray, diagonal: bool) -> list:
        slack, mates = _slack(x, y), np.array(b.column("id").to_pylist())
        first, place = _classes(y)
        order = np.lexsort((mates, place))
        if last:
            order = order[::-1]
        held = {int(place[m[0]]): m for m in np.split(order, np.flatnonzero(np.diff(place[order])) + 1)}
        y = y[first]
        if timed:
            since, at = a.column("from").to_numpy(), b.column("at").to_numpy()
            latest = np.array([at[held[k]].max() for k in range(len(y))])

        def mate(r: int, k: int) -> int:
            """The first of equal vectors' rows that a left row may have."""
            m = held[k]
            return int(m[0] if not timed or len(m) == 1 else m[np.argmax(at[m] >= since[r])])

        ahead = lambda v, m, w, n: (np.isnan(v), v, m if last else 0) > (np.isnan(w), w, n if last else 0) if v != w else (m > n if last else m < n)
        best: dict[int, tuple] = {}
        for r in range(0, len(x), CELL_STEP):
            top, taken = np.full(min(CELL_STEP, len(x) - r), at_least), []
            for c in range(0, len(y), CELL_STEP):
                s = x[r : r + CELL_STEP] @ y[c : c + CELL_STEP].T
                np.copyto(s, np.inf, where=np.isnan(s))
                if timed:
                    may = latest[c : c + CELL_STEP] >= since[r : r + CELL_STEP, None]
                    s[~may] = -np.inf
                top = np.maximum(top, s.max(axis=1))
                i, j = np.nonzero(s >= (top - 2 * slack)[:, None])
                if timed:
                    i, j = i[may[i, j]], j[may[i, j]]
                taken.append((i, j + c, s[i, j]))
            i, j, s = (np.concatenate(t) for t in zip(*taken, strict=True))
            keep = s >= top[i] - 2 * slack
            i, j = i[keep] + r, j[keep]
            for row, k, v in zip(i.tolist(), j.tolist(), _in_order(x, y, i, j).tolist(), strict=True):
                if not v < at_least:
                    m = mate(row, k)
                    if row not in best or ahead(v, mates[m], best[row][1], mates[best[row][0]]):
                        best[row] = m, v
        rows = list(best)
        return [a.column("id").take(pa.array(rows, pa.int64())), b.column("id").take(pa.array([best[r][0] for r in rows], pa.int64())), pa.array([best[r][1] for r in rows], pa.float64())]

    found = _compared(left.select(*by, "id", "embedding", *(["from"] if timed else [])), right.select(*by, "id", "embedding", *(["at"] if timed else [])), by, work, f"id {dict(left.dtypes)['id']}, mate {dict(right.dtypes)['id']}, similarity double")
    if last:
        pick = F.max(F.struct("similarity", "mate"))
        return found.groupBy(*by, "id").agg(pick.alias("m")).select(*by, "id", "m.mate", "m.similarity")
    w = Window.partitionBy(*by, "id").orderBy(F.desc("similarity"), "mate")
    return found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def silent_drops(before: DataFrame, merged: DataFrame, by: Sequence[str] = ("topic_id",), below: float = 0.5) -> DataFrame:
    """Records from before a merge that nothing merged of their group resembles."""
    return before.select(*by, "id").join(nearest_duplicates(before, merged, below, by).select("id"), "id", "left_anti")


def supersession(records: DataFrame, as_of: Column, at_least: float = 0.5) -> DataFrame:
    """For each expired record of a topic the most similar unexpired one created at or after its end."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    old = records.filter(F.col("valid_until") <= as_of).select("topic_id", "id", "embedding", micros("valid_until").alias("from"))
    new = records.filter((F.col("valid_until").isNull() | (F.col("valid_until") > as_of)) & F.col("created_at").isNotNull()).select("topic_id", "id", "embedding", micros("created_at").alias("at"))
    return most_similar(old, new, ["topic_id"], at_least).select("id", F.col("mate").alias("superseded_by"), "similarity")


def average_linkage(similarity: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers by joining the two clusters of highest mean similarity while it reaches `cut`."""
    n = len(similarity)
    s = similarity.astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - 1):
        i, j = divmod(int(s.argmax()), n)
        if s[i, j] < cut:
            break
        i, j = min(i, j), max(i, j)
        merged = (s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j])
        s[i], s[:, i] = merged, merged
        s[i, i] = -np.inf
        s[j], s[:, j] = -np.inf, -np.inf
        s[i, ~alive] = s[~alive, i] = -np.inf
        alive[j] = False
        s[i, j] = s[j, i] = -np.inf
        size[i] += size[j]
        label[label == j] = i
    return label


def linkage_by_sums(m: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers as average_linkage gives them, from the vectors: no matrix of pairs is held.

    A cluster's mean similarity to another is the product of their sums over their sizes. Chains of nearest neighbours end
    in pairs that are nearest to each other, and joining these in any order gives the same tree (ties apart).
    """
    n = len(m)
    sums, size, alive, label = m.astype(float).copy(), np.ones(n), np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    for start in range(n):
        if not alive[start]:
            continue
        chain = [start]
        while chain:
            i = chain[-1]
            s = sums @ sums[i] / (size * size[i])
            s[~alive] = -np.inf
            s[i] = -np.inf
            j = int(s.argmax())
            if s[j] < cut:
                # Nothing will ever be nearer to i: means of others are no higher than their parts'. The chain's rest goes on.
                alive[i] = False
                chain.pop()
            elif len(chain) > 1 and s[chain[-2]] >= s[j]:
                j = chain[-2]
                del chain[-2:]
                i, j = min(i, j), max(i, j)
                sums[i] += sums[j]
                size[i] += size[j]
                alive[j] = False
                label[label == j] = i
                if not chain:
                    chain = [i]
            else:
                chain.append(j)
    return label


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component among n, by links a - b."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def linked_parts(m: np.ndarray, cut: float, block: int) -> np.ndarray:
    """The component of each vector by links of similarity `cut`, from products of block x block."""
    n = len(m)
    root = np.arange(n)
    for x in range(0, n, block):
        for y in range(x, n, block):
            a, b = np.nonzero(m[x : x + block] @ m[y : y + block].T >= cut - 1e-9)
            # Links inside a component already known add nothing.
            a, b = root[a + x], root[b + y]
            new = a != b
            if new.any():
                root = _roots(n, np.concatenate((np.arange(n), a[new])), np.concatenate((root, b[new])))
    return root


def cluster(episodes: DataFrame, by: Sequence[str], similarity: float = 0.78, min_size: int = 2, block: int = 2000) -> DataFrame:
    """Average-linkage clusters inside each scope: adds cluster (smallest member's id) to members of clusters of min_size.

    A scope of more than `block` episodes is cut into the components of its links: clusters whose mean similarity
    reaches the bound hold a pair that does, so none lies in two components, and the result is the whole scope's. A
    scope is worked on in one task, which holds its vectors and at most block x block similarities at once.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.stack([np.asarray(v, float) for v in pdf["embedding"]])
        ids = pdf["id"].to_numpy()
        label = np.arange(len(ids))
        part = linked_parts(m, similarity, block) if len(ids) > block else np.zeros(len(ids), int)
        order = np.argsort(part, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(rows) > 1:
                x = m[rows]
                label[rows] = rows[linkage_by_sums(x, similarity) if len(rows) > block else average_linkage(x @ x.T, similarity)]
        count = np.bincount(label, minlength=len(ids))
        keep = count[label] >= min_size
        return pd.DataFrame({"id": ids[keep], "cluster": ids[label[keep]]})

    kind = dict(episodes.dtypes)["id"]
    return episodes.select(*by, "id", "embedding").groupBy(*by).applyInPandas(work, f"id {kind}, cluster {kind}")


def cluster_confidence(members: DataFrame, coherence_weight: float = 0.6, surprise_weight: float = 0.4) -> DataFrame:
    """Confidence of clusters (cluster, id, embedding, surprise_score): mean similarity of pairs and mean surprise.

    The mean over pairs comes from the sum of the vectors: (|sum|^2 - sum of |v|^2) / (n (n - 1)), so no pair is formed.
    """
    each = members.select("cluster", "id", "surprise_score", F.posexplode("embedding").alias("at", "x"))
    sums = each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.pow(F.col("x").cast("double"), 2)).alias("q")).groupBy("cluster").agg(F.sum(F.col("s") * F.col("s")).alias("whole"), F.sum("q").alias("own"))
    per = members.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("surprise_score").alias("surprise"))
    coherence = F.when(F.col("n") < 2, 0.8).otherwise((F.col("whole") - F.col("own")) / (F.col("n") * (F.col("n") - 1)))
    value = coherence * coherence_weight + F.col("surprise") * surprise_weight
    return per.join(sums, "cluster").select("cluster", "n", F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.95), value)), 2).alias("confidence"))


def greedy_dedup(batch: DataFrame, by: Sequence[str], order: str = "id", at_least: float = 0.95) -> DataFrame:
    """Marks batch items too similar to one already accepted in their scope, in the given order (adds duplicate_of).

    The rule depends on order, so a scope's batch is worked on in one task; a batch is what one ingest call brings.
    """

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        ids, m = pdf["id"].tolist(), np.stack([np.asarray(v, float) for v in pdf["embedding"]])
        kept: list[int] = []
        rows = []
        for i, x in enumerate(m):
            near = m[kept] @ x if kept else np.zeros(0)
            if near.max(initial=-2.0) >= at_least:
                rows.append((ids[i], min(ids[kept[j]] for j in np.flatnonzero(near == near.max()))))
            else:
                kept.append(i)
                rows.append((ids[i], None))
        out = pd.DataFrame(rows, columns=["id", "duplicate_of"])
        return out if kind == "string" else out.astype({"duplicate_of": "Int64"})

    kind = dict(batch.dtypes)["id"]
    return batch.groupBy(*by).applyInPandas(work, f"id {kind}, duplicate_of {kind}")
