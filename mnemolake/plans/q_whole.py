"""Vector queries over every row.

Searches take the ids divisible by 100 as queries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemolake.operators import vector_index, vectors
from mnemolake.operators.evaluate import recall_at
from mnemolake.registry import query

_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_QUERIES = "id % 100 = 0"


@query("ag17w_cluster_confidence", """
WITH m AS (SELECT label AS cluster, id, CAST(embedding AS DOUBLE[]) AS v, CAST(id * 37 % 91 + 10 AS DOUBLE) / 100 AS surprise FROM vectors),
p AS (SELECT a.cluster, avg(list_dot_product(a.v, b.v)) AS coherence FROM m a JOIN m b ON a.cluster = b.cluster AND a.id < b.id GROUP BY a.cluster),
s AS (SELECT cluster, count(*) AS n, avg(surprise) AS surprise FROM m GROUP BY cluster)
SELECT s.cluster, n, round(greatest(0.5::DOUBLE, least(0.95::DOUBLE, coalesce(coherence, 0.8::DOUBLE) * 0.6::DOUBLE + surprise * 0.4::DOUBLE)), 2) AS confidence FROM s LEFT JOIN p USING (cluster)
""")
def _(e):
    m = e.vectors.select(F.col("label").alias("cluster"), "id", "embedding", (F.expr("id * 37 % 91 + 10").cast("double") / 100).alias("surprise_score"))
    return vectors.cluster_confidence(m)


@query("jn23w_silent_drops", f"WITH n AS (SELECT a.label, a.id, max({_DOT.format('a.embedding', 'b.embedding')}) AS best FROM vectors a LEFT JOIN vectors b ON a.label = b.label AND b.id % 3 <> 0 WHERE a.id % 3 = 0 GROUP BY a.label, a.id) SELECT label, id FROM n WHERE coalesce(best, -1) < 0.3")
def _(e):
    v = e.vectors
    return vectors.silent_drops(v.filter("id % 3 = 0"), v.filter("id % 3 <> 0"), ["label"], 0.3).select("label", "id")


@query("wn06w_best_topic", """
WITH u AS (SELECT id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM vectors),
t AS (SELECT label AS topic, pos, avg(x) AS y FROM u GROUP BY label, pos),
s AS (SELECT id, topic, sum(x * y) AS s FROM u JOIN t USING (pos) GROUP BY id, topic)
SELECT id, arg_max(topic, (round(s, 9), -topic)) AS topic FROM s GROUP BY id
""")
def _(e):
    each = e.vectors.select("label", F.posexplode("embedding").alias("at", "x"))
    means = each.groupBy(F.col("label").alias("topic"), "at").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda p: p["m"]).alias("y"))
    pairs = e.vectors.select("id", "embedding").crossJoin(F.broadcast(means))  # a row per label
    return pairs.groupBy("id").agg(F.max_by("topic", F.struct(F.round(vectors.dot(F.col("embedding"), F.col("y")), 9), -F.col("topic"))).alias("topic"))


@query("rk01w_nearest_each", f"WITH s AS (SELECT q.id AS query_id, c.id, {_DOT.format('q.embedding', 'c.embedding')} AS similarity FROM vectors q JOIN vectors c ON q.id <> c.id AND NOT c.tombstoned WHERE q.{_QUERIES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(similarity, 4) AS similarity FROM r WHERE rank <= 5")
def _(e):
    return vectors.top_k_each(e.vectors, e.vectors.filter(_QUERIES), 5).select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity"))


@query("rk01x_indexed_nearest", f"WITH s AS (SELECT q.id AS query_id, c.id, {_DOT.format('q.embedding', 'c.embedding')} AS similarity FROM vectors q JOIN vectors c ON q.id <> c.id AND NOT c.tombstoned WHERE q.{_QUERIES}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(similarity, 4) AS similarity FROM r WHERE rank <= 5")
def _(e):
    live = e.vectors.filter("NOT tombstoned")
    centres = vector_index.centroids(live)
    rows = vector_index.assigned(live, centres)
    return vector_index.nearest_each(rows, vector_index.cells_of(rows, centres), e.vectors.filter(_QUERIES), 5).select("query_id", "rank", "id", F.round("similarity", 4).alias("similarity"))


@query("ev01w_recall_at_5", f"WITH s AS (SELECT q.id AS query_id, q.label AS want, c.label, row_number() OVER (PARTITION BY q.id ORDER BY {_DOT.format('q.embedding', 'c.embedding')} DESC, c.id) AS rank FROM vectors q JOIN vectors c ON q.id <> c.id AND NOT c.tombstoned WHERE q.{_QUERIES}), h AS (SELECT query_id, bool_or(want = label) AS hit FROM s WHERE rank <= 5 GROUP BY query_id) SELECT count(*) AS queries, round(avg(CAST(hit AS DOUBLE)), 4) AS recall FROM h")
def _(e):
    q = e.vectors.filter(_QUERIES)
    found = vectors.top_k_each(e.vectors, q, 5).join(e.vectors.select("id", "label"), "id")
    return recall_at(found, q.select(F.col("id").alias("query_id"), F.col("label").alias("want")), 5).select("queries", F.round("recall", 4).alias("recall"))


@query("ev04w_precision_by_slice", f"WITH s AS (SELECT q.id AS query_id, q.label AS slice, c.label, row_number() OVER (PARTITION BY q.id ORDER BY {_DOT.format('q.embedding', 'c.embedding')} DESC, c.id) AS rank FROM vectors q JOIN vectors c ON q.id <> c.id AND NOT c.tombstoned WHERE q.{_QUERIES}) SELECT slice, round(avg(CAST(slice = label AS DOUBLE)), 4) AS precision FROM s WHERE rank <= 5 GROUP BY slice")
def _(e):
    q = e.vectors.filter(_QUERIES)
    found = vectors.top_k_each(e.vectors, q, 5).join(e.vectors.select("id", "label"), "id").join(q.select(F.col("id").alias("query_id"), F.col("label").alias("slice")), "query_id")
    return found.groupBy("slice").agg(F.round(F.avg((F.col("slice") == F.col("label")).cast("double")), 4).alias("precision"))
