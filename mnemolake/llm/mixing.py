"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemolake.llm.common import documents, materialize

#: Hash buckets of a source: only the one bucket in which its share ends is ordered row by row.
BUCKETS = 4096
#: Sources up to which the plan (one row each, about 100 bytes) goes to every task.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs free of ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A document's seeded place in its source, uniform over 60 bits; no document id counts as 'null'."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """Targets of `sources` (source, source_size): share of the total by weight, clamped at epochs times the source.

    Clamping and resharing by weight until nothing is above its cap ends at one water level: a source
    stays clamped exactly if its cap over its weight is no more than the level. With sources in the order of
    that ratio, the level is what is left after the first j caps over the weight left, for the smallest j
    at which the next source stays below its cap. One row per source is all that is ordered here.
    """
    byname = Window.orderBy(F.col("source").asc_nulls_last())
    byratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = byratio.rowsBetween(Window.unboundedPreceding, -1), byratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    out = (
        sources.withColumn("nth", F.row_number().over(byname) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("final", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    return out.select("source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def take(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """docs with a column mixed: struct<size, source_size, target, draws, taken>, replacing one of that name.

    A source's target over its size is the number of passes over it: each document is taken whole as often
    as that has whole passes; the fraction goes to documents in the order of a seeded draw until the target
    is met, the last one in part: taken = size * whole passes + the part of the last pass, in words. Null texts have
    size 0; null sources form one source, last by name; repeated rows are rows of their own; no rows give no rows.

    Only sums per source and bucket, and the rows of each source's one bucket in which its last pass ends, are shuffled.
    """
    size, draws = word_count(F.col("text")), draw(F.col("doc_id"), seed)
    bucket = (draws % BUCKETS).cast("int")
    buckets = docs.select("source", bucket.alias("bucket"), size.alias("size")).groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    targets = water_fill(buckets.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, epochs)
    # Where the last pass ends: whole passes, the words still to take, and the bucket in which they run out.
    plan = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target")) / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"))
    run = buckets.withColumn("before", F.sum("held").over(Window.partitionBy("source").orderBy("bucket")) - F.col("held"))
    ends = run.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).groupBy("source", "source_size", "target", "passes", "rest").agg(F.max(F.when(F.col("before") <= F.col("rest"), F.struct("bucket", "before"))).alias("end"))
    ends = ends.select(F.col("source").alias("__s"), F.struct("source_size", "target", "passes", "rest", F.col("end.bucket").alias("bucket"), F.col("end.before").alias("before")).alias("__end"))
    ends = materialize(ends, "mix-plan")
    if ends.count() <= BROADCAST_SOURCES:  # else the rows are shuffled by source, hot ones split by the join
        ends = F.broadcast(ends)
    named = docs.withColumns({"__size": size, "__draws": draws, "__bucket": bucket})
    rows = named.join(ends, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    inside = Window.partitionBy("source").orderBy("__draws", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter(F.col("__bucket") == F.col("__end.bucket")).withColumn("__room", F.col("__end.rest") - F.col("__end.before") - F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    last = last.withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__room")))).drop("__room")
    others = rows.filter(F.col("__bucket") != F.col("__end.bucket")).withColumn("__extra", F.when(F.col("__bucket") < F.col("__end.bucket"), F.col("__size")).otherwise(F.lit(0)))
    taken = (F.col("__end.passes") * F.col("__size") + F.col("__extra")).cast("long")
    mixed = F.struct(F.col("__size").alias("size"), "__end.source_size", "__end.target", F.col("__draws").alias("draws"), taken.alias("taken"))
    return others.unionByName(last).withColumn("mixed", mixed).drop("__size", "__draws", "__bucket", "__end", "__extra")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """`take` as a table: doc_id, source, size, source_size, target, draws, taken; other columns are ignored."""
    return take(docs.select("doc_id", "source", "text"), weights, share, epochs, seed).select("doc_id", "source", "mixed.*")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


OP4_SQL = r"""
WITH base AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 15) AS BIGINT) AS draws
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
named AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight FROM sources),
capped AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM named),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0.0::DOUBLE)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE)) AS level
  FROM capped WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT (SELECT level FROM levels WHERE level < ratio ORDER BY ratio, level LIMIT 1) AS final),
targets AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio <= final THEN cap ELSE weight * final END AS target FROM levels, water),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM targets),
rows AS (
  SELECT b.doc_id, b.size, p.source_size, p.target, p.passes, CAST(round(p.target) AS BIGINT) - p.passes * p.source_size AS rest,
         coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.draws % 4096, b.draws, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM base b JOIN plan p ON b.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM rows
"""
