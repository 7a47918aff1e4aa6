"""Provenance rows that lack a source are dealt to all tasks."""

from pyspark.sql import functions as F

from mnemolake.operators import evidence, lifecycle, scope


def largest(df):
    """Rows of the largest partition, as a join deals them."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def plain(spark):
    """No broadcast and no partition put together or apart."""
    for k in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
        spark.conf.set(f"spark.sql.{k}", {"autoBroadcastJoinThreshold": "-1"}.get(k, "false"))


def reset(spark):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rows_without_a_source_are_spread(spark):
    sources = spark.range(4000).selectExpr("id % 1000 AS claim_id", "IF(id % 10 = 0, id % 70, NULL) AS source_episode_id", "IF(id % 10 = 1, id % 70, NULL) AS source_topic_id", "IF(id % 10 = 2, id % 70, NULL) AS source_record_id", "timestamp_seconds(id) AS created_at")
    held = spark.range(60).selectExpr("id", "CAST(id % 3 AS STRING) AS project_slug")
    plain(spark)
    try:
        scopes = scope.source_scopes(sources, held, held, held, ["project_slug"])
        kept = lifecycle.detach_sources(sources, spark.range(0, 70, 5))
        joined = scope.left_join(sources, held.withColumnRenamed("id", "source_episode_id"), "source_episode_id")
        assert largest(scopes) < 2000 and largest(joined) < 2000 and largest(kept) < 2000
        want = {}
        for i in range(4000):
            k = (i % 1000, str(i % 70 % 3) if i % 10 < 3 and i % 70 < 60 else None)
            want[k] = want.get(k, 0) + 1
        assert {(r[0], r[1]): r[2] for r in scopes.groupBy("claim_id", "project_slug").count().collect()} == want
        assert kept.filter("source_episode_id IS NOT NULL").count() == sum(i % 10 == 0 and i % 70 % 5 != 0 for i in range(4000))
        anchors = spark.range(60).selectExpr("id AS episode_id", "'path' AS anchor_type", "CAST(id AS STRING) AS anchor_value")
        told = evidence.source_evidence(sources, anchors)
        assert "__spread" in told._jdf.queryExecution().optimizedPlan().toString() and told.agg(F.sum("source_link_count")).first()[0] == 4000
    finally:
        reset(spark)
