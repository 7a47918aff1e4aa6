"""The whole-table vector queries see every row, on both sides."""

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemolake import queries
from mnemolake.operators import vectors
from mnemolake.plans.entities import Entities
from tests.test_oracles import SF, TABLES, rows

SFS = (SF, SF.replace("0.001", "0.1"))


@pytest.mark.parametrize("sf", SFS)
def test_every_vector_counts(spark, sf):
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    q = {name: queries.QUERIES[name](spark, sf) for name in ("ag17w_cluster_confidence", "wn06w_best_topic", "rk01w_nearest_each", "ev01w_recall_at_5")}
    assert q["ag17w_cluster_confidence"].agg(F.sum("n")).first()[0] == n
    assert q["wn06w_best_topic"].count() == n
    assert {r[0] for r in q["rk01w_nearest_each"].select("query_id").distinct().collect()} == set(range(0, n, 100))
    assert q["ev01w_recall_at_5"].first()["queries"] == -(-n // 100)


def test_drops_are_judged_by_every_other_row(spark):
    """What two thirds of the rows leave as dropped is a part of what one third leaves."""
    v = Entities(spark, SFS[1]).vectors
    few = {tuple(r) for r in vectors.silent_drops(v.filter("id % 3 = 0"), v.filter("id % 3 = 1"), ["label"], 0.3).select("label", "id").collect()}
    all_ = {tuple(r) for r in queries.QUERIES["jn23w_silent_drops"](spark, SFS[1]).collect()}
    assert all_ < few or (all_ == few == set())
    assert Entities(spark, SFS[1]).vectors.filter("id % 3 = 2").count() > 0


@pytest.mark.parametrize("name", sorted(x for x in queries.QUERIES if x[:5].endswith("w")))
def test_sql_agrees_on_the_larger_table(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SFS[1]}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SFS[1]).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())
