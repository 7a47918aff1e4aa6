"""Queries that report on a table account for all of it; clusters without a sound answer are no result."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemolake import queries
from mnemolake.operators import extraction
from mnemolake.plans import q_text

DOCUMENTS = "doc_id long, text string, lang string, source string"


@pytest.fixture
def run(spark, tmp_path):
    """(what a query gives, what its SQL gives) over some documents."""

    def both(name, rows):
        spark.createDataFrame(rows, DOCUMENTS).coalesce(2).write.parquet(f"file://{tmp_path}/documents.parquet")
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        got = queries.QUERIES[name](spark, f"file://{tmp_path}")
        want = con.sql(queries.ORACLES[name])
        return sorted(tuple(r[c] for c in want.columns) for r in got.collect()), sorted(want.fetchall())

    return both


def test_hygiene_reports_every_bucket(run):
    journals = [" \n\tCompleted  the work", "all 12 tests pass", "Final\u000baudit", "engine v0.4 is out", None, " \n ", "implemented", "completed: done"]
    others = ["completedé work", "completed́ work", "İmplemented it", "completed src/a/b.py", "implemented\rERROR : x", "completed issue:", 'completed {"problem": 1}', "final audits", "completed; Problem: y", "Diagnosed"]
    solutions = dict(zip(range(2, 200, 5), [*journals, *others], strict=False))
    trial = {100: "x DRIFT_000 y", 101: "\n.tmp_coding_agent_eval/a", 102: "novelty_eval_test", 103: "driİft_000"}
    rows = [(i, (solutions | trial).get(i, "drift_ 001"), "Smoke" if i == 104 else None, "a test-run" if i == 105 else "web") for i in range(1, 130)]
    got, want = run("ag24_hygiene_report", rows)
    assert got == want
    live = [i for i in range(1, 130) if i % 11]
    temp = [100, 101, 102, 104, 105]
    noise = [i for i, t in solutions.items() if t in journals and i % 11]
    exchange = [i for i in live if i % 5 == 0 and i not in temp]
    rest = sorted({*live} - {*temp, *noise, *exchange})
    assert got == sorted((b, len(ids), ids[:8]) for b, ids in (("temp", temp), ("noise_journal", noise), ("exchange", exchange), ("would_remain", rest)))


def test_every_cluster_has_its_answer(run):
    odd = [None, '{"type": "solution", "problem": "p", "fix": "f"}', "EPISODE 4 (fact):\nx", "a\n\nEPISODE 4 (fact):\nEPISODE 5", "it could not be used", "\n\nJSON: could not be used", "/opt/User: 1.2.3", "C:\\work\\a.py 2.0.1"]
    rows = [(20 * (i + 1) + k, t, "en", "web") for i, t in enumerate(odd) for k in (0, 1, 3)] + [(20 * (i + 20) + 1, t, "en", "web") for i, t in enumerate(odd)]
    got, want = run("co06_model_extraction", rows)
    assert got == want and len(got) == 16


def test_a_cluster_without_an_answer_ends_the_query(run, monkeypatch):
    sound = q_text._stand_in

    def down(prompt):
        if "bad" in prompt:
            raise ConnectionError("no route")
        return sound(prompt)

    monkeypatch.setattr(q_text, "_stand_in", down)
    with pytest.raises(Exception, match="cluster 2: no usable answer after 3 attempts: no route"):
        run("co06_model_extraction", [(1, "good", "en", "web"), (21, "good", "en", "web"), (41, "bad", "en", "web")])


def test_faults_that_remain_are_told(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", "text", "exchange", ["t"]), (2, "b", "text", "exchange", ["t"])], "cluster int, id string, content string, content_type string, tags array<string>")
    fact = {"type": "fact", "subject": "s", "info": "i"}
    told = extraction.extract(rows, lambda p: json.dumps({"title": "", "summary": "s", "records": [fact, {"type": "fact"}]}))
    assert all(r["faults"][0] == "title is missing" and len(r["faults"]) == 2 and len(r["records"]) == 1 and r["calls"] == 3 for r in told.collect())
    with pytest.raises(Exception, match="faults remain; title is missing"):
        extraction.answered(told).count()
    late = extraction.extract(rows, lambda p: "", seconds=-1.0)
    with pytest.raises(Exception, match="the time is over"):
        extraction.answered(late).agg(F.count("*")).collect()

    def broken(*_):
        raise ValueError("a fault of the library")

    monkeypatch.setattr(extraction, "by_rule", broken)
    with pytest.raises(Exception, match="a fault of the library"):
        extraction.extract(rows, lambda p: json.dumps({"title": "t", "summary": "s", "records": [fact]})).collect()
