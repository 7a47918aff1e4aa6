"""Signs of repeated runs are read once; a model's clusters reach Python one at a time; hygiene reads texts as they are."""

import json
import re

from mnemolake.functions import text
from mnemolake.operators import consolidate, extraction, lifecycle


def test_signs_of_repeated_runs():
    text._known_signs.cache_clear()
    told = "See src/a.py, then pytest and foo_bar_baz() at abc1234. " * 50
    found = list(text.signs(told))
    assert len(found) == 50 * len(list(text.signs(told[: len(told) // 50]))) and [s.at for s in found] == sorted(s.at for s in found)
    assert text._known_signs.cache_info().misses <= 9
    assert text.anchors(told) == [("path", "src/a.py"), ("tool", "pytest"), ("commit", "abc1234")]


def test_clusters_one_at_a_time(spark):
    rows = spark.range(60).selectExpr("id DIV 3 AS cluster", "id", "concat('text ', id) AS content", "'exchange' AS content_type", "array('t') AS tags")
    answer = {"title": " a  title", "summary": "s", "records": [{"type": "fact", "subject": "S", "info": "i"}, {"type": "fact", "subject": "s ", "info": "i"}]}
    df = extraction.extract(rows, lambda p: json.dumps(answer))
    assert "MapInArrow" in df._jdf.queryExecution().toString()
    got = df.collect()
    assert len(got) == 20 and all(r["title"] == "a title" and r["calls"] == 1 and r["tried"] and [x["subject"] for x in r["records"]] == ["S"] for r in got)


def test_trial_marks_need_no_collapsed_text(spark):
    rows = spark.createDataFrame([(1, "x\n DRIFT_000 y", "fact", [], False), (2, None, "exchange", None, False), (3, " ", "solution", ["a"], False), (4, "ok", "fact", ["Smoke"], False), (5, "drift_ 000", "exchange", [], False)], "id long, content string, content_type string, tags array<string>, deleted boolean")
    df = lifecycle.hygiene_buckets(rows)
    assert {r["id"]: r["bucket"] for r in df.collect()} == {1: "temp", 2: "exchange", 3: "noise_journal", 4: "temp", 5: "exchange"}
    held = consolidate.hygiene_report(df.filter("bucket = 'exchange'"))
    assert [tuple(r) for r in held.collect()] == [("exchange", 2, [2, 5])]
    assert re.search(r"(?i)contains\(lower\(content#\d+\), drift_000\)", df._jdf.queryExecution().optimizedPlan().toString())
