"""Licence scans by a positional rare-token index, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemolake.llm.common import ascii_lower, documents, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Words, phrases and labels of public licence texts.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: (label, passage, key phrases that must all stand in the file)
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["hereby granted free", "associated documentation files"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license"]),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["required by applicable law", "without warranties"]),
    ("gpl", "licensed under the gnu general public license version 3", ["general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["general public license", "published by", "free software foundation"]),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["binary forms", "following conditions"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released"]),
]
#: Words of the passages that are too common in any text to be looked up; key phrases hold none of them.
COMMON = set("a an and any are as can for in into is it may not of on or that the this to under use with you".split())


class Posting(NamedTuple):
    word: str
    template: int
    at: int


POSTINGS = [Posting(w, k, at) for k, (_, text, _) in enumerate(TEMPLATES) for at, w in enumerate(text.split()) if w not in COMMON]
VOCABULARY = sorted({p.word for p in POSTINGS})
#: A file's rare words that a score counts, and how many indexed words must stand where a passage has them.
RARE, AGREEING = 8, 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _stands(hits: Column, hit: Column, i: Column, phrase: str) -> Column:
    """Whether a phrase begins at the i-th hit. All its words are in the vocabulary, so they are the next hits."""
    tests = [hit["w"] == phrase.split()[0]]
    for k, w in enumerate(phrase.split()[1:], 1):
        later = F.get(hits, i + k)
        tests.append((later["w"] == w) & (later["p"] == hit["p"] + k))
    return F.coalesce(reduce(and_, tests), F.lit(False))


def _places(hits: Column, phrase: str) -> Column:
    return F.transform(F.filter(hits, lambda h, i: _stands(hits, h, i, phrase)), lambda h: h["p"])


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda start: F.struct(start.alias("start"), F.lit(label).alias("label")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places (array of struct<start, label>), base_labels, labels (sorted arrays), score.

    places holds every place of a base phrase. A passage is found if all its key phrases stand in the file and at
    least AGREEING of its indexed words stand at one distance from their places in it; its label then joins the base
    ones. The score is the largest share of a found passage in place: of its indexed words (at most RARE) that are
    among the file's RARE rarest licence words (by document frequency over all of docs) if AGREEING of those stand,
    else of all its indexed words; at least 0.5 with a base label, else 0. Null and empty texts have no words and
    score 0; every row, repeated or not, gives one row; other columns are ignored.

    Texts are read once: what is kept are the few words of each that licences use, with their positions.
    """
    spark = docs.sparkSession
    listed = docs.select("doc_id", words(F.col("text")).alias("words"))
    found = F.filter(F.transform("words", lambda w, i: F.when(w.isin(VOCABULARY), F.struct(i.cast("long").alias("p"), w.alias("w")))), lambda h: h.isNotNull())
    files = materialize(listed.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), found.alias("hits")), "licence-words")
    # Document frequencies of the vocabulary: as many rows as it has words.
    seen = files.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count().collect()
    frequency = {r["w"]: r["count"] for r in seen}
    rarest_first = sorted(VOCABULARY, key=lambda w: (frequency.get(w, 0), w))
    hits = F.col("hits")
    rare = F.slice(F.array_intersect(F.array(*[F.lit(w) for w in rarest_first]), F.transform(hits, lambda h: h["w"])), 1, RARE)
    keys = sorted({k for _, _, ks in TEMPLATES for k in ks})
    holds = {k: F.size(_places(hits, k)) > 0 for k in keys}
    verified = [F.when(reduce(and_, [holds[k] for k in ks]), F.lit(t)) for t, (_, _, ks) in enumerate(TEMPLATES)]
    # Only passages whose key phrases stand in the file are aligned, with all their words.
    asked = files.filter(F.size("hits") >= AGREEING).select("row", "hits", rare.alias("rare"), F.array_compact(F.array(*verified)).alias("verified")).filter(F.size("verified") > 0)
    looked_up = asked.select("row", "rare", "verified", F.explode("hits").alias("h")).select("row", "verified", "h.p", "h.w", F.array_contains("rare", F.col("h.w")).alias("rare"))
    postings = F.array(*[F.struct(F.lit(x.word).alias("w"), F.lit(x.template).alias("template"), F.lit(x.at).alias("at")) for x in POSTINGS])
    index = F.broadcast(spark.range(1).select(F.inline(postings)))  # fixed values: a few hundred rows
    aligned = looked_up.join(index, "w").filter(F.array_contains("verified", F.col("template"))).groupBy("row", "template", (F.col("p") - F.col("at")).alias("shift")).agg(F.count("*").alias("agree"), F.count_if("rare").alias("rare")).filter(F.col("agree") >= AGREEING)
    indexed = [sum(p.template == k for p in POSTINGS) for k in range(len(TEMPLATES))]
    of = lambda sizes: F.element_at(F.array(*[F.lit(float(n)) for n in sizes]), F.col("template") + 1)
    by_rare = F.when(F.col("rare") >= AGREEING, F.least(F.lit(1.0), F.col("rare") / of([min(RARE, n) for n in indexed])))
    best = aligned.groupBy("row", "template").agg(F.coalesce(F.max(by_rare), F.max(F.col("agree") / of(indexed))).alias("share"))
    matched = best.groupBy("row").agg(F.collect_list(F.struct("template", "share")).alias("passages"))  # at most one entry per passage
    placed = F.array_sort(F.concat(*[_labelled(_places(hits, phrase), label) for phrase, label in BASE_PHRASES.items()]))
    rows = files.withColumn("places", placed).join(matched, "row", "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<struct<template:int,share:double>>")))
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    rows = rows.withColumn("base_labels", F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"]))))
    rows = rows.withColumn("labels", F.array_sort(F.array_union("base_labels", F.transform("passages", lambda m: F.element_at(labels, m["template"] + 1)))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("passages", lambda m: m["share"])), F.lit(0.0)), F.when(F.size("base_labels") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return rows.select("doc_id", "n_words", "places", "base_labels", "labels", score.alias("score"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = F.transform("places", lambda x: x["start"])
    return scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_PHRASES = sorted({*BASE_PHRASES, *(k for _, _, keys in TEMPLATES for k in keys)})
OP9_SQL = rf"""
WITH posting(w, template, pos) AS (VALUES {_values(POSTINGS)}),
template(template, label, size) AS (VALUES {_values([(k, label, min(RARE, sum(p.template == k for p in POSTINGS))) for k, (label, _, _) in enumerate(TEMPLATES)])}),
phrase(phrase, k, w, n) AS (VALUES {_values([(x, k, w, len(x.split())) for x in _PHRASES for k, w in enumerate(x.split())])}),
base(phrase, label) AS (VALUES {_values(list(BASE_PHRASES.items()))}),
needed(template, phrase) AS (VALUES {_values([(k, x) for k, (_, _, keys) in enumerate(TEMPLATES) for x in keys])}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents),
u AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS p FROM d),
h AS (SELECT * FROM u WHERE w IN (SELECT w FROM posting)),
df AS (SELECT w, count(DISTINCT r) AS df FROM h GROUP BY w),
rare AS (SELECT r, w FROM (SELECT r, w, row_number() OVER (PARTITION BY r ORDER BY df, w) AS k FROM (SELECT DISTINCT r, w FROM h) JOIN df USING (w)) WHERE k <= {RARE}),
aligned AS (SELECT r, template, count(*) AS agree FROM h JOIN rare USING (r, w) JOIN posting USING (w) GROUP BY r, template, p - pos HAVING count(*) >= {AGREEING}),
place AS (SELECT r, phrase, p - k AS start FROM h JOIN phrase USING (w) GROUP BY r, phrase, p - k HAVING count(*) = max(n)),
unmet AS (SELECT DISTINCT a.r, n.template FROM (SELECT DISTINCT r, template FROM aligned) a JOIN needed n USING (template) WHERE NOT EXISTS (SELECT 1 FROM place WHERE place.r = a.r AND place.phrase = n.phrase)),
passage AS (SELECT a.r, t.label, max(least(1.0::DOUBLE, CAST(agree AS DOUBLE) / size)) AS share FROM aligned a JOIN template t USING (template) WHERE NOT EXISTS (SELECT 1 FROM unmet WHERE unmet.r = a.r AND unmet.template = a.template) GROUP BY a.r, t.label),
b AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM place JOIN base USING (phrase) GROUP BY r),
m AS (SELECT r, list(label) AS labels, max(share) AS share FROM passage GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
       greatest(coalesce(m.share, 0.0::DOUBLE), CASE WHEN b.r IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""
