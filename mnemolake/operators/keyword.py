"""Keyword retrieval: BM25 over words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def terms(query: str) -> list[str]:
    """A query's distinct words of two characters or more, lower-cased, in order."""
    return list(dict.fromkeys(w for w in re.findall(r"\w+", query.lower()) if len(w) > 1))


WORD = "[a-z0-9]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def count_of(low: Column, term: str) -> Column:
    """How often a word stands in a text of small letters; only texts that contain its letters are searched for it."""
    if not re.fullmatch(WORD, term):
        return F.lit(0)
    return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))).otherwise(0)


def bm25(docs: DataFrame, query: str, k: int | None = None, key: str = "id", text: str = "content") -> DataFrame:
    """(key, raw, keyword): BM25 of the query's words joined by OR, and raw / (raw + 1).

    Documents are read once, for their lengths and for how often they have each word: those without a word are added up where
    they are read, and one exchange of what is left serves the corpus' sums (one row) as well as the documents that have a word.
    """
    wanted = terms(query)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(key, low.alias("__low")).select(key, F.regexp_count("__low", F.lit(WORD)).alias("__n"), *[count_of(F.col("__low"), t).alias(f"__f{i}") for i, t in enumerate(wanted)])
    found = [f"__f{i}" for i in range(len(wanted))]
    hit = sum((F.col(f) for f in found), F.lit(0)) > 0
    named = rows.select(F.when(hit, F.col(key)).alias(key), F.when(hit, F.col("__n")).alias("__n"), F.col("__n").alias("__all"), *found)
    held = named.groupBy(key, "__n", *found).agg(F.count("*").alias("__rows"), F.sum("__all").alias("__words"))
    corpus = held.agg(F.sum("__rows").alias("__docs"), F.try_divide(F.sum("__words"), F.sum("__rows")).alias("__mean"), *[F.coalesce(F.sum(F.when(F.col(f) > 0, F.col("__rows"))), F.lit(0)).alias(f"__d{i}") for i, f in enumerate(found)])
    hits = held.filter(hit).crossJoin(F.broadcast(corpus))  # one row
    score = F.lit(0.0)
    for i in range(len(wanted)):
        f, d = F.col(f"__f{i}"), F.col(f"__d{i}")
        idf = F.log(F.lit(1.0) + (F.col("__docs") - d + 0.5) / (d + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (F.lit(1 - B) + B * F.col("__n") / F.col("__mean")))
    out = hits.select(key, score.alias("raw")).withColumn("keyword", F.col("raw") / (F.col("raw") + 1))
    return out if k is None else out.orderBy(F.desc("raw"), key).limit(k)


def term_tables(docs: DataFrame, key: str = "id", text: str = "content") -> tuple[DataFrame, DataFrame]:
    """What a kept index holds of documents: postings (term, key, tf, length) and lengths (key, length), one row for each document."""
    rows = docs.select(key, words(F.col(text)).alias("w")).select(key, "w", F.size("w").alias("length"))
    postings = rows.select(key, "length", F.explode("w").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))
    return postings.select("term", key, "tf", "length"), rows.select(key, "length")


def search_index(postings: DataFrame, lengths: DataFrame, docs: DataFrame, query: str, k: int | None = None, key: str = "id", text: str = "content") -> DataFrame:
    """What `bm25` gives for docs, from a kept index: only the query's terms are read of it, and no indexed text.

    docs are the documents to be searched, each once; the index may know others (of other scopes, deleted ones), which count
    nowhere. Documents that it does not know are read and counted beside it, so the result is the same however far the
    index has come.
    """
    wanted = [t for t in terms(query) if re.fullmatch(WORD, t)]
    ids = docs.select(key)
    hits = postings.filter(F.col("term").isin(wanted)).join(ids, key, "left_semi").select("term", key, "tf", "length")
    known = lengths.join(ids, key, "left_semi").select(key, "length")
    unknown = ids.join(lengths.select(key), key, "left_anti")
    if not unknown.isEmpty():
        more, also = term_tables(docs.join(unknown, key, "left_semi"), key, text)
        hits, known = hits.unionByName(more.filter(F.col("term").isin(wanted))), known.unionByName(also)
    corpus = known.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    having = hits.groupBy("term").agg(F.count("*").alias("having"))
    # One row, and one for each of the query's terms.
    rows = hits.join(F.broadcast(having), "term").crossJoin(F.broadcast(corpus))
    idf = F.log(F.lit(1.0) + (F.col("docs") - F.col("having") + 0.5) / (F.col("having") + 0.5))
    score = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (F.lit(1 - B) + B * F.col("length") / F.col("mean")))
    # Terms add up in the query's order, as they do in `bm25`.
    place = F.array_position(F.array(*[F.lit(t) for t in wanted]).cast("array<string>"), F.col("term"))
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), score.alias("score")))).alias("parts"))  # one for each term
    raw = F.aggregate("parts", F.lit(0.0), lambda total, p: total + p["score"])
    out = own.select(key, raw.alias("raw")).withColumn("keyword", F.col("raw") / (F.col("raw") + 1))
    return out if k is None else out.orderBy(F.desc("raw"), key).limit(k)


def share_of_words(query: str, text: Column) -> Column:
    """Share of the query's words that the text contains anywhere."""
    wanted = list(dict.fromkeys(query.lower().split()))
    if not wanted:
        return F.lit(0.0)
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(t)).cast("int") for t in wanted), F.lit(0)) / F.lit(float(len(wanted)))
