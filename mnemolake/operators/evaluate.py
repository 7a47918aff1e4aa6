"""Evaluation: retrieval hits, text overlap, intervals, trends and gates."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at(found: DataFrame, wanted: DataFrame, k: int = 5, value: str = "label") -> DataFrame:
    """Share of queries (query_id, want) with a right value among their k best (query_id, rank, value)."""
    hits = wanted.join(found.filter(F.col("rank") <= k), "query_id", "left").groupBy("query_id").agg(F.coalesce(F.bool_or(F.col("want") == F.col(value)), F.lit(False)).alias("hit"))
    return hits.agg(F.count("*").alias("queries"), F.avg(F.col("hit").cast("double")).alias("recall"))


def suppressed(found: DataFrame, stale: DataFrame, k: int = 5) -> DataFrame:
    """(cases, rate): of the queries (query_id) with stale ids (query_id, id), the share with none of them among their k best (query_id, rank, id)."""
    leaks = found.filter(F.col("rank") <= k).join(stale.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("leak", F.lit(1))
    return stale.select("query_id").distinct().join(leaks, "query_id", "left").agg(F.count("*").alias("cases"), F.avg(F.col("leak").isNull().cast("double")).alias("rate"))


def visible(pairs: DataFrame, shown: DataFrame) -> DataFrame:
    """(cases, rate): the share of contradicting pairs (a, b; a pair counts once whichever side comes first) that one of both shows (id, partner)."""
    both = lambda df, x, y: df.select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).distinct()
    hit = both(shown, "id", "partner").withColumn("hit", F.lit(1))
    return both(pairs, "a", "b").filter("lo <> hi").join(hit, ["lo", "hi"], "left").agg(F.count("*").alias("cases"), F.avg(F.col("hit").isNotNull().cast("double")).alias("rate"))


def wins(cases: DataFrame) -> DataFrame:
    """(cases, rate, median_delta) of cases with the scores of what worked and of what failed (good, bad): how often the first is higher, and by how much."""
    delta = F.col("good") - F.col("bad")
    return cases.filter("good IS NOT NULL AND bad IS NOT NULL").agg(F.count("*").alias("cases"), F.avg((delta > 0).cast("double")).alias("rate"), F.percentile(delta, 0.5).alias("median_delta"))


def token_overlap(pairs: DataFrame, key: str, predicted: str = "predicted", gold: str = "gold") -> DataFrame:
    """Token F1 and BLEU-1 of text pairs: (key, f1, bleu)."""
    words = lambda c: F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != "")
    a = pairs.select(key, F.explode(words(F.col(predicted))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("x"))
    b = pairs.select(key, F.explode(words(F.col(gold))).alias("w")).groupBy(key, "w").agg(F.count("*").alias("y"))
    both = a.join(b, [key, "w"]).groupBy(key).agg(F.sum(F.least("x", "y")).alias("both"))
    n = pairs.select(key, F.size(words(F.col(predicted))).alias("p"), F.size(words(F.col(gold))).alias("g"))
    rows = n.join(both, key, "left").withColumn("both", F.coalesce("both", F.lit(0)))
    f1 = F.when(F.col("both") > 0, 2.0 * F.col("both") / (F.col("p") + F.col("g"))).otherwise(0.0)
    bleu = F.when(F.col("p") > 0, F.col("both") / F.col("p") * F.least(F.lit(1.0), F.col("p") / F.nullif(F.col("g"), F.lit(0)))).otherwise(0.0)
    return rows.select(key, f1.alias("f1"), F.coalesce(bleu, F.lit(0.0)).alias("bleu"))


def wilson(rows: DataFrame, successes: str, total: str, z: float = 1.96) -> DataFrame:
    """Adds point, low and high of the Wilson interval; zeros without trials."""
    n, p = F.col(total), F.col(successes) / F.nullif(F.col(total), F.lit(0))
    scale = F.lit(1.0) + z * z / n
    centre = (p + z * z / (2.0 * n)) / scale
    margin = F.lit(z) / scale * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))
    return rows.withColumns({"point": F.coalesce(p, F.lit(0.0)), "low": F.coalesce(F.greatest(F.lit(0.0), centre - margin), F.lit(0.0)), "high": F.coalesce(F.least(F.lit(1.0), centre + margin), F.lit(0.0))})


def bootstrap(successes: int, total: int, rounds: int = 2000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float, float]:
    """(point, low, high) by resampling: a resample's successes are binomial, so no outcome need be gathered."""
    if total <= 0:
        return 0.0, 0.0, 0.0
    rates = np.sort(np.random.default_rng(seed).binomial(total, successes / total, rounds) / total)
    return round(successes / total, 6), round(float(rates[int(alpha / 2 * rounds)]), 6), round(float(rates[int((1 - alpha / 2) * rounds) - 1]), 6)


def trend(baseline: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Values of both runs by section, and the change."""
    both = baseline.select(key, F.col(value).alias("baseline")).join(current.select(key, F.col(value).alias("current")), key, "full_outer")
    return both.withColumn("delta", F.coalesce("current", F.lit(0)) - F.coalesce("baseline", F.lit(0)))


# Release gates, as (measure, bound, which side passes).
GATES = [
    ("freshness", 0.97, "min"), ("leak_rate", 0.03, "max"), ("drift_lag_p95_s", 120.0, "max"), ("contradiction_latency_median_s", 90.0, "max"), ("contradiction_latency_p95_s", 300.0, "max"),
    ("temporal_precision", 0.80, "min"), ("temporal_slice_precision", 0.70, "min"), ("provenance_coverage", 0.995, "min"), ("solution_hit_rate", 0.90, "min"), ("stale_suppression", 0.95, "min"),
    ("scope_isolation", 1.0, "min"), ("contradiction_visibility", 0.95, "min"), ("outcome_win_rate", 0.80, "min"),
]


def gates(measured: Mapping[str, float], age_hours: float = 0.0, most_hours: float = 168.0) -> dict[str, str]:
    """pass, fail or missing for each gate; results that are too old count as missing."""
    out = {}
    for name, bound, side in GATES:
        v = None if age_hours > most_hours else measured.get(name)
        out[name] = "missing" if v is None else "pass" if (v >= bound if side == "min" else v <= bound) else "fail"
    return out
