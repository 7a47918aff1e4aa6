"""Reliability, precision, reuse and ranking of claims, as column expressions over evidence counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemolake.operators.temporal import age_days, instant

# Fixed values of the published scoring rules.
SIGNALS = ["supporting_outcomes", "success_ratio", "failures_and_reversions", "contradictions", "drift_and_challenge_state", "recency", "provenance_richness", "code_anchor_support", "expiry_history"]


def _n(name: str) -> Column:
    """A counter: missing or dirty values count as zero, negative ones too."""
    return F.greatest(F.lit(0), F.coalesce(F.col(name).try_cast("long"), F.col(name).try_cast("double").try_cast("long"), F.lit(0)))


def _steps(c: Column, steps: list[tuple[float, float]], other: float) -> Column:
    """The points of the first bound that c reaches."""
    out = F.lit(other)
    for bound, points in reversed(steps):
        out = F.when(c >= bound, F.lit(points)).otherwise(out)
    return out


def _limited(count: Column, each: float, most: float) -> Column:
    return F.least(F.lit(most), count * F.lit(each))


def status_of(c: str = "status") -> Column:
    s = F.lower(F.trim(F.col(c)))
    return F.when(s.isin("challenged", "expired"), s).otherwise("active")


def negative_outcomes() -> Column:
    return F.greatest(_n("failure_count"), _n("explicit_failure_count") + _n("reverted_count") + _n("superseded_count"))


def weighted_success() -> Column:
    return _n("success_count") + _n("partial_success_count") * F.lit(0.5)


def points(as_of: str, observed: str = "last_observed_at", updated: str = "updated_at") -> dict[str, Column]:
    """What each signal adds to the base of 50."""
    status, v, bad = status_of(), _n("validation_count"), negative_outcomes()
    total = _n("success_count") + _n("partial_success_count") + bad
    ratio = weighted_success() / F.nullif(total, F.lit(0))
    seen = F.coalesce(F.col(observed).cast("timestamp"), F.col(updated).cast("timestamp"))
    age = age_days(seen, as_of)
    kinds = sum(((_n(c) > 0).cast("int") for c in ("source_episode_count", "source_topic_count", "source_record_count")), F.lit(0))
    links = _steps(_n("source_link_count"), [(3, 4.0), (1, 2.0)], -6.0)
    types = _steps(kinds, [(3, 3.0), (2, 2.0), (1, 1.0)], -4.0)
    held = F.when(status == "challenged", 15.0).when(status == "expired", 20.0).otherwise(0.0)
    return {
        "supporting_outcomes": _steps(v, [(5, 15.0), (2, 8.0), (1, 4.0)], -10.0),
        "success_ratio": F.when(ratio.isNull(), -4.0).otherwise(_steps(ratio, [(0.8, 12.0), (0.6, 6.0), (0.4, 0.0)], -8.0)),
        "failures_and_reversions": -(_limited(_n("explicit_failure_count"), 4.0, 12.0) + _limited(_n("reverted_count") + _n("superseded_count"), 6.0, 12.0)),
        "contradictions": -_limited(_n("contradiction_count"), 8.0, 24.0),
        "drift_and_challenge_state": -(_limited(_n("drift_event_count"), 6.0, 18.0) + _limited(_n("challenged_count"), 3.0, 9.0) + held),
        "recency": F.when(seen.isNull(), F.when(v == 0, 0.0).otherwise(-2.0)).when(age <= 14, 8.0).when(age <= 60, 4.0).when(age <= 180, 0.0).otherwise(-6.0),
        "provenance_richness": links + types + F.when(_n("outcomes_with_provenance_count") > 0, 2.0).otherwise(0.0),
        "code_anchor_support": _steps(_n("source_anchor_count") + _n("outcome_anchor_count"), [(3, 4.0), (1, 2.0)], -3.0),
        "expiry_history": -_limited(_n("expiry_event_count"), 5.0, 10.0),
    }


def with_reliability(df: DataFrame, as_of: str) -> DataFrame:
    """Adds reliability (0 to 100 in steps of five), band, multiplier, recommendation and the adjustments made."""
    if "outcome_anchor_count" not in df.columns:
        df = df.withColumn("outcome_anchor_count", F.lit(0))
    p = points(as_of)
    df = df.withColumn("adjustments", F.array(*[F.struct(F.lit(k).alias("signal"), p[k].cast("double").alias("points")) for k in SIGNALS]))
    raw = F.lit(50.0) + F.aggregate("adjustments", F.lit(0.0), lambda acc, x: acc + x["points"])
    score = (F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)) / 5) * 5).cast("int")
    df = df.withColumn("reliability", score)
    r, status = F.col("reliability"), status_of()
    return df.withColumns({
        "band": F.when(r >= 75, "high").when(r >= 55, "moderate").when(r >= 35, "guarded").otherwise("low"),
        "ranking_multiplier": F.round(F.lit(0.2) + r / 100 * 1.2, 3),
        "recommendation": F.when((status == "expired") | (r < 35), "avoid_reuse").when((status == "challenged") | (r < 55), "reuse_with_caution").when(r >= 75, "reusable").otherwise("conditionally_reusable"),
    })


def precision() -> Column:
    """Full precision, raised by successes and lowered by failures, contradictions, drift and challenges."""
    value = (
        F.lit(1.0) + _limited(_n("success_count"), 0.03, 0.15) + _limited(_n("partial_success_count"), 0.02, 0.08) - _limited(negative_outcomes(), 0.12, 0.45)
        - _limited(_n("contradiction_count"), 0.15, 0.5) - _limited(_n("drift_event_count"), 0.12, 0.4) - _limited(_n("challenged_count"), 0.08, 0.25)
    )
    status = status_of()
    value = F.when(status == "challenged", value * 0.75).when(status == "expired", F.least(value, F.lit(0.1))).otherwise(value)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def competing_precision(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 0.55


def with_reuse(df: DataFrame, as_of: str) -> DataFrame:
    """Adds support, risk, reuse multiplier and label of strategies."""
    if "ranking_multiplier" not in df.columns:
        df = with_reliability(df, as_of)
    support, v = weighted_success(), _n("validation_count")
    risk = _n("failure_count") + _n("contradiction_count") + _n("challenged_count") * F.lit(0.5)
    plain = F.greatest(F.lit(0.2), 1.0 + F.least(F.lit(0.35), F.log1p(v) * 0.12) + F.least(F.lit(0.45), support * 0.1) - F.least(F.lit(0.75), risk * 0.2))
    advice = F.col("recommendation")
    label = F.when(v == 0, "unvalidated").when((risk == 0) & (support >= 2) & ~advice.isin("avoid_reuse", "reuse_with_caution"), "validated").when((risk > support) | (advice == "avoid_reuse"), "degraded").otherwise("mixed")
    return df.withColumns({"support_weight": support, "risk_weight": risk, "evidence_density": F.least(F.lit(1.0), v / 5.0), "reuse_multiplier": F.greatest(F.lit(0.2), F.least(F.lit(1.5), F.round((plain + F.col("ranking_multiplier")) / 2, 3))), "reusability": label})


def temporal_validity(as_of: str, start: str = "valid_from", end: str = "valid_until") -> Column:
    t = instant(as_of).cast("timestamp")
    left = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(t)) / 86_400_000_000
    outside = F.coalesce(t < F.col(start), F.lit(False)) | F.coalesce(t >= F.col(end), F.lit(False))
    return F.when(outside, 0.05).when(left <= 1, 0.8).when(left <= 7, 0.9).otherwise(1.0)


def outcome_support() -> Column:
    good, bad, v = weighted_success(), negative_outcomes(), _n("validation_count")
    score = F.lit(0.35) + good / F.greatest(F.lit(1.0), good + bad) * 0.45 + F.least(F.lit(1.0), v / 5.0) * 0.2
    score = score - F.when(bad > good, F.least(F.lit(0.2), (bad - good) * 0.05)).otherwise(0.0)
    return F.when(v == 0, 0.35).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), score)))


def drift_penalty() -> Column:
    status = status_of()
    held = F.when(status == "challenged", 0.22).when(status == "expired", 0.35).otherwise(0.0)
    events = F.least(F.lit(0.45), _n("drift_event_count") * 0.07 + _n("challenged_count") * 0.05 + _n("contradiction_count") * 0.03)
    return F.greatest(F.lit(0.25), 1.0 - (held + events))


def claim_rank(semantic: Column, keyword: Column, phrase: Column, as_of: str, semantic_weight: float = 0.8, keyword_weight: float = 0.2, precision_: Column | None = None, reuse: Column | None = None) -> Column:
    """Trust-aware relevance of claims that carry evidence, reliability and ranking_multiplier."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    lexical = F.greatest(unit(keyword), unit(phrase) * 0.85)
    base = (unit(semantic) * semantic_weight + lexical * keyword_weight) * (F.lit(0.5) + unit(F.col("confidence")) * 0.5)
    mixed = base * 0.55 + F.col("reliability") / 100 * 0.2 + temporal_validity(as_of) * 0.1 + outcome_support() * 0.15
    out = mixed * F.greatest(F.lit(0.2), F.least(F.lit(1.5), F.col("ranking_multiplier"))) * drift_penalty() * unit(F.lit(1.0) if precision_ is None else precision_)
    if reuse is not None:
        out = out * F.greatest(F.lit(0.2), F.least(F.lit(1.5), reuse))
    return F.round(F.greatest(F.lit(0.0), out), 3)


def adjusted_surprise(median: Column, now: str, boost: float = 0.02, most: float = 0.15, decay: float = 0.05, idle: float = 7.0, low: float = 0.1, high: float = 1.0) -> Column:
    """Surprise raised by reads above the median, lowered for consolidated episodes that nobody read; small changes are left."""
    old, access = F.col("surprise_score"), F.col("access_count")
    new = F.when((median > 0) & (access > median), F.greatest(old, old + F.least((access - median) * boost, F.lit(most)))).otherwise(old)
    new = F.when((access == 0) & (F.col("consolidated") == 1) & (age_days(F.col("updated_at"), now) >= idle), new - decay).otherwise(new)
    new = F.greatest(F.lit(low), F.least(F.lit(high), new))
    return F.when(F.abs(new - old) >= 0.005, F.round(new, 4)).otherwise(old)


UTILITY_WEIGHTS = {"unconsolidated_backlog": 0.35, "recall_miss_fallback": 0.15, "contradiction_spike": 0.15, "challenged_claim_backlog": 0.15, "outcome_failure_rate": 0.2}


def utility(signals: Mapping[str, float], targets: Mapping[str, float], weights: Mapping[str, float] = UTILITY_WEIGHTS) -> dict[str, object]:
    """How worthwhile a consolidation run is: five signals against their targets, each at most one; fallbacks count twice."""
    raw = {
        "unconsolidated_backlog": signals.get("backlog", 0) / max(1, targets.get("backlog", 1)),
        "recall_miss_fallback": (max(0, signals.get("misses", 0)) + 2 * max(0, signals.get("fallbacks", 0))) / max(1, targets.get("recall", 1)),
        "contradiction_spike": signals.get("contradictions", 0) / max(1, targets.get("contradictions", 1)),
        "challenged_claim_backlog": signals.get("challenged", 0) / max(1, targets.get("challenged", 1)),
        "outcome_failure_rate": signals.get("failure_rate", 0.0),
    }
    part = {k: round(weights.get(k, 0.0) * min(1.0, max(0.0, v)), 6) for k, v in raw.items()}
    return {"score": round(sum(part.values()), 6), "components": part, "dominant": sorted((k for k in part if part[k] > 0), key=lambda k: (-part[k], k))[:3]}


def should_run(due: bool, backlog: int, backlog_target: int, challenged: int, challenged_target: int, score: float, threshold: float = 0.6) -> str | None:
    """Why a run should start now, or None: interval, backlog pressure, challenged pressure, utility."""
    if due:
        return "interval"
    if backlog >= max(25, 0.5 * backlog_target):
        return "backlog"
    if challenged_target and challenged >= challenged_target:
        return "challenged"
    return "utility" if score >= threshold else None


def health(backend_ok: bool, tombstone_ratio: float, consistency: float, hours_since_run: float | None) -> str:
    if not backend_ok:
        return "error"
    return "degraded" if tombstone_ratio >= 0.2 or consistency < 0.995 or (hours_since_run is not None and hours_since_run > 48) else "healthy"


def posture(claims: int, challenged: int, source_ratio: float) -> str:
    if not claims:
        return "bootstrapping"
    if challenged:
        return "drift_watch"
    return "needs_provenance" if source_ratio < 0.7 else "trusted_reuse_ready"
