"""Valid time, as-of status and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(value: str | Column) -> Column:
    """A UTC instant from text or a column; text that is no time is null."""
    return F.try_to_timestamp(F.lit(value)) if isinstance(value, str) else value


def valid_at(now: str | Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open [start, end); a null bound is open."""
    t = instant(now)
    return (F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (F.col(end) > t))


def records_as_of(records: DataFrame, as_of: str) -> DataFrame:
    """Records known and valid at as_of, and not deleted."""
    return records.filter(~F.col("deleted") & (F.col("created_at") <= instant(as_of)) & valid_at(as_of))


def first_challenges(events: DataFrame) -> DataFrame:
    """Time of each claim's first challenge."""
    return events.filter("event_type = 'challenged'").groupBy(F.col("claim_id").alias("id")).agg(F.min("created_at").alias("first_challenged"))


def active_claims(claims: DataFrame, now: str, claim_type: str | None = None) -> DataFrame:
    out = claims.filter((F.col("status") == "active") & valid_at(now))
    return out if claim_type is None else out.filter(F.col("claim_type") == claim_type)


def claims_as_of(claims: DataFrame, events: DataFrame, as_of: str, claim_type: str | None = None) -> DataFrame:
    """Claims valid at as_of with the status they then had.

    A claim now challenged or expired counts as challenged only if its first challenge was by then, else as active.
    """
    t = instant(as_of)
    rows = claims.filter((F.col("created_at") <= t) & valid_at(as_of))
    if claim_type is not None:
        rows = rows.filter(F.col("claim_type") == claim_type)
    known = F.col("first_challenged").isNotNull() & (F.col("first_challenged") <= t)
    status = F.when(F.col("status") == "active", "active").when(known, "challenged").otherwise("active")
    return rows.join(first_challenges(events), "id", "left").withColumn("status", status)


def next_change(records: DataFrame, now: str) -> DataFrame:
    """When a cache of current records has to be refreshed: the next start or end of validity."""
    t = instant(now)
    return records.filter("NOT deleted").agg(F.min(F.least(F.when(F.col("valid_from") > t, F.col("valid_from")), F.when(F.col("valid_until") > t, F.col("valid_until")))).alias("next_change"))


def age_days(then: Column, now: str | Column) -> Column:
    """Days from then to now, not below zero; null where a time is missing."""
    days = (F.unix_micros(instant(now).cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 86_400_000_000
    return F.when(days.isNotNull(), F.greatest(F.lit(0.0), days))


def recency(then: Column, now: str | Column, half_life: float = 90.0) -> Column:
    """Halves every half_life days; one half where the time is missing."""
    return F.coalesce(F.exp(-age_days(then, now) * F.log(F.lit(2.0)) / half_life), F.lit(0.5))
