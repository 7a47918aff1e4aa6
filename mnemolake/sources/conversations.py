"""Conversations as episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def turns_to_episodes(turns: DataFrame) -> DataFrame:
    """One episode per turn: '[conversation] role: text'. Turns without role or text are left out."""
    content = F.concat(F.lit("["), F.col("conv_id").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    return turns.filter(F.col("text").isNotNull() & F.col("role").isNotNull()).select("conv_id", "turn", content.alias("content"))


def sessions_to_episodes(conversations: DataFrame, sessions: list[str]) -> DataFrame:
    """Nested dialogues (session_N: array<struct<speaker,text>>, session_N_date_time) to one episode per turn, '[date] speaker: text'."""
    out = None
    for k, name in enumerate(sessions):
        rows = conversations.select(F.lit(k).alias("session"), F.col(f"{name}_date_time").alias("date"), F.posexplode(name).alias("turn", "t")).select("session", "turn", F.concat(F.lit("["), F.col("date"), F.lit("] "), F.col("t.speaker"), F.lit(": "), F.col("t.text")).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out
