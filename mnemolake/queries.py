"""Queries of the engine's own operators and the SQL that checks them."""

from __future__ import annotations

from mnemolake.plans import q_more, q_rank, q_reads, q_text, q_whole  # noqa: F401  registers them
from mnemolake.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
