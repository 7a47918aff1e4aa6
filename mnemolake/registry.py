"""Queries by name, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (entities) under a name; `entities` gives the driver tables in the engine's roles."""

    def register(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        from mnemolake.plans.entities import Entities, with_entities

        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: build(Entities(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_entities(sql)
        return build

    return register
