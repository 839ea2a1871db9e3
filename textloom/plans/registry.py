"""Registry of named queries (one per operator id of the inventory) and the
equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(qid: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``qid``; ``sql`` is the
    oracle. Omit ``sql`` only for operators with no SQL form (ML, random draws)."""
    def deco(fn: QueryFn) -> QueryFn:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLES[qid] = sql
        return fn
    return deco
