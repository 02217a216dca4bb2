"""Queries by key: an operator over frames of the data model, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quoin.sources.bridge import duck, frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, frames: list[str], operator: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Register ``operator``, applied to whole frames, under ``key``; braces in ``sql`` name frames."""
    if key in QUERIES:
        raise KeyError(key)
    QUERIES[key] = lambda spark, sf_dir: operator(*(frame(spark, sf_dir, f) for f in frames))
    if sql:
        SQL[key] = duck(sql)
