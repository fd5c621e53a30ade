"""Registered queries: each operator on the whole test tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from glyphfold.catalog import aggs, checks, joins, layouts, redaction, scalars, sources, streams, windows  # noqa: F401

    return QUERIES, ORACLE
