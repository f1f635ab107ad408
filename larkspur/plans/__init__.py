"""Registered queries over the library's operators, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, deid, leakage, policies, recall, retrieval, routing, selection, tables

_ALL = {k: q for part in (routing, selection, retrieval, deid, analytics, policies, leakage, recall, tables) for k, q in part.QUERIES.items()}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: query for k, (query, _) in _ALL.items()}
ORACLE_SQL: dict[str, str] = {k: sql for k, (_, sql) in _ALL.items() if sql is not None}
