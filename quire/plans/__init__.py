"""Registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import boxes, corpus, diagnostics, documents, hints, layout, outputs, reading_order, records, repair, results, sequential, store, streams, text_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _module in (text_rules, documents, reading_order, corpus, layout, diagnostics, store, outputs, hints, results, sequential, streams, boxes, repair, records):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
