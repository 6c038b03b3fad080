"""Names of all queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import drafts, pieces, records, research, tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return research.QUERIES | tables.QUERIES | drafts.QUERIES | records.QUERIES | pieces.QUERIES


def oracle_sql() -> dict[str, str]:
    return research.SQL | tables.SQL | drafts.SQL | records.SQL | pieces.SQL
