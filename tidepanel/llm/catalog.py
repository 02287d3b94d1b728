"""The registered queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import queries_other, queries_text

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {**queries_other.QUERIES, **queries_text.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**queries_other.ORACLE_SQL, **queries_text.ORACLE_SQL}
