"""Registered queries of the table-health and dashboard operators, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog import charts, cleaning, dashboards, messages, profiles

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = charts.ENTRIES | profiles.ENTRIES | cleaning.ENTRIES | dashboards.ENTRIES | messages.ENTRIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ENTRIES["health"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: function for name, (function, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
