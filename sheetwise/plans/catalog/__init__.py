"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheetwise.plans.fixtures import Tables, tables

Query = Callable[[Tables], DataFrame]


def all_entries() -> dict[str, tuple[Query, str | None]]:
    from sheetwise.plans.catalog import (
        contract, evidence, grading, keys_layout, ownership, records, rereads, rules, summaries,
    )

    entries: dict[str, tuple[Query, str | None]] = {}
    for module in (
        rules, grading, ownership, rereads, evidence, keys_layout, contract, summaries, records,
    ):
        for name, entry in module.ENTRIES.items():
            if name in entries:
                raise ValueError(f"query {name} is registered twice")
            entries[name] = entry
    return entries


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: query(tables(spark, sf_dir))

    return {name: bind(query) for name, (query, _) in all_entries().items()}


def check_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in all_entries().items() if sql is not None}
