"""Names of the engine's queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mizan.plans import alert_queries, document_queries, event_queries, json_queries, reading_queries, search_queries, text_queries, upkeep_queries, valuation_queries

MODULES = (search_queries, event_queries, valuation_queries, reading_queries, document_queries, alert_queries, text_queries, json_queries, upkeep_queries)
FLAGSHIP = "qry01_search_page"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a filtered search, best deals first."""
    return queries()[FLAGSHIP](spark, sf_dir)


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
    for module in MODULES:
        if twice := out.keys() & module.QUERIES.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= module.QUERIES
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
