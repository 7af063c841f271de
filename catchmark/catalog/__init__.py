"""Registered queries: each name maps to a Spark function (spark, sf_dir) and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from catchmark.catalog import cleaning, comparing, counting, flowing, locating

    out: dict[str, Query] = {}
    for module in (cleaning, locating, counting, flowing, comparing):
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
