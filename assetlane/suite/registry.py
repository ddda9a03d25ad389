"""Named queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    run: Query
    sql: str | None = None


CASES: dict[str, Case] = {}


def case(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``query(spark, sf_dir)``; without SQL it is tested against brute force instead."""
    def add(fn: Query) -> Query:
        if name in CASES:
            raise ValueError(f"duplicate query {name}")
        CASES[name] = Case(fn, sql)
        return fn

    return add
