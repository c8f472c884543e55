"""Named queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None = None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` computes the same rows from the same tables."""

    def register(fn: Query) -> Query:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Entry(fn, sql)
        return fn

    return register


def load_all() -> dict[str, Entry]:
    from docketry.catalog import answers, build, fields, metering, parsing, retrieval, whole  # noqa: F401

    return REGISTRY
