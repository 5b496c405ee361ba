"""Registration of catalogue queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(*covers: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a builder under its own name; ``covers`` are inventory ids."""

    def register(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build.__name__, covers, build, sql)
        return build

    return register
