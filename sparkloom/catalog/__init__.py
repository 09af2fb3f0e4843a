"""The registry of queries: each a plan over the tables of a folder, the inventory ids it covers, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    ids: tuple[str, ...]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Registers a function (t) -> DataFrame, where t(name) is a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = Query(run, tuple(ids.split()), sql)
        return run

    return add


def load() -> dict[str, Query]:
    from . import exchange, indexes, lexical, publication, relational, scalar, statistics, validation, vector, versioned, workloads, worlds  # noqa: F401

    return QUERIES
