"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a (spark, sf_dir) function under its name, with equivalent DuckDB SQL."""

    def keep(f):
        QUERIES[name or f.__name__] = Query(f, oracle)
        return f

    return keep
