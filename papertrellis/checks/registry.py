"""Register a query and its oracle under one name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papertrellis.checks.views import Views, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None, **extra: str):
    """Decorate a function Views -> DataFrame; ``extra`` adds oracle-only CTEs."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Views(spark, folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, extra)
        return fn

    return add


def joined(c: Column | str) -> Column:
    """Array shown as text joined with '|', so both engines hash the same value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.concat_ws("|", c.cast("array<string>")), F.lit(""))


def rounded(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)
