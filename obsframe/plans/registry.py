"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lenses import Tables, with_lenses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_lenses(sql, uses)
        return fn

    return add


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines; never minus zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def R(expr: str, digits: int = 6) -> str:
    """The SQL twin of ``r``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")
