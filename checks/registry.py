"""Registered queries: a Spark callable, the SQL it must agree with, and the output columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "d":
        return c.cast("date").cast("string").alias(name)
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind == "b":
        return c.cast("boolean").cast("bigint").alias(name)
    if kind.startswith("f"):
        digits = int(kind[1:] or 6)
        return (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(name)
    return c.cast("string").alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "d":
        return f"CAST(CAST({name} AS DATE) AS VARCHAR) AS {name}"
    if kind == "t":
        return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"
    if kind == "b":
        return f"CAST(CAST({name} AS BOOLEAN) AS BIGINT) AS {name}"
    if kind.startswith("f"):
        return f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS {name}"
    return f"CAST({name} AS VARCHAR) AS {name}"


def query(name: str, columns: str, sql: str | None = None):
    """Register a function of (spark, sf_dir); ``columns`` lists ``name:kind`` pairs.

    Kinds: i integer, d day, t timestamp, b flag, s text, fN rounded to N digits (6).
    """
    fields = [tuple(p.split(":")) for p in columns.split()]

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).select(*[_spark_column(n, k) for n, k in fields])

        text = None
        if sql is not None:
            text = f"SELECT {', '.join(_sql_column(n, k) for n, k in fields)} FROM (\n{sql}\n) AS result"
        QUERIES[name] = Query(run, text)
        return fn

    return wrap
