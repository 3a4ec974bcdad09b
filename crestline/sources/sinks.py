"""Result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a stage or result table; ``fmt='csv'`` writes a header line per file."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def to_json_lines(df: DataFrame, column: str = "json") -> DataFrame:
    """One JSON document per row, NULL fields kept."""
    fields = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias(column))


def nested_json(spark: SparkSession, stages: dict[str, DataFrame], lists: dict[str, DataFrame], column: str = "json") -> DataFrame:
    """One JSON document: an object per one-row summary in ``stages``, an array of objects per table in ``lists``.

    Tables are summaries (estimates, groups), ordered by their columns; NULL fields are kept.
    """
    parts = [df.select(F.struct(*df.columns)).scalar().alias(name) for name, df in stages.items()]
    parts += [df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)))).scalar().alias(name) for name, df in lists.items()]
    return spark.range(1).select(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias(column))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_bucketed(df: DataFrame, table: str, key: str, order: str, buckets: int) -> None:
    """Panel table bucketed by entity and sorted by time.

    Windows, event-window joins and per-episode aggregates by the entity then read their own
    buckets without an exchange.  A panel has at most one row per entity and day, so buckets stay
    even; choose the number so that one bucket fits a task.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).saveAsTable(table)
