"""Gates and profiles, each a single aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def write_measured(df: DataFrame, path: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict[str, float]]:
    """Write a stage and return it as read back, with aggregates of its rows that were taken while they were written.

    The metrics are combining aggregates without distinct ones (counts, sums, averages, quantile
    sketches); they cost no scan of their own.
    """
    seen = Observation()
    df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def gate(stage: str, seen: dict[str, float], **bounds: tuple[float | None, float | None]) -> None:
    """Fail unless every named metric lies within its bounds (None: open)."""
    for name, (low, high) in bounds.items():
        value = seen[name]
        if value is None or (low is not None and value < low) or (high is not None and value > high):
            raise ValueError(f"{stage}: {name} is {value}, wanted {'any' if low is None else low} to {'any' if high is None else high}")


def measured_summary(spark: SparkSession, stages: dict[str, dict[str, float]]) -> DataFrame:
    """Rows ``(stage, metric, value)`` from metrics that are already there."""
    rows = [(s, k, None if v is None else float(v)) for s, seen in stages.items() for k, v in seen.items()]
    return spark.createDataFrame(rows, "stage string, metric string, value double")


def require_rows(df: DataFrame, name: str, at_least: int = 1) -> DataFrame:
    """Fail with a diagnostic when fewer rows are present than the next step needs."""
    found = df.limit(at_least).count()
    if found < at_least:
        raise ValueError(f"{name}: {found} rows, at least {at_least} needed")
    return df


def assert_total(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """One row with the column total; evaluating it fails outside [low, high]."""
    total = df.agg(F.sum(column).alias("total"))
    ok = F.col("total").between(low, high)
    return total.where(F.assert_true(ok, F.lit(f"total of {column} is out of range")).isNull())


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """``(column, dtype, missing, unique)`` per column.

    Values are unpivoted and counted per (column, value), so equal values collapse before the
    shuffle and no column is gathered in one task.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    long = df.select(cells.alias("cell")).select("cell.*")
    if approximate:
        counted = long.groupBy("column").agg(
            F.count_if(F.col("value").isNull()).alias("missing"),
            F.approx_count_distinct("value").alias("unique"),
        )
    else:
        counted = (
            long.groupBy("column", "value")
            .agg(F.count("*").alias("n"))
            .groupBy("column")
            .agg(
                F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
                F.count("value").alias("unique"),
            )
        )
    dtype = F.create_map(*[F.lit(x) for c in columns for x in (c, types[c])])
    return counted.select("column", dtype[F.col("column")].alias("dtype"), "missing", "unique")


def stage_summary(stages: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Rows ``(stage, metric, value)``: one aggregate per stage, each reduced to one row."""
    parts = []
    for name, (df, metrics) in stages.items():
        row = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
        cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])
        parts.append(row.select(F.lit(name).alias("stage"), F.inline(cells)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
