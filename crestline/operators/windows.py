"""Windows over panels.

A panel has one row per (entity, day or week), so an entity never has more rows than the
calendar has days: a window per entity stays small however many raw rows the entity had.
Raw rows are brought to that grain first by ``to_panel`` (a combining aggregate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from crestline.session import cut_lineage


def to_panel(df: DataFrame, keys: Sequence[str | Column], aggregates: dict[str, Column]) -> DataFrame:
    """One row per key."""
    return df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])


def _rows(keys: Sequence[str], order: str, first: int, last: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)


def _days(keys: Sequence[str], order: str, first: int, last: int):
    return Window.partitionBy(*keys).orderBy(F.unix_date(order)).rangeBetween(first, last)


def rolling_mean(keys: Sequence[str], order: str, value: str, rows: int, min_observed: int) -> Column:
    """Mean of the current and the ``rows - 1`` rows before, NULL with too few values."""
    w = _rows(keys, order, -(rows - 1), 0)
    return F.when(F.count(value).over(w) >= min_observed, F.avg(value).over(w))


def trailing_median(
    keys: Sequence[str], order: str, value: str, length: int, min_observed: int, by_days: bool = False
) -> Column:
    """Median of the ``length`` rows (or days) before the current row."""
    w = (_days if by_days else _rows)(keys, order, -length, -1)
    return F.when(F.count(value).over(w) >= min_observed, F.percentile(value, F.lit(0.5)).over(w))


def relative_change(value: Column, baseline: Column) -> Column:
    return value / F.nullif(baseline, F.lit(0.0)) - F.lit(1.0)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key under a total order, as a combining aggregate (no sort per key)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last row of each key under a total order."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*")


def group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "mean_") -> DataFrame:
    """Rows with their group's means: combining aggregate, then a join AQE can split when skewed."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(prefix + c) for c in columns])
    return df.join(means, list(keys), "left")


def demean(df: DataFrame, keys: Sequence[str], columns: Sequence[str], suffix: str = "_within") -> DataFrame:
    """Deviations from group means."""
    joined = group_means(df, keys, columns, "_mean_")
    return joined.withColumns({c + suffix: F.col(c) - F.col("_mean_" + c) for c in columns}).drop(
        *["_mean_" + c for c in columns]
    )


def zscore(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), suffix: str = "_z") -> DataFrame:
    """Standard scores with the sample deviation; 0 where the deviation is 0 or undefined.

    Without keys the moments are one scalar subquery, so no global window and no cross join.
    """
    moments = [
        m
        for c in columns
        for m in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))
    ]
    if keys:
        joined = df.join(df.groupBy(*keys).agg(*moments), list(keys), "left")
        at = {c: (F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}
    else:
        joined = df.withColumn("_moments", df.agg(F.struct(*moments)).scalar())
        at = {c: (F.col(f"_moments._m_{c}"), F.col(f"_moments._s_{c}")) for c in columns}
    scored = {
        c + suffix: F.when(
            F.col(c).isNotNull(),
            F.coalesce(F.try_divide(F.col(c) - m, F.when(s > 0, s)), F.lit(0.0)),
        )
        for c, (m, s) in at.items()
    }
    return joined.withColumns(scored).drop("_moments", *[n for c in columns for n in (f"_m_{c}", f"_s_{c}")])


def collapse_rare(df: DataFrame, column: str, at_least: int, other: str = "Other") -> DataFrame:
    """Levels with fewer rows than ``at_least`` become ``other``."""
    sizes = df.groupBy(column).agg(F.count("*").alias("_size"))
    return (
        df.join(sizes, df[column].eqNullSafe(sizes[column]), "left")
        .drop(sizes[column])
        .withColumn(column, F.when(F.col("_size") >= at_least, F.col(column)).otherwise(F.lit(other)))
        .drop("_size")
    )


def calendar_index(df: DataFrame, day: str, out: str, days_per_unit: float = 7.0) -> DataFrame:
    """Units since the first day of the whole table (the minimum is a scalar subquery)."""
    first = df.agg(F.min(day)).scalar()
    return df.withColumn(out, F.datediff(F.col(day), first) / F.lit(days_per_unit))


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows with their place (from 1) in the order of the whole table.

    Ranges of the order are sorted in parallel; a range's first place is the number of rows before
    it, a running sum over one row per range.  No task sees more than a range.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(starts, "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")
