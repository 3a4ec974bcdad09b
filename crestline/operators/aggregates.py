"""Aggregate expressions and small aggregate operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def mean_in_weeks(value: Column | str, weeks: Iterable[int], week: str = "event_week") -> Column:
    """Mean over the listed event weeks; several windows share one ``groupBy``."""
    v = F.col(value) if isinstance(value, str) else value
    return F.avg(F.when(F.col(week).isin(*weeks), v))


def slope_in_weeks(value: str, weeks: Iterable[int], week: str = "event_week") -> Column:
    """Least-squares slope over the listed weeks; NULL with fewer than two observed weeks."""
    use = F.col(week).isin(*weeks) & F.col(value).isNotNull()
    return F.regr_slope(F.when(use, F.col(value)), F.when(use, F.col(week).cast("double")))


def sd_in_weeks(value: str, weeks: Iterable[int], week: str = "event_week") -> Column:
    return F.stddev_samp(F.when(F.col(week).isin(*weeks), F.col(value)))


def mode_in_weeks(value: str, weeks: Iterable[int], default: str = "Unknown", week: str = "event_week") -> Column:
    """Most frequent value, the smallest on ties."""
    return F.coalesce(F.mode(F.when(F.col(week).isin(*weeks), F.col(value)), True), F.lit(default))


def weighted_mean(x: Column | str, w: Column | str) -> Column:
    """Mean weighted by positive weights where both are observed."""
    x = F.col(x) if isinstance(x, str) else x
    w = F.col(w) if isinstance(w, str) else w
    use = x.isNotNull() & (w > 0)
    return F.try_divide(F.sum(F.when(use, x * w)), F.sum(F.when(use, w)))


def weighted_median_day(df: DataFrame, keys: Sequence[str], day: str, weight: str, out: str) -> DataFrame:
    """First day at which the running weight reaches half of the total.

    Weights are summed per (key, day) first, so the running sum sees one row per day.
    """
    daily = (
        df.where((F.col(weight) > 0) & F.col(day).isNotNull())
        .groupBy(*keys, day)
        .agg(F.sum(weight).alias("_w"))
    )
    per_key = Window.partitionBy(*keys)
    running = per_key.orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return (
        daily.withColumn("_upto", F.sum("_w").over(running))
        .withColumn("_all", F.sum("_w").over(per_key))
        .where(F.col("_upto") >= F.col("_all") / 2)
        .groupBy(*keys)
        .agg(F.min(day).alias(out))
    )


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for every ordered pair of columns, in one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs
    ])
    return row.select(F.inline(cells))


def fit_quality(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """One row ``(n, r2, rmse)`` over rows with both values."""
    y, p = F.col(observed), F.col(predicted)
    use = df.where(y.isNotNull() & p.isNotNull())
    sse = F.sum((y - p) * (y - p))
    return use.agg(
        F.count("*").alias("n"),
        (F.lit(1.0) - F.try_divide(sse, F.regr_syy(y, y))).alias("r2"),
        F.sqrt(sse / F.count("*")).alias("rmse"),
    )


def coverage(observed: Column, total: Column) -> Column:
    return F.try_divide(observed, total)


def group_validity(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Size, smallest and largest flag per group."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("size"), F.min(flag).alias("low"), F.max(flag).alias("high")
    )


def replicate_summary(estimates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summary of re-estimates (left-out clusters, repeated splits): one row per model."""
    return estimates.groupBy(*by).agg(
        F.count("coef").alias("n_models"),
        F.percentile("coef", F.lit(0.5)).alias("median_coef"),
        F.min("coef").alias("min_coef"),
        F.max("coef").alias("max_coef"),
        F.stddev_samp("coef").alias("sd_coef"),
        share(F.col("coef") < 0).alias("fraction_negative"),
        share(F.col("p_value") < 0.05).alias("fraction_p_lt_0_05"),
    )
