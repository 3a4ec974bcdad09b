"""Residual-on-residual estimates and the statistics read from them, as plain SQL aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from crestline.functions.tails import t_critical
from crestline.operators.quantiles import quantile_value
from crestline.operators.regression import Z95
from crestline.operators.windows import zscore


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal tail of a few result rows."""
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")


@F.pandas_udf(DoubleType())
def critical_t(alpha: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided t quantile of a few result rows."""
    return pd.Series([t_critical(a, d) for a, d in zip(alpha, dof)])


def slope_through_origin(
    df: DataFrame, outcome: str, exposure: str, cluster: str, entity: str, by: Sequence[str] = ()
) -> DataFrame:
    """No-intercept slope per group with clustered error, from sums per cluster.

    The meat ``sum (y't - theta t't)^2`` over clusters expands into three more sums, so two
    combining aggregates are all; entities are counted on the way (they lie within clusters).
    """
    y, t = F.col(outcome).cast("double"), F.col(exposure).cast("double")
    use = df.where(y.isNotNull() & t.isNotNull() & F.col(cluster).isNotNull())
    cells = use.groupBy(*by, cluster, entity).agg(
        F.count("*").alias("n"), F.sum(t * y).alias("ty"), F.sum(t * t).alias("tt"),
        F.sum(t).alias("t1"), F.sum(y).alias("y1"), F.sum(y * y).alias("yy"),
    )
    return slope_of_sums(cells, by, cluster)


def slope_of_sums(cells: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """The slope from sums per (by, cluster, entity): n, ty, tt, t1, y1, yy."""
    names = ["n", "ty", "tt", "t1", "y1", "yy"]
    clusters = cells.groupBy(*by, cluster).agg(*[F.sum(c).alias(c) for c in names], F.count("*").alias("e"))
    sums = clusters.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in names], F.sum("e").alias("entities"), F.count("*").alias("clusters"),
        F.sum(F.col("ty") * F.col("ty")).alias("aa"), F.sum(F.col("ty") * F.col("tt")).alias("ab"),
        F.sum(F.col("tt") * F.col("tt")).alias("bb"),
    )
    n, g = F.col("n"), F.col("clusters")
    theta = F.try_divide(F.col("ty"), F.col("tt"))
    meat = F.greatest(F.col("aa") - 2 * theta * F.col("ab") + theta * theta * F.col("bb"), F.lit(0.0))
    sd = lambda s2, s1: F.sqrt(F.greatest((F.col(s2) - F.col(s1) * F.col(s1) / n) / F.nullif(n - 1, F.lit(0)), F.lit(0.0)))
    return (
        sums.withColumn("theta", theta)
        .withColumn("se", F.sqrt(meat * F.try_divide(g, g - 1)) / F.col("tt"))
        .withColumn("stat", F.try_divide(F.col("theta"), F.col("se")))
        .withColumn("p_value", normal_p("stat"))
        .withColumn("ci_low", F.col("theta") - F.lit(Z95) * F.col("se"))
        .withColumn("ci_high", F.col("theta") + F.lit(Z95) * F.col("se"))
        .withColumn("exposure_sd", sd("tt", "t1"))
        .withColumn("outcome_sd", sd("yy", "y1"))
        .withColumn("std_theta", F.try_divide(F.col("theta") * F.col("exposure_sd"), F.col("outcome_sd")))
        .select(*by, "n", "entities", "clusters", "theta", "se", "stat", "p_value", "ci_low", "ci_high",
                "exposure_sd", "outcome_sd", "std_theta")
    )


def per_sd(estimates: DataFrame, scale: float = 1.0) -> DataFrame:
    """Effects and intervals per one standard deviation of the exposure."""
    sd = F.col("exposure_sd") * F.lit(scale)
    return estimates.withColumns({
        "effect_per_sd": F.col("theta") * sd,
        "ci_low_per_sd": F.col("ci_low") * sd,
        "ci_high_per_sd": F.col("ci_high") * sd,
    })


def support(df: DataFrame, exposure: str, prob: float = 0.99) -> DataFrame:
    """Rows whose absolute exposure residual is at most its exact quantile."""
    sized = df.withColumn("_abs", F.abs(F.col(exposure)))
    return sized.where(F.col("_abs") <= F.lit(quantile_value(sized, "_abs", prob))).drop("_abs")


def long_covariates(df: DataFrame, covariates: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(keep, covariate, x)``: one row per observed covariate value."""
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])
    return df.select(*keep, F.inline(cells)).where(F.col("x").isNotNull())


def balance(
    df: DataFrame, covariates: Sequence[str], responses: Sequence[str], cluster: str, entity: str, min_rows: int = 50
) -> DataFrame:
    """Each response on each standardised covariate, in one pass over the unpivoted rows."""
    long = long_covariates(df, covariates, [cluster, entity, *responses])
    long = long.where(" AND ".join(f"`{r}` IS NOT NULL" for r in responses))
    z = zscore(long, ["x"], ["covariate"])
    cells = F.array(*[F.struct(F.lit(r).alias("response"), F.col(r).alias("y")) for r in responses])
    stacked = z.select("covariate", cluster, entity, "x_z", F.inline(cells))
    fit = slope_through_origin(stacked, "y", "x_z", cluster, entity, ["response", "covariate"])
    return fit.where((F.col("n") >= min_rows) & F.col("theta").isNotNull()).withColumnRenamed("theta", "coef_per_sd")


def partial_r2(stat: Column, dof: Column) -> Column:
    return stat * stat / (stat * stat + dof)


def equal_strength(stat: Column, dof: Column) -> Column:
    """Root in (0, 1) of ``r^2 / (1 - r) = stat^2 / dof``."""
    f2 = stat * stat / dof
    return (F.sqrt(f2 * f2 + 4 * f2) - f2) / 2


def robustness(estimates: DataFrame, q: float = 1.0, alpha: float = 1.0, dof: str = "dof", prefix: str = "rv") -> DataFrame:
    """Robustness value and extreme robustness value at share ``q`` and level ``alpha``."""
    d = F.col(dof).cast("double")
    f = F.lit(q) * F.abs(F.col("stat") / F.sqrt(d))
    if alpha >= 1:
        crit = F.lit(0.0)
    else:
        crit = critical_t(F.lit(float(alpha)), d - 1) / F.sqrt(d - 1)
    f2, c2 = f * f, crit * crit
    extreme = F.when(f2 <= c2, F.lit(0.0)).otherwise((f2 - c2) / (1 + f2))
    gap = f - crit
    inner = F.when(F.abs(gap) < 1e-15, F.lit(0.0)).otherwise(2 / (1 + F.sqrt(1 + 4 / (gap * gap))))
    bound = (crit > 0) & (gap > 0) & (f > F.try_divide(F.lit(1.0), crit))
    value = F.when(gap < 0, F.lit(0.0)).when(bound, extreme).otherwise(inner)
    return estimates.withColumn(prefix, value).withColumn(f"{prefix}_extreme", extreme)


def against_reference(estimates: DataFrame, theta: float, by: str = "theta") -> DataFrame:
    """Absolute and relative difference to a locked estimate."""
    diff = F.col(by) - F.lit(theta)
    return estimates.withColumn("difference", diff).withColumn(
        "relative_difference", diff / F.lit(theta) if abs(theta) > 1e-15 else F.lit(None).cast("double")
    )


def sign_pattern(estimates: DataFrame, by: Sequence[str], outcome: str, outcomes: Sequence[str]) -> DataFrame:
    """Direction of each outcome's estimate, one column per outcome."""
    direction = F.when(F.col("theta") < 0, "negative").when(F.col("theta") > 0, "positive").otherwise("zero")
    return estimates.withColumn("_d", direction).groupBy(*by).pivot(outcome, list(outcomes)).agg(F.first("_d"))


def median_of_repetitions(reps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Median estimate over repeated splits; the error adds each split's deviation from it."""
    medians = reps.groupBy(*by).agg(
        F.percentile("theta", F.lit(0.5)).alias("theta"), F.collect_list(F.struct("theta", "se")).alias("_r")
    )
    spread = F.transform("_r", lambda r: r["se"] * r["se"] + (r["theta"] - F.col("theta")) * (r["theta"] - F.col("theta")))
    middle = F.array_sort(spread)
    k = F.size(middle)
    mid = (F.element_at(middle, F.floor((k + 1) / 2).cast("int")) + F.element_at(middle, F.ceil((k + 1) / 2).cast("int"))) / 2
    return medians.withColumn("se", F.sqrt(mid)).drop("_r")
