"""Guarded change measures between a pre and a post level."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log_change(post: Column, pre: Column, scale: float = 100.0) -> Column:
    """``scale * (ln post - ln pre)`` when both levels are positive."""
    return F.when((post > 0) & (pre > 0), F.lit(scale) * (F.ln(post) - F.ln(pre)))


def log1p_change(post: Column, pre: Column, scale: float = 100.0) -> Column:
    """Log-of-one-plus change when both levels are non-negative."""
    return F.when((post >= 0) & (pre >= 0), F.lit(scale) * (F.log1p(post) - F.log1p(pre)))


def percent_to_log(pct: Column, scale: float = 100.0) -> Column:
    """Percent change rewritten as a log ratio."""
    ratio = F.lit(1.0) + pct / 100.0
    return F.when(ratio > 0, F.lit(scale) * F.ln(ratio))


def log_level(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def fixed_base_change(post: Column, pre: Column, base: Column) -> Column:
    """Change relative to a fixed pre-period base, NULL unless the base is positive."""
    return F.when(base > 0, (post - pre) / base)


def sign_label(x: Column) -> Column:
    return F.when(x < 0, "negative").when(x > 0, "positive").when(x == 0, "zero")


def per_100k(count: Column, population: Column) -> Column:
    return F.when(population > 0, count / population * 100000.0)


def scaled_effect(theta: Column, sd: Column, scale: float = 1.0) -> Column:
    """Effect per one standard deviation of the exposure (``scale=100`` gives percentage points)."""
    return theta * sd * F.lit(scale)
