"""Calendar labels and week arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Epidemic waves as (first day after the wave, label); the last wave is open.
WAVE_ENDS = [
    ("2020-10-01", "2020_summer"),
    ("2021-03-01", "2020_21_winter"),
    ("2021-07-01", "2021_spring"),
    ("2021-11-01", "delta"),
    ("2022-03-01", "omicron_BA1"),
    ("2022-07-01", "omicron_BA2"),
]
LAST_WAVE = "omicron_later"


def period_label(day: Column, ends: list[tuple[str, str]] = WAVE_ENDS, last: str = LAST_WAVE) -> Column:
    """Label of the half-open period a day falls in."""
    label = F.lit(last)
    for end, name in reversed(ends):
        label = F.when(day < F.lit(end).cast("date"), F.lit(name)).otherwise(label)
    return F.when(day.isNotNull(), label)


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def monday(day: Column) -> Column:
    """First day of the Monday-to-Sunday week."""
    return F.date_trunc("week", day).cast("date")


def week_start_sunday(day: Column) -> Column:
    """The same day if it is a Sunday, else the Sunday before."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_span_label(day: Column) -> Column:
    """``first/last`` text of the Monday-to-Sunday week."""
    first = monday(day)
    return F.concat_ws("/", first.cast("string"), F.date_add(first, 6).cast("string"))


def event_week(day: Column, signal: Column) -> Column:
    """Whole weeks between two days (seven never divides a day count to an exact half)."""
    return F.round(F.datediff(day, signal) / F.lit(7.0)).cast("int")
