"""Surge candidates, greedy minimum-gap episodes and gap sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def spaced_episodes(
    candidates: DataFrame,
    keys: Sequence[str],
    day: str,
    min_gap_days: int,
    carry: Sequence[str] = (),
    number: str = "episode_no",
) -> DataFrame:
    """Keep a candidate when it lies at least ``min_gap_days`` after the last one kept.

    The rule looks back at what was kept, so it is a fold over the entity's sorted candidate
    days.  Candidates come from a panel: at most one per entity and day, a bounded array.
    """
    item = F.struct(F.col(day).alias(day), *[F.col(c) for c in carry])
    collected = candidates.where(F.col(day).isNotNull()).groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_days")
    )

    def step(kept: Column, x: Column) -> Column:
        far = F.datediff(x[day], F.element_at(kept, -1)[day]) >= min_gap_days
        return F.when((F.size(kept) == 0) | far, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("_days", F.filter("_days", lambda x: F.lit(False)), step)
    return collected.select(*keys, F.posexplode(kept).alias("_pos", "_kept")).select(
        *keys, (F.col("_pos") + 1).alias(number), "_kept.*"
    )


def _seconds(time: str) -> Column:
    return F.unix_timestamp(F.col(time).cast("timestamp"))


def session_cells(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """``(keys, cell, session_no, first, last, rows)`` for sessions joined by gaps up to the limit.

    A cell is a stretch of one gap length, so rows of one cell always share a session.  Rows
    collapse into cells before the shuffle; only cells are ordered per key, and their number
    is bounded by the time range, not by the rows a busy key has.
    """
    t = _seconds(time)
    cells = (
        df.where(F.col(time).isNotNull())
        .groupBy(*keys, F.floor(t / gap_seconds).alias("cell"))
        .agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("rows"))
    )
    w = Window.partitionBy(*keys).orderBy("cell")
    opens = F.coalesce((F.col("first") - F.lag("last").over(w) > gap_seconds).cast("int"), F.lit(1))
    return cells.withColumn("_opens", opens).withColumn(
        "session_no", F.sum("_opens").over(w).cast("int")
    ).drop("_opens")


def gap_sessions(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """``(keys, session_no, session_start, session_end, rows)``."""
    return (
        session_cells(df, keys, time, gap_seconds)
        .groupBy(*keys, "session_no")
        .agg(
            F.timestamp_seconds(F.min("first")).alias("session_start"),
            F.timestamp_seconds(F.max("last")).alias("session_end"),
            F.sum("rows").alias("rows"),
        )
    )


def assign_sessions(df: DataFrame, keys: Sequence[str], time: str, gap_seconds: int) -> DataFrame:
    """Rows with their ``session_no``; a busy key spreads over its cells in the join."""
    cells = session_cells(df, keys, time, gap_seconds).select(*keys, "cell", "session_no")
    return (
        df.withColumn("cell", F.floor(_seconds(time) / gap_seconds))
        .join(cells, [*keys, "cell"])
        .drop("cell")
    )
