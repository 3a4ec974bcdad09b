"""Group folds: balanced and seeded random, ranked without gathering the groups anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ranked(groups: DataFrame, size: Column, order: Column, per: Sequence[str] = ()) -> DataFrame:
    """Zero-based rank by (size descending, order text), within each value of ``per``.

    Counts per (size, two leading characters of the hash) are few; their running total gives
    each cell an offset, and rows are numbered only inside their cell.
    """
    keyed = groups.withColumn("_size", size).withColumn("_h", order).withColumn("_cell", F.substring("_h", 1, 2))
    cells = keyed.groupBy(*per, "_size", "_cell").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*per).orderBy(F.desc("_size"), "_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_offset", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inside = Window.partitionBy(*per, "_size", "_cell").orderBy("_h")
    return (
        keyed.join(offsets, [*per, "_size", "_cell"])
        .withColumn("rank", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_size", "_cell", "_h", "_offset")
    )


def balanced_folds(df: DataFrame, group: str, k: int, out: str = "fold") -> DataFrame:
    """``(group, rows, fold)``: groups by descending size dealt out in a snake, never split."""
    groups = df.groupBy(group).agg(F.count("*").alias("rows"))
    ranked = _ranked(groups, F.col("rows"), F.md5(F.col(group).cast("string")))
    lap, seat = F.floor(F.col("rank") / k), F.pmod(F.col("rank"), F.lit(k))
    fold = F.when(F.pmod(lap, F.lit(2)) == 0, seat).otherwise(F.lit(k - 1) - seat)
    return ranked.select(group, "rows", fold.cast("int").alias(out))


def random_folds(df: DataFrame, group: str, k: int, seed: int, out: str = "fold") -> DataFrame:
    """``(group, fold)``: groups in hash order of (id, seed), dealt out in turn."""
    groups = df.select(group).distinct()
    order = F.md5(F.concat(F.col(group).cast("string"), F.lit(f"_{seed}")))
    ranked = _ranked(groups, F.lit(0), order)
    return ranked.select(group, F.pmod("rank", F.lit(k)).cast("int").alias(out))


def fold_lists(groups: DataFrame, group: str, k: int, seeds: Sequence[int], out: str = "folds") -> DataFrame:
    """``(group, folds)``: the folds of ``random_folds`` for many seeds at once, in the order of ``seeds``."""
    each = groups.select(group).distinct().select(group, F.posexplode(F.array(*[F.lit(s) for s in seeds])).alias("_p", "_s"))
    ranked = _ranked(each, F.lit(0), F.md5(F.concat(F.col(group).cast("string"), F.lit("_"), F.col("_s").cast("string"))), ["_p"])
    dealt = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_p", F.pmod("rank", F.lit(k)).cast("int").alias("f")))).alias("_l"))
    return dealt.select(group, F.col("_l.f").alias(out))


def with_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    return df.join(folds.drop("rows"), group)
