"""Bounded samples by hash, without bringing more than about twice the bound together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def smallest_hashes(rows: DataFrame, key: str, limit: int, per: Column | None = None) -> DataFrame:
    """At most ``limit`` rows of each value of ``per`` (few values), those of the smallest hash of ``key``.

    Counts set a hash bound that about twice ``limit`` rows of each value stay under, so ranking
    sees a number of rows that does not depend on the table.
    """
    marked = rows.withColumn("_per", F.lit(0) if per is None else per).withColumn("_h", F.xxhash64(F.col(key).cast("string")))
    counts = {r["_per"]: r["count"] for r in marked.groupBy("_per").count().collect()}
    bound = F.lit(None).cast("long")
    for value, n in counts.items():
        top = (1 << 63) - 1 if n <= 2 * limit else int(((1 << 64) * (2 * limit)) // n) - (1 << 63)
        bound = F.when(F.col("_per").eqNullSafe(F.lit(value)), F.lit(top)).otherwise(bound)
    order = Window.partitionBy("_per").orderBy("_h", *[c for c in rows.columns])
    some = marked.where(F.col("_h") <= bound).withColumn("_n", F.row_number().over(order))
    return some.where(F.col("_n") <= limit).drop("_per", "_h", "_n")
