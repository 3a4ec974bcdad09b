"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crestline.llm.staging import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest id it is linked to directly or through others.

    Only nodes with a link to another appear.  Alternates two steps over the links until they
    rest: every neighbour above a node is hung on the smallest id around it (large star), then
    every node's smaller neighbours are hung on the smallest of them (small star).  Each step
    halves long chains; minima are combining aggregates, joins on busy nodes can be split by AQE,
    and every round is a written table.  Links pack to a small part of their size in memory, so
    the sizes of these files must not make a join broadcast them.
    """
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = staged(pairs, "links")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        pairs = both.where("v > u").hint("merge").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        hung = pairs.hint("merge").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = staged(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
