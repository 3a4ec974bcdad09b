"""Exact quantiles of large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

ACCURACY = 10000
#: Slices of a bracket that are ranked in tasks of their own.
SLICES = 256
#: Parts of a group that meet its bracket in tasks of their own.
SALTS = 64


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """``(by, prob, quantile)`` with linear interpolation between ranks, for groups of any size.

    ``percentile`` would hold every distinct value of a group in one task.  Here a mergeable
    sketch first brackets each wanted rank (its rank error is at most n / ACCURACY); then only
    the values inside a bracket, a few in ten thousand, are counted and ranked, beside plain
    counts of what lies below.  The result is exact; a rank outside its bracket is an error.
    """
    by = list(by)
    clean = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    margin = 3.0 / ACCURACY
    low = F.array(*[F.lit(max(p - margin, 0.0)) for p in probs])
    high = F.array(*[F.lit(min(p + margin, 1.0)) for p in probs])
    spans = F.arrays_zip(
        F.array(*[F.lit(float(p)) for p in probs]).alias("prob"),
        F.percentile_approx("_x", low, ACCURACY).alias("lo"),
        F.percentile_approx("_x", high, ACCURACY).alias("hi"),
    )
    sketch = clean.groupBy(*by).agg(F.count("*").alias("n"), spans.alias("spans"))
    x = F.col("_x")
    if by:
        # a group may hold most rows: equal values become one row with their number, and values are dealt by their hash
        distinct = clean.groupBy(*by, "_x").agg(F.count("*").alias("_m")).withColumn("_salt", F.pmod(F.xxhash64("_x"), F.lit(SALTS)).cast("int"))
        dealt = sketch.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = distinct.join(dealt, [*by, "_salt"]).drop("_salt")
        n, brackets = F.first("n"), [(F.col("spans")[i]["lo"], F.col("spans")[i]["hi"]) for i in range(len(probs))]
    else:
        # one row for the whole table: its few numbers become literals of the second pass
        placed, found = clean.withColumn("_m", F.lit(1).cast("long")), sketch.first()
        spans = found["spans"] or []
        n, brackets = F.lit(found["n"]), [(F.lit(s["lo"]), F.lit(s["hi"])) for s in spans] or [(F.lit(0.0), F.lit(0.0))] * len(probs)
    # one pass counts what lies around every bracket
    number = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("_m"))), F.lit(0).cast("long"))
    around, rows = [n.alias("n"), F.count("*").alias("_rows")], []
    for i, (p, (lo, hi)) in enumerate(zip(probs, brackets)):
        around += [
            number(x < lo).alias(f"below{i}"), number(x.between(lo, hi)).alias(f"within{i}"),
            F.max(F.when(x < lo, x)).alias(f"prev{i}"), F.min(F.when(x > hi, x)).alias(f"next{i}"),
        ]
        rows.append(F.struct(
            F.lit(i).alias("i"), F.lit(float(p)).alias("prob"),
            *[F.col(f"{c}{i}").alias(c) for c in ("below", "within", "prev", "next")],
        ))
    counts = placed.groupBy(*by).agg(*around).where(F.col("_rows") > 0).select(*by, "n", F.inline(F.array(*rows)))
    # only values inside a bracket are ranked, in slices of the bracket side by side: a slice's
    # first rank is the count of the slices before it
    def slice_of(lo, hi):
        return F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * SLICES), F.lit(SLICES - 1))).otherwise(F.lit(0)).cast("int")

    hits = [F.when(x.between(lo, hi), F.struct(F.lit(i).alias("i"), slice_of(lo, hi).alias("_slice"))) for i, (lo, hi) in enumerate(brackets)]
    inside = F.filter(F.array(*hits), lambda i: i.isNotNull())
    values = placed.select(*by, "_x", "_m", F.inline(inside)).groupBy(*by, "i", "_slice", "_x").agg(F.sum("_m").alias("m"))
    earlier = Window.partitionBy(*by, "i").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    first = values.groupBy(*by, "i", "_slice").agg(F.sum("m").alias("_n")).select(*by, "i", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    running = Window.partitionBy(*by, "i", "_slice").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.sum("m").over(running)).join(first, [*by, "i", "_slice"]).withColumn("upto", F.col("_first") + F.col("_upto"))
    pos = (F.col("n") - 1) * F.col("prob")
    wanted = counts.withColumn("r0", F.floor(pos)).withColumn("r1", F.ceil(pos))
    hits = wanted.join(ranked, [*by, "i"])

    def at(rank: str):
        inside = F.min(F.when(F.col("below") + F.col("upto") > F.col(rank), F.col("_x")))
        r = F.first(rank)
        return (
            F.when(r == F.first("below") - 1, F.first("prev"))
            .when(r == F.first("below") + F.first("within"), F.first("next"))
            .when((r >= F.first("below")) & (r < F.first("below") + F.first("within")), inside)
            .otherwise(F.raise_error(F.lit("rank outside its bracket")).cast("double"))
        )

    out = hits.groupBy(*by, "i").agg(
        F.first("prob").alias("prob"), F.first(pos - F.col("r0")).alias("w"),
        at("r0").alias("x0"), at("r1").alias("x1"),
    )
    value_at = F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("w")
    return out.select(*by, "prob", F.when(F.col("w") == 0, F.col("x0")).otherwise(value_at).alias("quantile"))


def quantile_value(df: DataFrame, value: str, prob: float) -> float | None:
    """One exact quantile of the whole table, evaluated now; NULL without values.

    A number in the plan beats a scalar subquery here: it is used in several places, and
    conditions on it fold away or reach the scan.
    """
    row = exact_quantiles(df, value, [prob]).first()
    return None if row is None else row["quantile"]


def describe(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(column, count, mean, sd, min, max, prob, quantile)``, one row per column and quantile."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.inline(cells))
    moments = long.groupBy("column").agg(
        F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    return moments.join(exact_quantiles(long, "x", probs, ["column"]), "column")
