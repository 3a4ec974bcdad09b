"""Expected values from linear models that never saw the row's own cluster or fold."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from crestline.operators.gram import cluster_grams, unpack
from crestline.operators.regression import pseudo_inverse, totals

MISSING = "Missing"
EDGES = 256


def least_squares(gram: np.ndarray, one: int, y: int, num: np.ndarray, dum: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and minimum-norm slopes from raw moments.

    Only numeric columns are rescaled, so the minimum norm is taken over the dummies.
    """
    x = np.concatenate([num, dum]).astype(int)
    n = gram[one, one]
    mx, my = gram[one, x] / n, gram[one, y] / n
    sxx = gram[np.ix_(x, x)] - n * np.outer(mx, mx)
    sxy = gram[x, y] - n * mx * my
    raw = np.sqrt(np.clip(np.diag(gram)[x], 1e-300, None))
    sd = np.sqrt(np.clip(np.diag(sxx), 0.0, None))
    inv = np.ones(len(x))
    for i in range(len(num)):
        inv[i] = 1.0 / sd[i] if sd[i] > 1e-12 * raw[i] else 0.0
    beta = inv * (pseudo_inverse(sxx * np.outer(inv, inv)) @ (sxy * inv))
    return my - mx @ beta, beta


def left_out_linear(
    df: DataFrame,
    outcome: str,
    numerics: Sequence[str],
    factors: Sequence[str],
    fold: str,
    out: str,
    min_train: int = 100,
) -> DataFrame:
    """Rows with ``out``: the prediction of a linear model fitted on all other folds.

    The training moments of a fold are the total minus its own, so one pass serves all folds.
    Rows with a missing input, and folds with too little training data, get NULL.
    """
    numerics, factors = list(numerics), list(factors)
    work = df.withColumn("_one", F.lit(1.0))
    g = cluster_grams(work, ["_one", outcome, *numerics], fold, None, factors, centre=False)
    t, width, dense = totals(g), g.width, 2 + len(numerics)
    unit = np.array([g.scale[c] for c in g.columns])
    num, dum = np.arange(2, dense), np.arange(dense, width)

    def solve(batches):
        for b in batches:
            rows = []
            for c, n, p, v in zip(b["c"], b["n"], b["pos"], b["val"]):
                if t.n - n < min_train:
                    continue
                a, beta = least_squares(t.gram - unpack(p, v, width), 0, 1, num, dum)
                beta[: len(num)] *= unit[1] / unit[2:dense]
                beta[len(num):] *= unit[1]
                rows.append((c, a * unit[1], list(beta)))
            yield pd.DataFrame(rows, columns=["_fold", "_a", "_b"])

    models = g.table.mapInPandas(solve, "_fold string, _a double, _b array<double>")
    prediction = F.col("_a")
    for i, c in enumerate(numerics):
        prediction = prediction + F.col("_b")[i] * F.col(c).cast("double")
    for f in factors:
        levels = [(i + len(numerics), v) for i, (h, v) in enumerate(g.levels) if h == f]
        code = F.create_map(*[F.lit(x) for i, v in levels for x in (v, i)])
        at = F.try_element_at(code, F.col(f).cast("string"))
        term = F.coalesce(F.get("_b", at), F.lit(0.0))
        prediction = prediction + F.when(F.col(f).isNotNull(), term)
    complete = F.col(outcome).isNotNull() & F.col(fold).isNotNull()
    return (
        df.withColumn("_fold", F.col(fold).cast("string"))
        .join(models, "_fold", "left")
        .withColumn(out, F.when(complete, prediction))
        .drop("_fold", "_a", "_b")
    )


def left_out_medians(df: DataFrame, columns: Sequence[str], fold: str) -> DataFrame:
    """``(fold, column, median)`` over the rows of all other folds, exactly.

    Rows are counted per (column, value bucket, fold).  Totals minus a fold's own counts show
    in which bucket that fold's median lies, and only the rows of those buckets are ranked.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.col(fold).cast("string").alias("f"), F.inline(cells)).where("x IS NOT NULL")
    probs = F.array(*[F.lit(i / EDGES) for i in range(1, EDGES)])
    edges = long.groupBy("column").agg(F.percentile_approx("x", probs).alias("edges"))
    bucket = F.size(F.filter("edges", lambda e: e < F.col("x")))
    placed = long.join(edges, "column").select("column", "f", "x", bucket.alias("b"))
    own = placed.groupBy("column", "f", "b").agg(F.count("*").alias("m"))
    whole = own.groupBy("column", "b").agg(F.sum("m").alias("m"))
    listed = whole.groupBy("column").agg(F.collect_list(F.struct("b", "m")).alias("whole"))
    mine = own.groupBy("column", "f").agg(F.map_from_entries(F.collect_list(F.struct("b", "m"))).alias("mine"))
    folds = df.select(F.col(fold).cast("string").alias("f")).distinct()
    everyone = folds.withColumn("column", F.explode(F.array(*[F.lit(c) for c in columns])))
    rest = (
        everyone.join(listed, "column").join(mine, ["column", "f"], "left")
        .select("column", "f", "mine", F.inline("whole"))
        .withColumn("m", F.col("m") - F.coalesce(F.try_element_at("mine", F.col("b")), F.lit(0)))
        .drop("mine")
    )
    per = Window.partitionBy("column", "f")
    rest = rest.withColumn("n", F.sum("m").over(per)).withColumn(
        "below", F.coalesce(F.sum("m").over(per.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    ranks = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)))
    wanted = (
        rest.where("n > 0")
        .withColumn("rank", F.explode(ranks))
        .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("m")))
        .select("column", "f", "b", "rank", "below")
    )
    inside = (
        wanted.join(placed.withColumnRenamed("f", "g"), ["column", "b"])
        .where("f <> g")
        .groupBy("column", "f", "rank", "below", "x")
        .agg(F.count("*").alias("k"))
        .withColumn("upto", F.sum("k").over(
            Window.partitionBy("column", "f", "rank").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
        ))
        .where(F.col("below") + F.col("upto") > F.col("rank"))
        .groupBy("column", "f", "rank")
        .agg(F.min("x").alias("x"))
    )
    return inside.groupBy("f", "column").agg(F.avg("x").alias("median")).withColumnRenamed("f", "fold")


def left_out_linear_imputed(
    df: DataFrame,
    outcome: str,
    numerics: Sequence[str],
    factors: Sequence[str],
    fold: str,
    out: str,
) -> DataFrame:
    """Like ``left_out_linear`` with training-fold medians for missing numbers and a level for
    missing categories.

    An imputed column is ``observed + missing * median``, linear in the fold's median.  Moments
    of the observed parts and the missing flags are taken once, and each fold combines them with
    its own medians; rows are never repeated per fold.
    """
    numerics, factors = list(numerics), list(factors)
    medians = left_out_medians(df, numerics, fold)
    flags = [f"_na_{c}" for c in numerics]
    zero = [f"_ob_{c}" for c in numerics]
    work = df.select(
        "*", F.lit(1.0).alias("_one"),
        *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(z) for c, z in zip(numerics, zero)],
        *[F.col(c).isNull().cast("double").alias(z) for c, z in zip(numerics, flags)],
        *[F.coalesce(F.col(f).cast("string"), F.lit(MISSING)).alias(f"_lv_{f}") for f in factors],
    )
    g = cluster_grams(work, ["_one", outcome, *zero, *flags], fold, None, [f"_lv_{f}" for f in factors], centre=False)
    t, width, k = totals(g), g.width, len(numerics)
    unit = np.array([g.scale[c] for c in g.columns] + [1.0] * len(g.levels))
    gram_all = t.gram * np.outer(unit, unit)
    wide = medians.groupBy("fold").pivot("column", numerics).agg(F.first("median"))
    seen = df.where(F.col(fold).isNotNull()).select(F.col(fold).cast("string").alias("fold")).distinct()
    table = (
        seen.join(g.table.withColumnRenamed("c", "fold"), "fold", "left")
        .join(wide.select("fold", F.array(*[F.col(f"`{c}`") for c in numerics]).alias("med")), "fold", "left")
    )

    def solve(batches):
        for b in batches:
            rows = []
            for c, p, v, med in zip(b["fold"], b["pos"], b["val"], b["med"]):
                med = np.nan_to_num(np.asarray(med, dtype=float))
                own = unpack(p, v, width) * np.outer(unit, unit) if p is not None else 0.0
                combine = np.zeros((width, 2 + k + len(g_levels)))
                combine[0, 0] = combine[1, 1] = 1.0
                for j in range(k):
                    combine[2 + j, 2 + j] = 1.0
                    combine[2 + k + j, 2 + j] = med[j]
                for j in range(len(g_levels)):
                    combine[2 + 2 * k + j, 2 + k + j] = 1.0
                gram = combine.T @ (gram_all - own) @ combine
                a, beta = least_squares(gram, 0, 1, np.arange(2, 2 + k), np.arange(2 + k, 2 + k + len(g_levels)))
                rows.append((c, a, list(beta), list(med)))
            yield pd.DataFrame(rows, columns=["_fold", "_a", "_b", "_med"])

    g_levels = list(g.levels)
    models = table.select("fold", "pos", "val", "med").mapInPandas(
        solve, "_fold string, _a double, _b array<double>, _med array<double>"
    )
    prediction: Column = F.col("_a")
    for i, c in enumerate(numerics):
        prediction = prediction + F.col("_b")[i] * F.coalesce(F.col(c).cast("double"), F.col("_med")[i])
    for f in factors:
        levels = [(i + k, v) for i, (h, v) in enumerate(g_levels) if h == f"_lv_{f}"]
        code = F.create_map(*[F.lit(x) for i, v in levels for x in (v, i)])
        at = F.try_element_at(code, F.coalesce(F.col(f).cast("string"), F.lit(MISSING)))
        prediction = prediction + F.coalesce(F.get("_b", at), F.lit(0.0))
    return (
        df.withColumn("_fold", F.col(fold).cast("string"))
        .join(models, "_fold", "left")
        .withColumn(out, prediction)
        .drop("_fold", "_a", "_b", "_med")
    )
