"""Sizes of cross-fitting folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold_sizes(df: DataFrame, fold: str, entity: str) -> DataFrame:
    """``(fold, test_n, train_n, test_entities, train_entities)`` from counts per fold."""
    own = df.groupBy(fold, entity).agg(F.count("*").alias("n")).groupBy(fold).agg(
        F.sum("n").alias("test_n"), F.count("*").alias("test_entities")
    )
    total = own.agg(F.struct(F.sum("test_n").alias("n"), F.sum("test_entities").alias("e"))).scalar()
    return own.withColumn("train_n", total["n"] - F.col("test_n")).withColumn(
        "train_entities", total["e"] - F.col("test_entities")
    )
