"""Cubic B-spline basis as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from crestline.operators.quantiles import quantile_value


def spline_basis(df: DataFrame, column: str, prefix: str = "spline", degree: int = 3) -> tuple[DataFrame, list[str]]:
    """Basis with one inner knot at the exact median and ``degree + 1`` columns (no intercept).

    The three knots are read first; the recursion then unrolls into plain arithmetic on literals
    inside the generated code.
    """
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    knots = {"lo": ends["lo"], "mid": quantile_value(df, column, 0.5), "hi": ends["hi"]}
    names = ["lo"] * (degree + 1) + ["mid"] + ["hi"] * (degree + 1)
    at = {n: F.lit(float(v)) for n, v in knots.items()}
    x = F.col(column).cast("double")

    def basis(i: int, d: int) -> Column | None:
        left, right = names[i], names[i + 1]
        if d == 0:
            if left == right:
                return None
            below = (x <= at[right]) if right == "hi" else (x < at[right])
            return F.when((x >= at[left]) & below, 1.0).otherwise(0.0)
        parts = []
        for j, sign in ((i, 1), (i + 1, -1)):
            inner = basis(j, d - 1)
            a, b = (names[i], names[i + d]) if sign > 0 else (names[i + d + 1], names[i + 1])
            if inner is not None and a != b:
                parts.append((x - at[a]) / (at[b] - at[a]) * inner)
        return None if not parts else sum(parts[1:], parts[0])

    made = {f"{prefix}_{i}": basis(i, degree) for i in range(1, degree + 2)}
    return df.withColumns(made), list(made)
