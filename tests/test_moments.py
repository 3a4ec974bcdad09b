"""The moment store against direct computation, and how often it reads the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crestline.operators import folds, orthogonal as dml, regression as reg
from crestline.operators.gram import cluster_grams
from crestline.operators.moments import MomentStore
from crestline.plans import suites


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 900
    ent = rng.integers(0, 60, n)
    a, b = rng.normal(size=n), rng.normal(size=n) * 40 + 300
    kind = rng.integers(0, 3, n)
    t = 0.5 * a + 0.2 * kind + rng.normal(size=n)
    y = 0.8 * t + 0.01 * b - 0.4 * kind + rng.normal(size=n)
    d = pd.DataFrame({"ent": ent, "cl": ent % 8, "a": a, "b": b, "kind": [f"k{v}" for v in kind], "t": t, "y": y})
    d.loc[::37, "a"] = np.nan
    d.loc[5::41, "y"] = np.nan
    d.loc[7::43, "kind"] = None
    return d


def frame(spark, data):
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), "ent int, cl int, a double, b double, kind string, t double, y double")


def test_repeats_equal_row_wise_cross_fits(spark, data):
    df = frame(spark, data)
    got = {r["seed"]: r for r in suites.repeated_estimates(df, "t", "y", ["a", "b"], ["kind"], "cl", "ent", [1, 2, 3], k=4).collect()}
    for seed in (1, 2, 3):
        rows = df
        for name, s in (("ft", seed), ("fy", seed + suites.OUTCOME_SEED)):
            rows = rows.join(folds.random_folds(df, "ent", 4, s, name), "ent")
        rows = suites.linear_residuals(rows, {"t": "tr"}, ["a", "b"], ["kind"], "ft")
        rows = suites.linear_residuals(rows, {"y": "yr"}, ["a", "b"], ["kind"], "fy")
        want = dml.slope_through_origin(rows, "yr", "tr", "cl", "ent").first()
        use = rows.where("tr IS NOT NULL AND yr IS NOT NULL").toPandas()
        for c in ("n", "entities", "clusters", "theta", "se", "exposure_sd", "std_theta"):
            assert got[seed][c] == pytest.approx(want[c], rel=1e-8)
        for name, res, col in (("exposure_r2", "tr", "t"), ("outcome_r2", "yr", "y")):
            assert got[seed][name] == pytest.approx(1 - (use[res] ** 2).sum() / ((use[col] - use[col].mean()) ** 2).sum(), rel=1e-8)


def test_twenty_repeats_read_the_rows_once(spark, data, tmp_path):
    path = str(tmp_path / "rows")
    frame(spark, data).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = spark.read.parquet(path).withColumn("b", counted(F.col("b")))
    assert suites.repeated_estimates(rows, "t", "y", ["a", "b"], [], "cl", "ent", range(20)).count() == 20
    assert seen.value == len(data)


def test_grams_equal_those_of_the_rows(spark, data):
    df = frame(spark, data)
    store = MomentStore.build(df, ["y", "t", "a", "b"], "ent", "cl", ["kind"])
    for columns, factors in ((["y", "t", "b"], []), (["y", "t", "a"], ["kind"])):
        for within in (True, False):
            one = reg.Regression(store.grams(columns, factors, within))
            two = reg.Regression(cluster_grams(df, columns, "cl", "ent" if within else None, factors))
            a, b = (m.fit("y", columns[1:]) for m in (one, two))
            assert (a.n, a.clusters) == (b.n, b.clusters)
            assert np.allclose(a.beta, b.beta, rtol=1e-8) and np.allclose(a.se, b.se, rtol=1e-8)


def test_entities_across_clusters(spark, data):
    d = data.assign(cl=np.random.default_rng(3).integers(0, 6, len(data)))
    df = frame(spark, d)
    store = MomentStore.build(df, ["y", "t", "b"], "ent", "cl", ["kind"])
    a = reg.Regression(store.grams(["y", "t", "b"], ["kind"])).fit("y", ["t", "b"])
    b = reg.Regression(cluster_grams(df, ["y", "t", "b"], "cl", "ent", ["kind"])).fit("y", ["t", "b"])
    assert np.allclose(a.beta, b.beta, rtol=1e-8) and np.allclose(a.se, b.se, rtol=1e-8)


def test_fold_lists_equal_single_folds(spark, data):
    df = frame(spark, data)
    many = {r["ent"]: r["folds"] for r in folds.fold_lists(df, "ent", 5, [3, 11]).collect()}
    for i, seed in enumerate((3, 11)):
        assert {r["ent"]: r["fold"] for r in folds.random_folds(df, "ent", 5, seed).collect()} == {e: f[i] for e, f in many.items()}
