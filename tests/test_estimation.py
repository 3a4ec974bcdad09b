"""Estimators against direct NumPy computation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crestline.functions import tails
from crestline.operators import expectation, folds, orthogonal as dml, regression as reg
from crestline.operators.gram import cluster_grams


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 1200
    ent = rng.integers(0, 90, n)
    q, w = rng.integers(0, 5, n), rng.integers(0, 25, n)
    cl = ent % 9
    x = rng.normal(size=n) + ent * 0.02 + q * 0.3
    c = rng.normal(size=n) * 100 + 500
    y = 0.7 * x - 0.01 * c + ent * 0.05 + q * 0.5 + w * 0.1 + rng.normal(size=n) * (1 + cl * 0.1)
    return pd.DataFrame({"ent": ent, "cl": cl, "q": q, "w": w, "x": x, "c": c, "y": y, "id": np.arange(n)})


def demean(d, cols, effects):
    z = d[cols].astype(float).copy()
    for _ in range(500):
        old = z.to_numpy(copy=True)
        for f in effects:
            z = z - z.groupby(d[f]).transform("mean")
        if np.abs(z.to_numpy() - old).max() < 1e-12:
            break
    return z


def clustered(y, x, g):
    b = np.linalg.solve(x.T @ x, x.T @ y)
    u, k = y - x @ b, x.shape[1]
    ids = np.unique(g)
    meat = sum(np.outer(x[g == c].T @ u[g == c], x[g == c].T @ u[g == c]) for c in ids)
    bread = np.linalg.inv(x.T @ x)
    v = bread @ meat @ bread * len(ids) / (len(ids) - 1) * (len(y) - 1) / (len(y) - k)
    return b, np.sqrt(np.diag(v))


@pytest.mark.parametrize("effects", [["q"], ["q", "w"], []])
def test_fixed_effects(spark, data, effects):
    model = reg.Regression(cluster_grams(spark.createDataFrame(data), ["y", "x", "c"], "cl", "ent", effects))
    fit = model.fit("y", ["x", "c"])
    z = demean(data, ["y", "x", "c"], ["ent", *effects])
    b, se = clustered(z["y"].to_numpy(), z[["x", "c"]].to_numpy(), data.cl.to_numpy())
    assert np.allclose(fit.beta, b, atol=1e-10) and np.allclose(fit.se, se, atol=1e-10)
    assert (fit.n, fit.entities, fit.clusters) == (1200, data.ent.nunique(), 9)


def test_entities_across_clusters(spark, data):
    d = data.assign(cl=np.random.default_rng(2).integers(0, 7, len(data)))
    model = reg.Regression(cluster_grams(spark.createDataFrame(d), ["y", "x"], "cl", "ent", ["q"]))
    assert not model.grams.nested
    z = demean(d, ["y", "x"], ["ent", "q"])
    b, se = clustered(z["y"].to_numpy(), z[["x"]].to_numpy(), d.cl.to_numpy())
    fit = model.fit("y", ["x"])
    assert np.allclose(fit.beta, b) and np.allclose(fit.se, se)


def test_leave_one_out_equals_refit(spark, data):
    model = reg.Regression(cluster_grams(spark.createDataFrame(data), ["y", "x", "c"], "cl", "ent", ["q"]))
    got = model.leave_one_out("y", ["x", "c"]).toPandas().set_index("excluded")
    for c in (0, 4):
        d = data[data.cl != c]
        z = demean(d, ["y", "x", "c"], ["ent", "q"])
        b, se = clustered(z["y"].to_numpy(), z[["x", "c"]].to_numpy(), d.cl.to_numpy())
        row = got.loc[str(c)]
        assert row.coef == pytest.approx(b[0], abs=1e-10) and row.se == pytest.approx(se[0], abs=1e-10)
        assert row.n == len(d)


def test_bootstrap_equals_refits(spark, data):
    model = reg.Regression(cluster_grams(spark.createDataFrame(data), ["y", "x", "c"], "cl", "ent", ["q"]))
    found, t_star = model.wild_bootstrap("y", ["x", "c"], reps=25)
    z = demean(data, ["y", "x", "c"], ["ent", "q"])
    y, x, g = z["y"].to_numpy(), z[["x", "c"]].to_numpy(), data.cl.to_numpy()
    b = np.linalg.lstsq(x[:, 1:], y, rcond=None)[0]
    u = y - x[:, 1:] @ b
    signs = {c: reg.md5_signs(str(c), 25) for c in np.unique(g)}
    want = []
    for r in range(25):
        bb, se = clustered(x[:, 1:] @ b + u * np.array([signs[c][r] for c in g]), x, g)
        want.append(bb[0] / se[0])
    assert np.allclose(t_star, want, atol=1e-9)
    assert 0 < found["p_value"] <= 1


def test_absorb_has_no_group_means(spark, data):
    rows = reg.absorb(spark.createDataFrame(data), ["x"], "cl", "ent", ["q", "w"]).toPandas()
    z = demean(data, ["x"], ["ent", "q", "w"])
    merged = rows.set_index("id")["x_abs"].sort_index()
    assert np.allclose(merged.to_numpy(), z["x"].to_numpy(), atol=1e-8)
    for f in ("ent", "q", "w"):
        assert rows.groupby(f)["x_abs"].mean().abs().max() < 1e-8


def test_wald_and_classical(spark, data):
    d = data.assign(one=1.0)
    model = reg.Regression(cluster_grams(spark.createDataFrame(d), ["y", "x", "c", "one"], "cl"))
    fit = model.classical("y", ["x", "c", "one"])
    x, y = d[["x", "c", "one"]].to_numpy(), d["y"].to_numpy()
    b = np.linalg.solve(x.T @ x, x.T @ y)
    s2 = ((y - x @ b) ** 2).sum() / (len(y) - 3)
    assert np.allclose(fit.beta, b) and np.allclose(fit.se, np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * s2))
    robust = model.fit("y", ["x", "c", "one"])
    stat = reg.wald(robust, ["x", "c"])
    v = robust.cov[:2, :2]
    assert stat["stat"] == pytest.approx(robust.beta[:2] @ np.linalg.inv(v) @ robust.beta[:2])


def test_expectations_never_see_the_cluster(spark, data):
    d = data.assign(c=np.where(data.id % 11 == 0, np.nan, data.c))
    df = spark.createDataFrame(d).withColumn("c", F.when(~F.isnan("c"), F.col("c")))
    plain = expectation.left_out_linear(spark.createDataFrame(data), "y", ["x", "c"], ["q"], "cl", "e").toPandas().set_index("id")["e"]
    filled = expectation.left_out_linear_imputed(df, "y", ["x", "c"], ["q"], "cl", "e").toPandas().set_index("id")["e"]
    for source, got, impute in ((data, plain, False), (d, filled, True)):
        for k in (0, 5):
            tr, te = source[source.cl != k].copy(), source[source.cl == k].copy()
            if impute:
                m = tr["c"].median()
                tr["c"], te["c"] = tr["c"].fillna(m), te["c"].fillna(m)
            design = lambda t: np.column_stack([np.ones(len(t)), t["x"], t["c"], pd.get_dummies(t["q"], dtype=float)])
            b = np.linalg.lstsq(design(tr), tr["y"].to_numpy(), rcond=None)[0]
            assert np.allclose(got.loc[te["id"]].to_numpy(), design(te) @ b, atol=1e-7)


def test_left_out_medians(spark, data):
    out = expectation.left_out_medians(spark.createDataFrame(data), ["x", "c"], "cl").collect()
    assert len(out) == 18
    for r in out:
        assert r["median"] == pytest.approx(data.loc[data.cl != int(r["fold"]), r["column"]].median(), abs=1e-12)


def test_folds_keep_groups_whole_and_balanced(spark, data):
    got = folds.balanced_folds(spark.createDataFrame(data), "ent", 5).toPandas()
    assert got["ent"].is_unique and set(got["fold"]) == {0, 1, 2, 3, 4}
    sizes = got.groupby("fold")["rows"].sum()
    assert sizes.max() - sizes.min() <= 0.1 * sizes.mean()


def test_orthogonal_slope_ignores_order(spark, data):
    a = dml.slope_through_origin(spark.createDataFrame(data), "y", "x", "cl", "ent").first()
    b = dml.slope_through_origin(spark.createDataFrame(data.sample(frac=1, random_state=3)), "y", "x", "cl", "ent").first()
    beta, se = clustered(data.y.to_numpy(), data[["x"]].to_numpy(), data.cl.to_numpy())
    assert a["theta"] == pytest.approx(beta[0]) and a["se"] == pytest.approx(se[0]) and b["theta"] == pytest.approx(a["theta"])
    assert a["p_value"] == pytest.approx(tails.normal_two_sided(a["stat"]))



def test_tails():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert tails.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_upper(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.t_critical(0.05, 10) == pytest.approx(2.2281388519649385)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)


def test_robustness_values(spark):
    # published closed forms: f = |t| / sqrt(dof), RV = (sqrt(f^4 + 4 f^2) - f^2) / 2
    df = spark.createDataFrame([(4.18445, 783.0)], "stat double, dof double")
    row = dml.robustness(dml.robustness(df, 1.0, 1.0), 1.0, 0.05, prefix="rva").first()
    assert row["rv"] == pytest.approx(0.13878, abs=1e-4) and row["rva"] == pytest.approx(0.07626, abs=1e-4)


def test_left_out_fits_of_many_clusters(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 60_000
    d = pd.DataFrame({"cl": np.arange(n) % 20_000, "x": rng.normal(size=n), "c": rng.normal(size=n)})
    d["y"] = 0.4 * d.x - 0.2 * d.c + rng.normal(size=n)
    d["ent"] = d.cl * 2 + rng.integers(0, 2, n)
    df = spark.createDataFrame(d)
    found = reg.Regression(cluster_grams(df, ["y", "x", "c"], "cl", "ent")).leave_one_out("y", ["x", "c"])
    got = found.where("excluded IN ('7', '19999')").collect()
    assert found.count() == 20_000
    for r in got:
        rest = d[d.cl != int(r["excluded"])]
        z = demean(rest, ["y", "x", "c"], ["ent"])
        b, se = clustered_fast(z["y"].to_numpy(), z[["x", "c"]].to_numpy(), rest.cl.to_numpy())
        assert r["coef"] == pytest.approx(b[0], abs=1e-10) and r["se"] == pytest.approx(se[0], rel=1e-8)


def clustered_fast(y, x, g):
    b = np.linalg.solve(x.T @ x, x.T @ y)
    scores = pd.DataFrame(x * (y - x @ b)[:, None]).groupby(g).sum().to_numpy()
    bread, m = np.linalg.inv(x.T @ x), len(scores)
    v = bread @ (scores.T @ scores) @ bread * m / (m - 1) * (len(y) - 1) / (len(y) - x.shape[1])
    return b, np.sqrt(np.diag(v))


def test_wide_left_out_fits_equal_narrow_ones(spark, data, monkeypatch):
    model = reg.Regression(cluster_grams(spark.createDataFrame(data), ["y", "x", "c"], "cl", "ent", ["q"]))
    narrow = {r["excluded"]: (r["n"], r["coef"], r["se"]) for r in model.leave_one_out("y", ["x", "c"]).collect()}
    monkeypatch.setattr(reg, "SQUARES", 1)
    monkeypatch.setattr(reg, "MODELS", 4)
    wide = {r["excluded"]: (r["n"], r["coef"], r["se"]) for r in model.leave_one_out("y", ["x", "c"]).collect()}
    assert wide.keys() == narrow.keys() and all(np.allclose(wide[c], narrow[c], rtol=1e-8) for c in narrow)
