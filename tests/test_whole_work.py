"""Registered queries ask for the whole published work."""

import pytest

from checks import estimation
from checks.registry import QUERIES


@pytest.mark.parametrize("name, repeats, trees", [("est29_repeated_forest", 20, 300), ("est30_partially_linear_forest", 10, 400)])
def test_forests_of_full_size(spark, monkeypatch, name, repeats, trees):
    asked = []

    def estimates(df, t, y, numerics, factors, cluster, entity, seeds, learner, k=5, **kw):
        asked.append((len(seeds), k, learner.trees, learner.min_leaf, learner.features))
        return spark.createDataFrame([(1, 1, 0.1, 0.2, 0.3, 0.4)], "seed int, n int, theta double, se double, exposure_r2 double, outcome_r2 double")

    monkeypatch.setattr(estimation, "study", lambda spark, sf: None)
    monkeypatch.setattr(estimation.suites, "repeated_tree_estimates", estimates)
    assert QUERIES[name].run(spark, "").count() == 1
    assert asked == [(repeats, 5, trees, 20, 0.7)]
