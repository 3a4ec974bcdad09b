"""Whole-table numbering, as-of over shared times, gates, sliced quantiles, joint medians and bootstrap of averages."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crestline.operators import matching, regression as reg
from crestline.operators.joins import asof_last
from crestline.operators.quantiles import exact_quantiles
from crestline.operators.windows import numbered
from crestline.plans import suites
from crestline.sources import quality, sinks


def test_numbered_is_row_number(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, 2, 5, None]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = [r["b"] for r in numbered(df, "place", F.asc_nulls_last("a"), F.desc("b")).orderBy("place").collect()]
    assert got == [b for a, b in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))]
    assert numbered(df.limit(0), "place", F.asc("b")).count() == 0


def test_asof_over_shared_times(spark):
    rnd = random.Random(2)
    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    probes = [("s" if i % 3 else "t", day(rnd.randint(0, 90)), i) for i in range(300)] + [(None, day(3), 900), ("s", None, 901)]
    history = [(s, day(k), float(k) if k % 4 else None) for s in ("s", "t") for k in range(5, 90, 3)]
    p, h = spark.createDataFrame(probes, "k string, day date, id int"), spark.createDataFrame(history, "k string, d date, v double")
    joined = asof_last(p, h, ["k"], "day", "d", "v", "last", shared_times=True)
    got = {r["id"]: r["last"] for r in joined.collect()}
    for k, d, i in probes:
        seen = [v for s, e, v in history if s == k and d is not None and e <= d and v is not None]
        assert got[i] == (seen[-1] if seen else None)
    windows = [line for line in joined._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("id#" in line for line in windows)


def test_gates_raise(spark):
    df = spark.range(10).withColumn("v", F.lit(2.0))
    quality.assert_total(df, "v", 19.0, 21.0).collect()
    with pytest.raises(Exception):
        quality.assert_total(df, "v", 30.0, 40.0).collect()


def test_iteration_raises_without_convergence(spark):
    rng = np.random.default_rng(4)
    rows = pd.DataFrame({"a": rng.integers(0, 8, 120), "b": rng.integers(0, 9, 120), "x": rng.normal(size=120)})
    df = spark.createDataFrame(rows)
    with pytest.raises(RuntimeError):
        reg.absorb_iterative(df, ["x"], ["a", "b"], tol=1e-12, rounds=1)
    got = reg.absorb_iterative(df, ["x"], ["a", "b"], tol=1e-9).toPandas()
    for key in ("a", "b"):
        assert got.groupby(key)["x_abs"].mean().abs().max() < 1e-7


def test_quantiles_with_ties_and_one_large_group(spark):
    rng = np.random.default_rng(6)
    big = np.concatenate([np.repeat(3.25, 4000), rng.normal(3, 1, 9000), np.repeat([-50.0, 60.0], 40)])
    frame = pd.DataFrame({"g": ["big"] * len(big) + ["one", "two", "two"], "x": np.concatenate([big, [7.0, 1.0, 2.0]])})
    got = exact_quantiles(spark.createDataFrame(frame), "x", [0.0, 0.1, 0.5, 0.731, 1.0], ["g"]).collect()
    for r in got:
        assert r["quantile"] == pytest.approx(np.quantile(frame[frame.g == r["g"]]["x"], r["prob"]))


def test_joint_median_of_controls(spark):
    rng = np.random.default_rng(8)
    start = dt.date(2021, 1, 3)
    for n in (8, 9, 30, 31):
        feats = pd.DataFrame({"s": "s", "start": start, "h": range(n), "pre_weeks": 4, "a": rng.normal(size=n), "m": np.round(rng.normal(size=n), 1)})
        feats.loc[feats.index[2:5], "m"] = np.nan
        feats.loc[5:6, "m"] = feats["m"][7]
        own = feats[feats.h == 0]
        cohorts = spark.createDataFrame([(0, "s", start, 0)], "cohort long, s string, start date, h long")
        table = spark.createDataFrame(feats).replace(float("nan"), None, "m")
        out = matching.nearest_controls(cohorts, table, cohorts, "s", "h", "start", "cohort", ["a", "m"], needed=["a"]).toPandas()
        filled = feats[["a", "m"]].fillna(feats[["a", "m"]].median())
        pool = filled[feats.h != 0]
        d = np.sqrt((((pool - filled.loc[own.index[0]]) / filled.std(ddof=1)) ** 2).sum(axis=1))
        want = d.sort_values().head(3)
        assert sorted(out["control"]) == sorted(feats.h[want.index])
        assert np.allclose(sorted(out["distance"]), sorted(want))


def test_average_bootstrap_and_joint_test_of_three(spark):
    rng = np.random.default_rng(9)
    rows = []
    for e in range(60):
        x = rng.normal()
        for w in range(-4, 7):
            rows.append((f"s{e % 9}", e, w, x, 0.3 * x * (w >= 2) + rng.normal() * 0.5 + e))
    frame = pd.DataFrame(rows, columns=["state", "unit", "event_week", "x", "y"])
    study = suites.event_study(spark.createDataFrame(frame), "y", "x", "unit", "state", ["event_week"])
    dummies = pd.concat([frame["x"] * (frame.event_week == k) for k in range(-4, 7) if k != -1], axis=1).to_numpy(float)
    z = np.column_stack([dummies, frame.y])
    for key in ("unit", "event_week"):  # balanced: one pass each absorbs both
        z = z - pd.DataFrame(z).groupby(frame[key].to_numpy()).transform("mean").to_numpy()
    b = np.linalg.solve(z[:, :-1].T @ z[:, :-1], z[:, :-1].T @ z[:, -1])
    found = {r["event_week"]: r["coef"] for r in study.coefficients().collect()}
    weeks = [k for k in range(-4, 7) if k != -1]
    assert np.allclose([found[k] for k in weeks], b)
    one, three = study.joint([2]), study.joint([2, 3, 4])
    fit = {r["event_week"]: r for r in study.coefficients().collect()}
    assert one["stat"] == pytest.approx((fit[2]["coef"] / fit[2]["se"]) ** 2)
    assert three["stat"] > one["stat"] and 0 <= three["p_value"] < 0.05
    boot, _ = study.average_bootstrap(reps=99)
    assert boot["observed_effect"] == pytest.approx(np.mean([found[k] for k in suites.POST_WEEKS]))
    assert boot["reps_valid"] == 99 and boot["p_value"] <= 0.1


def test_nested_json(spark):
    one = spark.createDataFrame([(3, None)], "n int, note string")
    many = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v int")
    got = sinks.nested_json(spark, {"panel": one}, {"rows": many}).first()[0]
    assert got == '{"panel":{"n":3,"note":null},"rows":[{"k":"a","v":1},{"k":"b","v":2}]}'


def test_a_group_of_most_rows_meets_its_bracket_in_many_tasks(spark):
    rows = spark.range(3000).select(F.lit("all").alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).cast("double").alias("x"))
    out = exact_quantiles(rows, "x", [0.25, 0.9], ["g"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert any("_salt" in line for line in joins)  # by the group alone one task would get all its rows
    got = {r["prob"]: r["quantile"] for r in out.collect()}
    values = [r["x"] for r in rows.collect()]
    assert np.allclose([got[0.25], got[0.9]], np.quantile(values, [0.25, 0.9]))
