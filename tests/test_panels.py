"""Boundaries of episodes, sessions, joins and quantiles."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from crestline.operators import aggregates as agg, joins
from crestline.operators.episodes import assign_sessions, gap_sessions, spaced_episodes
from crestline.operators.quantiles import exact_quantiles
from crestline.operators.windows import rolling_mean, trailing_median, zscore
from crestline.plans import panels

DAY0 = dt.date(2021, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def frame(spark, days, key="a"):
    return spark.createDataFrame([(key, day(n)) for n in days], "k string, d date")


def kept(spark, days):
    rows = spaced_episodes(frame(spark, days), ["k"], "d", 42).orderBy("d").collect()
    return [(r["d"] - DAY0).days for r in rows]


def test_min_gap_boundaries(spark):
    assert kept(spark, [0, 41]) == [0]
    assert kept(spark, [0, 42]) == [0, 42]
    assert kept(spark, [0, 30, 42, 80]) == [0, 42]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(0, 300), min_size=1, max_size=30))
def test_min_gap_is_greedy_and_maximal(spark, days):
    want, last = [], None
    for n in sorted(days):
        if last is None or n - last >= 42:
            want.append(n)
            last = n
    assert kept(spark, days) == want


def test_session_boundaries(spark):
    gap = 21 * 86400
    assert gap_sessions(frame(spark, [0, 20]), ["k"], "d", gap).count() == 1
    assert gap_sessions(frame(spark, [0, 21]), ["k"], "d", gap).count() == 1
    assert gap_sessions(frame(spark, [0, 22]), ["k"], "d", gap).count() == 2


def test_sessions_match_row_by_row(spark):
    rng = random.Random(3)
    rows = [("u%d" % rng.randint(0, 3), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 20000))) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp")
    got = {(r["k"], r["t"]): r["session_no"] for r in assign_sessions(df, ["k"], "t", 300).collect()}
    for k in {r[0] for r in rows}:
        last, no = None, 0
        for t in sorted(t for kk, t in rows if kk == k):
            if last is None or (t - last).total_seconds() > 300:
                no += 1
            assert got[(k, t)] == no
            last = t


def test_windows_need_enough_observations(spark):
    df = spark.createDataFrame([("a", day(i), None if i == 2 else float(i)) for i in range(20)], "k string, d date, x double")
    out = df.withColumn("m", rolling_mean(["k"], "d", "x", 7, 4)).withColumn("b", trailing_median(["k"], "d", "x", 28, 14))
    rows = out.orderBy("d").collect()
    assert [r["m"] is None for r in rows[:5]] == [True, True, True, True, False]
    assert rows[14]["b"] is None and rows[15]["b"] == 7.5  # of 0, 1, 3 .. 14


def test_empty_groups_give_null(spark):
    df = spark.createDataFrame([("a", None, -4), ("b", 2.0, -4)], "k string, x double, event_week int")
    got = df.groupBy("k").agg(
        F.sum("x").alias("s"), agg.sd_in_weeks("x", [-4]).alias("sd"), agg.slope_in_weeks("x", [-4]).alias("slope"),
        agg.mode_in_weeks("k", [5]).alias("mode")).orderBy("k").collect()
    assert tuple(got[0])[1:] == (None, None, None, "Unknown")
    assert tuple(got[1])[1:] == (2.0, None, None, "Unknown")


def test_band_edges_and_unmatched(spark):
    events = spark.createDataFrame([("s", day(0)), ("s", day(100))], "state string, e date")
    rows = spark.createDataFrame([("s", 1, day(-14)), ("s", 1, day(14)), ("s", 2, day(15)), ("s", 3, day(3))], "state string, h int, d date")
    out = joins.salted_band_aggregate(events, rows, ["state"], ["state", "e"], "e", "d", 14, "h", {"n": F.lit(1)}, "units")
    got = {r["e"]: (r["n"], r["units"]) for r in out.collect()}
    assert got == {day(0): (3, 2), day(100): (None, None)}


@pytest.mark.parametrize("cell", [None, 3600])
def test_asof(spark, cell):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    probes = spark.createDataFrame([("u", t(0), 1), ("u", t(70), 2), ("u", t(500), 3), ("v", t(9), 4)], "k string, at timestamp, i int")
    hist = spark.createDataFrame([("u", t(10), 5.0), ("u", t(70), 7.0), ("u", t(80), None), ("w", t(1), 1.0)], "k string, ts timestamp, v double")
    out = joins.asof_last(probes, hist, ["k"], "at", "ts", "v", "last", cell_seconds=cell)
    assert {r["i"]: r["last"] for r in out.collect()} == {1: None, 2: 7.0, 3: 7.0, 4: None}


def test_first_rise(spark):
    events = spark.createDataFrame([("a", day(0), 10.0), ("b", day(0), 10.0), ("c", day(0), 10.0), ("d", day(0), 10.0)], "k string, e date, base double")
    panel = spark.createDataFrame(
        [("a", day(0), 10.0), ("a", day(21), 15.0), ("b", day(5), 11.0), ("b", day(22), 30.0), ("c", day(40), 90.0), ("d", day(1), 15.0)],
        "k string, p date, v double")
    out = joins.first_rise_after(events, panel, ["k"], ["k"], "e", "p", "v", "base", 21, 5.0)
    assert {r["k"]: (r["detected"], r["latency_days"]) for r in out.collect()} == {"a": (1, 21), "b": (0, 22), "d": (1, 1)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    sets = {"hot": np.round(rng.normal(size=20000), 2), "two": np.array([1.0, 4.0]), "one": np.array([3.0]), "tied": np.array([2.0] * 50 + [9.0])}
    rows = pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in sets.items()])
    out = exact_quantiles(spark.createDataFrame(rows), "x", [0.0, 0.25, 0.5, 0.99, 1.0], ["k"]).collect()
    assert len(out) == 20
    for r in out:
        assert r["quantile"] == pytest.approx(np.quantile(sets[r["k"]], r["prob"]), abs=1e-12)


def test_zscore_of_constant_is_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [r["x_z"] for r in zscore(df, ["x"]).collect()] == [0.0, 0.0]


def test_persistence_edge(spark):
    weeks = [(1, "s", day(7 * k), 10.0, v, 5.0) for k, v in [(-4, 60.0), (-3, 60.0), (-2, 60.0), (-1, 60.0), (1, 40.0), (2, 100.0)]]
    weeks += [(2, "s", day(7 * k), 10.0, v, 5.0) for k, v in [(-4, 60.0), (-3, 60.0), (-2, 60.0), (-1, 60.0), (1, 40.0), (2, 101.0)]]
    panel = spark.createDataFrame(weeks, "hospital_id int, state string, week date, admissions double, staffed_beds double, covid_census double")
    panel = panel.withColumns({c: F.lit(1.0) for c in ("occupied_beds", "icu_beds", "icu_occupied")})
    eps = spark.createDataFrame([(1, "s", day(0)), (2, "s", day(0))], "hospital_id int, state string, signal_week date")
    got = {r["hospital_id"]: r["persistent_capacity_ok"] for r in panels.quality_audit(eps, panel).collect()}
    assert got == {1: True, 2: False}


def test_coverage_at_the_limit(spark):
    eps = spark.createDataFrame([("a", "s", 1, day(0))], "area_id string, state string, area_episode_no int, signal_date date")
    weeks = spark.createDataFrame([("a", "s", day(14), 3.0, 0.8, 1000.0)], "area_id string, state string, week_end date, deaths double, population_coverage double, population double")
    row = panels.area_mortality(eps, weeks).first()
    assert row["deaths_14_42_per100k"] == pytest.approx(300.0) and row["weeks_21_49"] == 0


def test_episode_features_share_one_exchange_per_side(spark):
    rows = [(h, "s", day(7 * w), float(5 + (w % 9) * h), 60.0, 30.0, 5.0, 9.0, 4.0, "a") for h in range(4) for w in range(40)]
    panel = spark.createDataFrame(
        rows, "hospital_id int, state string, week date, admissions double, staffed_beds double, occupied_beds double, "
              "covid_census double, icu_beds double, icu_occupied double, subtype string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = panels.target_trial(panels.hospital_surges(panel), panels.with_ratios(panel))
        plan = out._jdf.queryExecution().executedPlan().toString()
        # window, episode fold, event-window join and per-episode aggregate need one layout by hospital
        assert plan.count("Exchange hashpartitioning(hospital_id") == 2 and plan.count("Exchange") == 2
        assert out.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_quantile_of_nothing_is_none(spark):
    from crestline.operators.quantiles import quantile_value

    empty = spark.createDataFrame([(None,)], "x double")
    assert quantile_value(empty, "x", 0.5) is None


def test_busy_key_keeps_every_row(spark):
    """A third of all rows in one key: sessions and as-of values are whole."""
    rng = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 400000)), float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double").dropDuplicates(["k", "t"])
    n = df.count()
    assert gap_sessions(df, ["k"], "t", 600).agg(F.sum("rows")).first()[0] == n
    probes = df.select("k", F.col("t").alias("at"))
    got = joins.asof_last(probes, df, ["k"], "at", "t", "v", "last", cell_seconds=3600)
    assert got.count() == n
    wrong = got.join(df, (got.k == df.k) & (got["at"] == df.t)).where("last <> v").count()
    assert wrong == 0
