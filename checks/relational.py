"""Joins, aggregates, windows, sorts and set operations over the provided tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window, functions as F

from checks.cleaning import DEPLOY_SQL, deployments
from checks.registry import query
from checks.standins import (
    episodes, excess_week, facility_ratios, facility_week, orders_by_nation, policy_day, region_day, sql, table,
)
from crestline.functions.places import STATE_OF_FIPS
from crestline.operators import aggregates as agg
from crestline.operators.episodes import gap_sessions, spaced_episodes
from crestline.operators.joins import asof_last, first_rise_after, salted_band_aggregate, week_scaffold, window_join
from crestline.operators.quantiles import describe, exact_quantiles
from crestline.operators.windows import demean, numbered, relative_change, rolling_mean, trailing_median
from crestline.plans.panels import HOSPITAL_WEEK, episode_weeks, event_time_panel, signal_columns

PRE, POST = (-4, -3, -2), (2, 3, 4)
EP = ["hospital_id", "state", "signal_week"]

# --- joins ------------------------------------------------------------------------------------


@query("join1_left_equi", "state:s date:d response_index:f covid_admissions:f", sql("nation_day rday", """
SELECT r.state, r.date, n.response_index, r.covid_admissions FROM rday r LEFT JOIN nation_day n ON r.state = n.state AND r.date = n.date"""))
def _(spark, sf):
    return region_day(spark, sf).join(policy_day(spark, sf), ["state", "date"], "left")


@query("join2_back_to_rows", "hospital_id:i signal_week:d state_mean:f", sql("epi", """
SELECT hospital_id, signal_week, m AS state_mean FROM epi JOIN (SELECT state, avg(signal_admissions) AS m FROM epi GROUP BY 1) USING (state)"""))
def _(spark, sf):
    e = episodes(spark, sf)
    means = e.groupBy("state").agg(F.avg("signal_admissions").alias("state_mean"))
    predicted = e.join(means, "state").select("hospital_id", "signal_week", "state_mean")
    return e.join(predicted, ["hospital_id", "signal_week"], "left")


@query("join3_event_window", "hospital_id:i signal_week:d week:d event_week:i occupancy:f", sql("ew", """
SELECT hospital_id, signal_week, week, event_week, occupancy FROM ew WHERE event_week <= 4"""))
def _(spark, sf):
    return episode_weeks(episodes(spark, sf).select(*EP), facility_ratios(spark, sf))


@query("join3_event_window_spread", "hospital_id:i signal_week:d week:d", sql("ew", "SELECT hospital_id, signal_week, week FROM ew WHERE event_week <= 4"))
def _(spark, sf):
    panel = facility_week(spark, sf).drop("state")
    return window_join(episodes(spark, sf).select(*EP), panel, ["hospital_id"], "signal_week", "week", -28, 28, spread=True)


@query("join4_band_aggregate", "state:s week:d n:i hospitals:i level:f", sql("fw epi", """
SELECT c.state, c.week, count(e.hospital_id) AS n, count(DISTINCT e.hospital_id) AS hospitals, sum(e.signal_admissions) AS level
FROM (SELECT DISTINCT state, week FROM fw) c LEFT JOIN epi e ON e.state = c.state AND e.signal_week BETWEEN c.week - 14 AND c.week + 14 GROUP BY 1, 2"""))
def _(spark, sf):
    probes = facility_week(spark, sf).select("state", "week").distinct()
    rows = episodes(spark, sf).select("state", "hospital_id", "signal_week", "signal_admissions")
    out = salted_band_aggregate(probes, rows, ["state"], ["state", "week"], "week", "signal_week", 14, "hospital_id",
                                {"n": F.lit(1), "level": F.col("signal_admissions")}, "hospitals")
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("hospitals", F.coalesce("hospitals", F.lit(0)))


@query("join5_forward_windows", "hospital_id:i signal_week:d near:f far:f", sql("epi excess", """
SELECT hospital_id, signal_week, sum(excess_deaths) FILTER (week_ending_date BETWEEN signal_week + 7 AND signal_week + 35) AS near,
sum(excess_deaths) FILTER (week_ending_date BETWEEN signal_week + 14 AND signal_week + 42) AS far
FROM epi e LEFT JOIN excess x ON e.state = x.state AND week_ending_date BETWEEN signal_week + 7 AND signal_week + 42 GROUP BY 1, 2"""))
def _(spark, sf):
    e = episodes(spark, sf).select(*EP)
    rows = window_join(e, excess_week(spark, sf), ["state"], "signal_week", "week_ending_date", 7, 42, spread=True)
    days = F.datediff("week_ending_date", "signal_week")
    sums = rows.groupBy(*EP).agg(
        F.sum(F.when(days <= 35, F.col("excess_deaths"))).alias("near"),
        F.sum(F.when(days >= 14, F.col("excess_deaths"))).alias("far"),
    )
    return e.join(sums, EP, "left")


@query("join6_asof", "hospital_id:i signal_week:d index:f", sql("epi nation_day", """
SELECT hospital_id, signal_week, response_index AS index FROM epi e ASOF LEFT JOIN nation_day n ON e.state = n.state AND e.signal_week >= n.date"""))
def _(spark, sf):
    return asof_last(episodes(spark, sf), policy_day(spark, sf), ["state"], "signal_week", "date", "response_index", "index", shared_times=True)


@query("join6_asof_events", "event_id:i last_click:f", """
WITH c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT e.event_id, c.value AS last_click FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def _(spark, sf):
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    probes = e.where("event_type <> 'click'").select("event_id", "user_id", F.col("ts").alias("at"))
    return asof_last(probes, clicks, ["user_id"], "at", "ts", "value", "last_click", cell_seconds=86400)


@query("join7_first_rise", "hospital_id:i signal_week:d baseline:f response_date:d detected:i latency_days:i", sql("epi nation_day", """
SELECT b.hospital_id, b.signal_week, b.index AS baseline, min(n.date) FILTER (n.response_index - b.index >= 5) AS response_date,
CAST(count(*) FILTER (n.response_index - b.index >= 5) > 0 AS INT) AS detected,
coalesce(date_diff('day', b.signal_week, min(n.date) FILTER (n.response_index - b.index >= 5)), 22) AS latency_days
FROM (SELECT e.*, n.response_index AS index FROM epi e ASOF JOIN nation_day n ON e.state = n.state AND e.signal_week >= n.date) b
JOIN nation_day n ON n.state = b.state AND n.date BETWEEN b.signal_week AND b.signal_week + 21 GROUP BY 1, 2, 3"""))
def _(spark, sf):
    policy = policy_day(spark, sf)
    based = asof_last(episodes(spark, sf).select(*EP), policy, ["state"], "signal_week", "date", "response_index", "baseline", shared_times=True)
    return first_rise_after(based, policy, ["state"], EP, "signal_week", "date", "response_index", "baseline", 21, 5.0)


@query("join8_dimension_lookup", "region:s hospitals:i", """
SELECT r_name AS region, count(*) AS hospitals FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def _(spark, sf):
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey"
    ).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("region"))
    # plain equi join: AQE broadcasts the side whose measured size allows it
    return table(spark, sf, "supplier").join(places, "s_nationkey").groupBy("region").agg(F.count("*").alias("hospitals"))


@query("join9_surviving_groups", "state:s hospital_id:i signal_week:d", sql("epi", """
SELECT state, hospital_id, signal_week FROM epi WHERE hospital_id IN (SELECT hospital_id FROM epi GROUP BY 1 HAVING count(*) >= 2)"""))
def _(spark, sf):
    e = episodes(spark, sf)
    kept = agg.group_validity(e, ["hospital_id"], "episode_no").where("size >= 2")
    return e.join(kept, "hospital_id", "left_semi")


@query("join10_never_treated", "hospital_id:i state:s", sql("deploy", """
SELECT s_suppkey AS hospital_id, CAST(s_nationkey AS VARCHAR) AS state FROM supplier WHERE s_suppkey NOT IN (SELECT hospital_id FROM deploy)""", DEPLOY_SQL))
def _(spark, sf):
    master = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("hospital_id"), F.col("s_nationkey").cast("string").alias("state"))
    return master.join(deployments(spark, sf), "hospital_id", "left_anti")


# --- aggregates -------------------------------------------------------------------------------


@query("agg1_group_mean", "state:s week:d n:i mean:f", sql("fw", "SELECT state, week, count(*) AS n, avg(staffed_beds) AS mean FROM fw GROUP BY 1, 2"))
def _(spark, sf):
    return facility_week(spark, sf).groupBy("state", "week").agg(F.count("*").alias("n"), F.avg("staffed_beds").alias("mean"))


@query("agg2_sum_or_null", "segment:s total:f2 none:f2", """
SELECT c_mktsegment AS segment, sum(c_acctbal) AS total, sum(CASE WHEN c_acctbal > 1e9 THEN c_acctbal END) AS none FROM customer GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.sum("c_acctbal").alias("total"), F.sum(F.when(F.col("c_acctbal") > 1e9, F.col("c_acctbal"))).alias("none"))


@query("agg3_window_means", "hospital_id:i signal_week:d pre:f post:f", sql("ew", """
SELECT hospital_id, signal_week, avg(occupancy) FILTER (event_week IN (-4, -3, -2)) AS pre, avg(occupancy) FILTER (event_week IN (2, 3, 4)) AS post
FROM ew GROUP BY 1, 2"""))
def _(spark, sf):
    rows = episode_weeks(episodes(spark, sf).select(*EP), facility_ratios(spark, sf))
    return rows.groupBy(*EP).agg(agg.mean_in_weeks("occupancy", PRE).alias("pre"), agg.mean_in_weeks("occupancy", POST).alias("post"))


WEEK_NAMES = {w: f"w{'m' if w < 0 else 'p'}{abs(w)}" for w in range(-4, 7)}


@query("agg4_pivot_weeks", "hospital_id:i signal_week:d " + " ".join(f"{n}:f" for n in WEEK_NAMES.values()), sql("ew", f"""
SELECT hospital_id, signal_week, {', '.join(f'avg(occupancy) FILTER (event_week = {w}) AS {n}' for w, n in WEEK_NAMES.items())} FROM ew GROUP BY 1, 2"""))
def _(spark, sf):
    rows = event_time_panel(episodes(spark, sf), facility_ratios(spark, sf))
    wide = rows.groupBy(*EP).pivot("event_week", list(WEEK_NAMES)).agg(F.avg("occupancy"))
    return wide.select(*EP, *[F.col(f"`{w}`").alias(n) for w, n in WEEK_NAMES.items()])


@query("agg5_rowwise_mean", "hospital_id:i week:d mean:f", sql("fr", """
SELECT hospital_id, week, CASE WHEN occupancy IS NULL THEN icu_occupancy WHEN icu_occupancy IS NULL THEN occupancy ELSE (occupancy + icu_occupancy) / 2 END AS mean FROM fr"""))
def _(spark, sf):
    both = F.filter(F.array("occupancy", "icu_occupancy"), lambda x: x.isNotNull())
    mean = F.try_divide(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), F.size(both))
    return facility_ratios(spark, sf).withColumn("mean", mean)


@query("agg6_slope", "hospital_id:i signal_week:d slope:f", sql("ew", """
SELECT hospital_id, signal_week, CASE WHEN count(occupancy) FILTER (event_week IN (-4, -3, -2)) >= 2 THEN
regr_slope(occupancy, event_week) FILTER (event_week IN (-4, -3, -2)) END AS slope FROM ew GROUP BY 1, 2"""))
def _(spark, sf):
    rows = episode_weeks(episodes(spark, sf).select(*EP), facility_ratios(spark, sf))
    return rows.groupBy(*EP).agg(agg.slope_in_weeks("occupancy", PRE).alias("slope"))


@query("agg7_two_point_slope", "hospital_id:i signal_week:d slope:f", sql("ew", """
SELECT hospital_id, signal_week, (avg(occupancy) FILTER (event_week = -2) - avg(occupancy) FILTER (event_week = -4)) / 2 AS slope FROM ew GROUP BY 1, 2"""))
def _(spark, sf):
    rows = episode_weeks(episodes(spark, sf).select(*EP), facility_ratios(spark, sf))
    return rows.groupBy(*EP).agg(((agg.mean_in_weeks("occupancy", [-2]) - agg.mean_in_weeks("occupancy", [-4])) / 2).alias("slope"))


@query("agg8_sample_sd", "hospital_id:i signal_week:d sd:f", sql("ew", """
SELECT hospital_id, signal_week, stddev_samp(occupancy) FILTER (event_week IN (-4, -3, -2)) AS sd FROM ew GROUP BY 1, 2"""))
def _(spark, sf):
    rows = episode_weeks(episodes(spark, sf).select(*EP), facility_ratios(spark, sf))
    return rows.groupBy(*EP).agg(agg.sd_in_weeks("occupancy", PRE).alias("sd"))


@query("agg9_median", "state:s median:f", sql("fr", "SELECT state, median(occupancy) AS median FROM fr GROUP BY 1"))
def _(spark, sf):
    return exact_quantiles(facility_ratios(spark, sf), "occupancy", [0.5], ["state"]).withColumnRenamed("quantile", "median")


@query("agg10_mode", "suppkey:i kind:s", """
SELECT suppkey, kind FROM (SELECT l_suppkey AS suppkey, p_type AS kind, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_type) AS r
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE r = 1""")
def _(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    kinds = counts.join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type"), "l_partkey")
    levels = kinds.groupBy(F.col("l_suppkey").alias("suppkey"), "p_type").agg(F.sum("n").alias("n"))
    return levels.groupBy("suppkey").agg(F.min_by("p_type", F.struct(-F.col("n"), F.col("p_type"))).alias("kind"))


@query("agg11_weighted_mean", "state:s mean:f", sql("fr", """
SELECT state, sum(occupancy * covid_census) FILTER (covid_census > 0) / sum(covid_census) FILTER (covid_census > 0 AND occupancy IS NOT NULL) AS mean FROM fr GROUP BY 1"""))
def _(spark, sf):
    return facility_ratios(spark, sf).groupBy("state").agg(agg.weighted_mean("occupancy", "covid_census").alias("mean"))


@query("agg12_weighted_median_date", "state:s day:d", sql("fw", """
SELECT state, min(week) AS day FROM (SELECT state, week, sum(sum(covid_census)) OVER (PARTITION BY state ORDER BY week) AS c,
sum(sum(covid_census)) OVER (PARTITION BY state) AS t FROM fw WHERE covid_census > 0 GROUP BY 1, 2) WHERE c >= t / 2 GROUP BY 1"""))
def _(spark, sf):
    return agg.weighted_median_day(facility_week(spark, sf), ["state"], "week", "covid_census", "day")


@query("agg13_distinct_counts", "hospitals:i states:i weeks:i", sql("fw", """
SELECT count(DISTINCT hospital_id) AS hospitals, count(DISTINCT state) AS states, count(DISTINCT week) AS weeks FROM fw"""))
def _(spark, sf):
    return facility_week(spark, sf).agg(
        F.count_distinct("hospital_id").alias("hospitals"), F.count_distinct("state").alias("states"),
        F.count_distinct("week").alias("weeks"))


@query("agg14_quantiles", "prob:f quantile:f", "\nUNION ALL\n".join(
    f"SELECT {p} AS prob, quantile_cont(l_extendedprice, {p}) AS quantile FROM lineitem" for p in (0.01, 0.25, 0.5, 0.95, 0.99)))
def _(spark, sf):
    return exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.95, 0.99])


@query("agg15_describe", "field:s count:i mean:f sd:f min:f max:f prob:f quantile:f", sql("fr", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS field, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS sd, min({c}) AS min, max({c}) AS max,
    {p} AS prob, quantile_cont({c}, {p}) AS quantile FROM fr""" for c in ("occupancy", "staffed_beds") for p in (0.025, 0.5, 0.975))))
def _(spark, sf):
    return describe(facility_ratios(spark, sf), ["occupancy", "staffed_beds"], [0.025, 0.5, 0.975]).withColumnRenamed("column", "field")


@query("agg16_correlations", "a:s b:s corr:f", sql("fw", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM fw"
    for a in ("admissions", "staffed_beds", "covid_census") for b in ("admissions", "staffed_beds", "covid_census"))))
def _(spark, sf):
    return agg.correlations(facility_week(spark, sf), ["admissions", "staffed_beds", "covid_census"])


@query("agg17_share", "state:s share:f", sql("fr", "SELECT state, avg(CASE WHEN occupancy > 0.5 THEN 1.0 ELSE 0.0 END) AS share FROM fr WHERE occupancy IS NOT NULL GROUP BY 1"))
def _(spark, sf):
    return facility_ratios(spark, sf).groupBy("state").agg(agg.share(F.col("occupancy") > 0.5).alias("share"))


@query("agg20_first_attribute", "custkey:i status:s", """
SELECT o_custkey AS custkey, min_by(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS status FROM orders GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.min_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query("agg21_group_validity", "state:s size:i low:i high:i", sql("epi", "SELECT state, count(*) AS size, min(episode_no) AS low, max(episode_no) AS high FROM epi GROUP BY 1"))
def _(spark, sf):
    return agg.group_validity(episodes(spark, sf), ["state"], "episode_no")


@query("agg22_window_max", "state:s date:d peak:f mean:f", sql("rday", """
SELECT a.state, a.date, max(b.covid_admissions) AS peak, avg(b.hospitals_staffing_shortage) AS mean FROM rday a
LEFT JOIN rday b ON a.state = b.state AND b.date BETWEEN a.date + 1 AND a.date + 28 GROUP BY 1, 2"""))
def _(spark, sf):
    days = region_day(spark, sf)
    ahead = Window.partitionBy("state").orderBy(F.unix_date("date")).rangeBetween(1, 28)
    return days.withColumn("peak", F.max("covid_admissions").over(ahead)).withColumn(
        "mean", F.avg("hospitals_staffing_shortage").over(ahead))


@query("agg23_fit_quality", "n:i r2:f rmse:f", sql("fr", """
SELECT count(*) AS n, 1 - sum((occupancy - icu_occupancy) ** 2) / regr_syy(occupancy, icu_occupancy) AS r2,
sqrt(avg((occupancy - icu_occupancy) ** 2)) AS rmse FROM fr WHERE occupancy IS NOT NULL AND icu_occupancy IS NOT NULL"""))
def _(spark, sf):
    return agg.fit_quality(facility_ratios(spark, sf), "occupancy", "icu_occupancy")


@query("agg25_good_weeks", "hospital_id:i signal_week:d good:i median:f", sql("ew", """
SELECT hospital_id, signal_week, count(*) FILTER (event_week BETWEEN -4 AND -1 AND covid_census > 0) AS good,
CASE WHEN count(*) FILTER (event_week BETWEEN -4 AND -1 AND covid_census > 0) >= 3 THEN median(staffed_beds) FILTER (event_week BETWEEN -4 AND -1 AND covid_census > 0) END AS median
FROM ew GROUP BY 1, 2"""))
def _(spark, sf):
    rows = episode_weeks(episodes(spark, sf).select(*EP), facility_week(spark, sf))
    good = F.col("event_week").between(-4, -1) & (F.col("covid_census") > 0)
    counted = rows.groupBy(*EP).agg(
        F.count_if(good).alias("good"), F.percentile(F.when(good, F.col("staffed_beds")), F.lit(0.5)).alias("_m"))
    return counted.withColumn("median", F.when(F.col("good") >= 3, F.col("_m")))


# --- windows ----------------------------------------------------------------------------------


@query("win1_rolling_mean", "state:s date:d mean7:f", sql("rday", """
SELECT state, date, CASE WHEN count(covid_admissions) OVER w >= 4 THEN avg(covid_admissions) OVER w END AS mean7 FROM rday
WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def _(spark, sf):
    return region_day(spark, sf).withColumn("mean7", rolling_mean(["state"], "date", "covid_admissions", 7, 4))


@query("win2_trailing_median_rows", "state:s date:d median28:f", sql("rday", """
SELECT state, date, CASE WHEN count(covid_admissions) OVER w >= 14 THEN median(covid_admissions) OVER w END AS median28 FROM rday
WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"""))
def _(spark, sf):
    return region_day(spark, sf).withColumn("median28", trailing_median(["state"], "date", "covid_admissions", 28, 14))


@query("win2_trailing_median_days", "hospital_id:i week:d baseline:f", sql("based", "SELECT hospital_id, week, CASE WHEN bn >= 3 THEN bm END AS baseline FROM based"))
def _(spark, sf):
    return signal_columns(facility_week(spark, sf), ["hospital_id"], "week", "admissions", HOSPITAL_WEEK)


@query("win3_relative_change", "hospital_id:i week:d rel_change:f", sql("based", """
SELECT hospital_id, week, CASE WHEN bn >= 3 THEN level / nullif(bm, 0) - 1 END AS rel_change FROM based"""))
def _(spark, sf):
    return signal_columns(facility_week(spark, sf), ["hospital_id"], "week", "admissions", HOSPITAL_WEEK)


@query("win4_greedy_min_gap", "hospital_id:i signal_week:d episode_no:i signal_admissions:f", sql("epi", "SELECT hospital_id, signal_week, episode_no, signal_admissions FROM epi"))
def _(spark, sf):
    return episodes(spark, sf)


@query("win5_gap_sessions", "state:s session_no:i session_start:d session_end:d rows:i", sql("epi", """
SELECT state, session_no, min(signal_week) AS session_start, max(signal_week) AS session_end, count(*) AS rows FROM (
SELECT state, signal_week, sum(o) OVER (PARTITION BY state ORDER BY signal_week, hospital_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (
SELECT *, CASE WHEN date_diff('day', lag(signal_week) OVER (PARTITION BY state ORDER BY signal_week, hospital_id), signal_week) <= 21 THEN 0 ELSE 1 END AS o FROM epi)) GROUP BY 1, 2"""))
def _(spark, sf):
    return gap_sessions(episodes(spark, sf), ["state"], "signal_week", 21 * 86400)


@query("win5_gap_sessions_events", "user_id:i session_no:i session_start:t session_end:t rows:i", """
SELECT user_id, session_no, to_timestamp(min(t)) AS session_start, to_timestamp(max(t)) AS session_end, count(*) AS rows FROM (
SELECT user_id, t, sum(o) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM (
SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 1800 THEN 0 ELSE 1 END AS o FROM (
SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events))) GROUP BY 1, 2""")
def _(spark, sf):
    return gap_sessions(table(spark, sf, "events"), ["user_id"], "ts", 1800)


@query("win6_group_demean", "hospital_id:i week:d within:f", sql("fw", """
SELECT hospital_id, week, staffed_beds - avg(staffed_beds) OVER (PARTITION BY state) AS within FROM fw"""))
def _(spark, sf):
    return demean(facility_week(spark, sf), ["state"], ["staffed_beds"]).withColumnRenamed("staffed_beds_within", "within")


@query("win7_numbering", "hospital_id:i signal_week:d number:i", sql("epi", """
SELECT hospital_id, signal_week, row_number() OVER (PARTITION BY hospital_id ORDER BY signal_week) AS number FROM epi"""))
def _(spark, sf):
    return episodes(spark, sf).withColumn("number", F.row_number().over(Window.partitionBy("hospital_id").orderBy("signal_week")))


@query("win9_top_and_runner_up", "state:s best:f second:f gap:f", sql("epi", """
SELECT state, max(s) FILTER (k = 1) AS best, max(s) FILTER (k = 2) AS second, max(s) FILTER (k = 1) - max(s) FILTER (k = 2) AS gap FROM (
SELECT state, signal_rel_change AS s, row_number() OVER (PARTITION BY state ORDER BY signal_rel_change DESC, hospital_id, signal_week) AS k FROM epi) WHERE k <= 2 GROUP BY 1"""))
def _(spark, sf):
    order = Window.partitionBy("state").orderBy(F.desc("signal_rel_change"), "hospital_id", "signal_week")
    top = episodes(spark, sf).withColumn("k", F.row_number().over(order)).where("k <= 2")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("signal_rel_change")))
    return top.groupBy("state").agg(at(1).alias("best"), at(2).alias("second")).withColumn("gap", F.col("best") - F.col("second"))


@query("win10_top_k", "state:s hospital_id:i signal_week:d k:i", sql("epi", """
SELECT * FROM (SELECT state, hospital_id, signal_week, row_number() OVER (PARTITION BY state ORDER BY signal_admissions DESC, hospital_id, signal_week) AS k FROM epi) WHERE k <= 3"""))
def _(spark, sf):
    order = Window.partitionBy("state").orderBy(F.desc("signal_admissions"), "hospital_id", "signal_week")
    return episodes(spark, sf).withColumn("k", F.row_number().over(order)).where("k <= 3")


@query("win11_cumulative_weight", "state:s date:d upto:f", sql("rday", """
SELECT state, date, sum(covid_admissions) OVER (PARTITION BY state ORDER BY date) AS upto FROM rday"""))
def _(spark, sf):
    w = Window.partitionBy("state").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return region_day(spark, sf).withColumn("upto", F.sum("covid_admissions").over(w))


# --- sorts and sets ---------------------------------------------------------------------------


@query("srt1_multi_key_sort", "place:i state:s week:d", sql("fw", """
SELECT row_number() OVER (ORDER BY t DESC NULLS LAST, state, week) AS place, state, week FROM (SELECT state, week, sum(staffed_beds) AS t FROM fw GROUP BY 1, 2)"""))
def _(spark, sf):
    rows = facility_week(spark, sf).groupBy("state", "week").agg(F.sum("staffed_beds").alias("t"))
    return numbered(rows, "place", F.desc_nulls_last("t"), F.asc("state"), F.asc("week"))


@query("srt2_sorted_distinct", "state:s", sql("fw", "SELECT DISTINCT state FROM fw ORDER BY 1"))
def _(spark, sf):
    return facility_week(spark, sf).select("state").distinct().orderBy("state")


@query("srt3_first_last", "state:s first:f last:f", sql("nation_day", """
SELECT state, min_by(response_index, date) AS first, max_by(response_index, date) AS last FROM nation_day GROUP BY 1"""))
def _(spark, sf):
    return policy_day(spark, sf).groupBy("state").agg(
        F.min_by("response_index", "date").alias("first"), F.max_by("response_index", "date").alias("last"))


@query("srt4_top_k", "orderkey:i price:f2", "SELECT o_orderkey AS orderkey, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_totalprice").alias("price"))


@query("set1_union", "kind:s n:i level:f", sql("fw epi", """
SELECT kind, count(*) AS n, sum(level) AS level FROM (SELECT 'week' AS kind, admissions AS level FROM fw UNION ALL SELECT 'episode', NULL FROM epi) GROUP BY 1"""))
def _(spark, sf):
    weeks = facility_week(spark, sf).select(F.lit("week").alias("kind"), F.col("admissions").alias("level"))
    both = weeks.unionByName(episodes(spark, sf).select(F.lit("episode").alias("kind")), allowMissingColumns=True)
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("level").alias("level"))


@query("set2_column_concat", "orderkey:i is_f:f1 is_o:f1 price:f2", """
SELECT o_orderkey AS orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_f, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS is_o, o_totalprice AS price FROM orders""")
def _(spark, sf):
    made = {f"is_{s.lower()}": (F.col("o_orderstatus") == s).cast("double") for s in ("F", "O")}
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("orderkey"), *[c.alias(n) for n, c in made.items()], F.col("o_totalprice").alias("price"))


@query("set3_distinct", "status:s priority:s", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
def _(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).distinct()


@query("set4_difference", "custkey:i", "SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, sf):
    pending = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("custkey"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")).join(pending, "custkey", "left_anti")


@query("join14_week_scaffold", "event_week:i coef:f n:i", sql("ew", """
SELECT w.w AS event_week, CASE WHEN w.w = -1 THEN 0 ELSE c END AS coef, n FROM (SELECT unnest(range(-4, 7)) AS w) w LEFT JOIN (
SELECT event_week, avg(occupancy) AS c, count(*) AS n FROM ew WHERE event_week <> -1 GROUP BY 1) e ON e.event_week = w.w"""))
def _(spark, sf):
    rows = event_time_panel(episodes(spark, sf), facility_ratios(spark, sf)).where("event_week <> -1")
    means = rows.groupBy("event_week").agg(F.avg("occupancy").alias("coef"), F.count("*").alias("n"))
    return week_scaffold(means, "event_week", -4, 6, -1, ["coef"])
