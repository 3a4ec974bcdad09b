"""Cluster bridges and area outcomes over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.standins import county_week, crosswalk, episodes, facility_week, population, sql
from crestline.functions.changes import per_100k
from crestline.plans import panels
from crestline.session import cut_lineage

BRIDGE = ("state:s signal_date:d n:i hospitals:i weight:f post:f pre:f innovation:f plain:f")
BRIDGE_SQL = """
SELECT c.state, c.week AS signal_date, count(e.hospital_id) AS n, count(DISTINCT e.hospital_id) AS hospitals, sum(w) AS weight,
sum(w * p) FILTER (w > 0) / sum(w) FILTER (w > 0) AS post, sum(w * r) FILTER (w > 0) / sum(w) FILTER (w > 0) AS pre,
sum(w * p) FILTER (w > 0) / sum(w) FILTER (w > 0) - sum(w * r) FILTER (w > 0) / sum(w) FILTER (w > 0) AS innovation, avg(p - r) AS plain
FROM (SELECT DISTINCT state, week FROM fw) c LEFT JOIN (SELECT hospital_id, state, signal_week, signal_admissions AS w, signal_rel_change AS p,
baseline_admissions AS r FROM epi) e ON e.state = c.state AND e.signal_week BETWEEN c.week - 14 AND c.week + 14 GROUP BY 1, 2"""


@query("pipe6_cluster_bridge", BRIDGE, sql("fw epi", BRIDGE_SQL))
def _(spark, sf):
    clusters = facility_week(spark, sf).select("state", F.col("week").alias("signal_date")).distinct()
    rows = panels.cluster_bridge(clusters, episodes(spark, sf), "signal_rel_change", "baseline_admissions", "signal_admissions")
    return rows.select(
        "state", "signal_date", F.coalesce("state_hospital_episode_count", F.lit(0)).alias("n"),
        F.coalesce("state_hospital_count", F.lit(0)).alias("hospitals"), F.col("state_capacity_weight").alias("weight"),
        F.col("state_post_response").alias("post"), F.col("state_pre_response").alias("pre"),
        F.col("state_response_innovation").alias("innovation"), F.col("state_unweighted_innovation").alias("plain"),
    )


AREA_SQL = {
    "aw": ("cweek pop xwalk", """SELECT x.area_id, c.state, c.week_end, sum(c.deaths) AS deaths,
        sum(CASE WHEN c.deaths IS NOT NULL THEN p.population ELSE 0 END) AS observed, max(t.population) AS population
        FROM cweek c JOIN xwalk x USING (county_fips) LEFT JOIN pop p USING (county_fips)
        LEFT JOIN (SELECT area_id, sum(population) AS population FROM xwalk LEFT JOIN pop USING (county_fips) GROUP BY 1) t ON t.area_id = x.area_id
        GROUP BY 1, 2, 3"""),
    "ae0": ("epi xwalk", """SELECT e.hospital_id, x.area_id, x.area_id AS state, e.signal_week, signal_rel_change AS post, baseline_admissions AS pre,
        signal_admissions AS w FROM epi e JOIN xwalk x ON e.state = x.county_fips"""),
    "ae1": ("ae0", """SELECT *, sum(o) OVER (PARTITION BY area_id ORDER BY signal_week, hospital_id ROWS UNBOUNDED PRECEDING) AS no FROM (
        SELECT *, CASE WHEN date_diff('day', lag(signal_week) OVER (PARTITION BY area_id ORDER BY signal_week, hospital_id), signal_week) <= 7 THEN 0 ELSE 1 END AS o FROM ae0)"""),
    "ae2": ("ae1", """SELECT area_id, no, min(signal_week) AS signal_date FROM (SELECT area_id, no, signal_week, sum(sum(w)) OVER (PARTITION BY area_id, no ORDER BY signal_week) AS c,
        sum(sum(w)) OVER (PARTITION BY area_id, no) AS t FROM ae1 GROUP BY 1, 2, 3) WHERE c >= t / 2 GROUP BY 1, 2"""),
    "ae": ("ae1 ae2", """SELECT a.area_id, a.no, max(b.signal_date) AS signal_date, count(*) AS n, count(DISTINCT hospital_id) AS hospitals, sum(w) AS capacity,
        sum(w * post) / sum(w) AS post, sum(w * pre) / sum(w) AS pre FROM ae1 a JOIN ae2 b ON a.area_id = b.area_id AND a.no = b.no GROUP BY 1, 2"""),
}


def area_weeks(spark, sf):
    return panels.area_week(county_week(spark, sf), population(spark, sf), crosswalk(spark, sf))


def area_episodes(spark, sf, gap_days=7):
    places = crosswalk(spark, sf).withColumnRenamed("county_fips", "state")
    hospital = episodes(spark, sf).join(places, "state").withColumn("state", F.col("area_id"))
    return panels.area_episodes(hospital, "signal_rel_change", "baseline_admissions", "signal_admissions", gap_days=gap_days)


@query("pipe12_area_week", "area_id:s week_end:d deaths:f observed:f population:f coverage:f",
       sql("aw", "SELECT *, observed / population AS coverage FROM aw", AREA_SQL))
def _(spark, sf):
    return area_weeks(spark, sf).withColumnsRenamed({"observed_population": "observed", "population_coverage": "coverage"})


@query("prj38_observed_mask", "county_fips:s week_end:d observed:i masked:f", sql("cweek pop", """
SELECT county_fips, week_end, CAST(deaths IS NOT NULL AS INT) AS observed, CASE WHEN deaths IS NOT NULL THEN population ELSE 0 END AS masked FROM cweek JOIN pop USING (county_fips)"""))
def _(spark, sf):
    rows = county_week(spark, sf).join(population(spark, sf), "county_fips")
    seen = F.col("deaths").isNotNull()
    return rows.withColumn("observed", seen.cast("int")).withColumn("masked", F.when(seen, F.col("population")).otherwise(0.0))


@query("agg18_population_coverage", "area_id:s mean_coverage:f low_weeks:i", sql("aw", """
SELECT area_id, avg(observed / population) AS mean_coverage, count(*) FILTER (observed / population < 0.8) AS low_weeks FROM aw GROUP BY 1""", AREA_SQL))
def _(spark, sf):
    return area_weeks(spark, sf).groupBy("area_id").agg(
        F.avg("population_coverage").alias("mean_coverage"), F.count_if(F.col("population_coverage") < 0.8).alias("low_weeks"))


@query("agg19_rate", "area_id:s week_end:d rate:f4", sql("aw", "SELECT area_id, week_end, deaths / population * 100000 AS rate FROM aw", AREA_SQL))
def _(spark, sf):
    return area_weeks(spark, sf).withColumn("rate", per_100k(F.col("deaths"), F.col("population")))


@query("pipe13_area_episodes", "area_id:s no:i signal_date:d n:i hospitals:i capacity:f post:f pre:f", sql("ae", "SELECT * FROM ae", AREA_SQL))
def _(spark, sf):
    return area_episodes(spark, sf).withColumnsRenamed({
        "area_episode_no": "no", "hospital_episode_count": "n", "hospital_count": "hospitals", "represented_capacity": "capacity",
        "area_post_response": "post", "area_pre_response": "pre"})


MORTALITY = "area_id:s no:i rate1:f4 coverage1:f weeks1:i rate2:f4 coverage2:f weeks2:i"
MORTALITY_SQL = """
SELECT area_id, no, CASE WHEN c1 >= {least} THEN d1 / p * 100000 END AS rate1, c1 AS coverage1, n1 AS weeks1,
CASE WHEN c2 >= {least} THEN d2 / p * 100000 END AS rate2, c2 AS coverage2, n2 AS weeks2 FROM (
SELECT e.area_id, e.no, max(population) AS p, sum(deaths) FILTER (date_diff('day', signal_date, week_end) <= 42) AS d1,
avg(observed / population) FILTER (date_diff('day', signal_date, week_end) <= 42) AS c1, count(week_end) FILTER (date_diff('day', signal_date, week_end) <= 42) AS n1,
sum(deaths) FILTER (date_diff('day', signal_date, week_end) >= 21) AS d2, avg(observed / population) FILTER (date_diff('day', signal_date, week_end) >= 21) AS c2,
count(week_end) FILTER (date_diff('day', signal_date, week_end) >= 21) AS n2
FROM ae e LEFT JOIN aw ON aw.area_id = e.area_id AND week_end BETWEEN signal_date + 14 AND signal_date + 49 GROUP BY 1, 2)"""
#: The same episodes with gaps of 21 days.
WIDE_SQL = {**AREA_SQL, "ae1": (AREA_SQL["ae1"][0], AREA_SQL["ae1"][1].replace("<= 7 ", "<= 21 "))}


def mortality(spark, sf, gap_days, least):
    out = panels.area_mortality(
        cut_lineage(area_episodes(spark, sf, gap_days)), cut_lineage(area_weeks(spark, sf)), min_coverage=least)
    return out.withColumnsRenamed({
        "area_episode_no": "no", "deaths_14_42_per100k": "rate1", "coverage_14_42": "coverage1", "weeks_14_42": "weeks1",
        "deaths_21_49_per100k": "rate2", "coverage_21_49": "coverage2", "weeks_21_49": "weeks2"})


@query("pipe13_area_mortality", MORTALITY, sql("ae aw", MORTALITY_SQL.format(least=0.61), AREA_SQL))
def _(spark, sf):
    return mortality(spark, sf, 7, 0.61)


@query("pipe13_area_mortality_wide", MORTALITY, sql("ae aw", MORTALITY_SQL.format(least=0.8), WIDE_SQL))
def _(spark, sf):
    return mortality(spark, sf, 21, 0.8)
