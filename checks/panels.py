"""Composite panels over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.standins import (
    episodes, excess_week, facility_ratios, facility_week, policy_day, region_day, sql,
)
from crestline.functions.calendars import WAVE_ENDS
from crestline.operators.windows import zscore
from crestline.plans import panels
from crestline.session import cut_lineage

EP = ["hospital_id", "state", "signal_week"]
WAVE_SQL = " ".join(f"WHEN {{d}} < DATE '{d}' THEN '{w}'" for d, w in WAVE_ENDS)


def wave_sql(day: str) -> str:
    return f"CASE {WAVE_SQL.format(d=day)} ELSE 'omicron_later' END"


def quarter_sql(day: str) -> str:
    return f"CAST(year({day}) AS VARCHAR) || 'Q' || CAST(quarter({day}) AS VARCHAR)"


SURGE_SQL = {
    "d7": ("rday", """SELECT *, CASE WHEN count(covid_admissions) OVER w >= 4 THEN avg(covid_admissions) OVER w END AS level FROM rday
        WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""),
    "dbase": ("d7", """SELECT *, CASE WHEN count(level) OVER w >= 14 THEN median(level) OVER w END AS base FROM d7
        WINDOW w AS (PARTITION BY state ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"""),
    "dcand": ("dbase", """SELECT state, date, level, level / nullif(base, 0) - 1 AS rel FROM dbase
        WHERE level >= 25 AND level / nullif(base, 0) - 1 >= 0.5"""),
    "days": ("dcand", """SELECT state, min(date) AS date, 1 AS n FROM dcand GROUP BY 1 UNION ALL
        SELECT state, (SELECT min(c.date) FROM dcand c WHERE c.state = days.state AND c.date >= days.date + 42), n + 1
        FROM days WHERE date IS NOT NULL"""),
    "sig": ("dcand days", "SELECT s.state, s.n AS episode_id, s.date AS signal_date, c.level, c.rel FROM days s JOIN dcand c USING (state, date)"),
    "lat": ("sig nation_day", """SELECT b.state, b.episode_id, b.signal_date, b.level, b.rel, b.ix AS baseline,
        min(n.date) FILTER (n.response_index - b.ix >= 5) AS response_date
        FROM (SELECT s.*, n.response_index AS ix FROM sig s ASOF JOIN nation_day n ON s.state = n.state AND s.signal_date >= n.date) b
        JOIN nation_day n ON n.state = b.state AND n.date BETWEEN b.signal_date AND b.signal_date + 21 GROUP BY ALL"""),
}


def surge_sql(names: str, body: str) -> str:
    # the greedy chain refers to itself, so it cannot be materialised
    return sql(names, body, SURGE_SQL).replace("days AS MATERIALIZED", "days AS")


@query("pipe1_state_surge_outcomes",
       "state:s episode_id:i signal_date:d admissions:f rel:f baseline:f response_date:d detected:i latency:i deaths:f later:f icu:f staff:f month:s year:i",
       surge_sql("lat excess rday", """
SELECT l.state, l.episode_id, l.signal_date, l.level AS admissions, l.rel, l.baseline, l.response_date,
CAST(l.response_date IS NOT NULL AS INT) AS detected, coalesce(date_diff('day', l.signal_date, l.response_date), 22) AS latency,
(SELECT sum(excess_deaths) FROM excess x WHERE x.state = l.state AND x.week_ending_date BETWEEN l.signal_date + 7 AND l.signal_date + 35) AS deaths,
(SELECT sum(covid_admissions) FROM rday r WHERE r.state = l.state AND r.date BETWEEN l.signal_date + 1 AND l.signal_date + 28) AS later,
(SELECT max(covid_icu_patients / nullif(icu_beds_total, 0)) FROM rday r WHERE r.state = l.state AND r.date BETWEEN l.signal_date + 1 AND l.signal_date + 28) AS icu,
(SELECT avg(hospitals_staffing_shortage) FROM rday r WHERE r.state = l.state AND r.date BETWEEN l.signal_date + 1 AND l.signal_date + 28) AS staff,
strftime(l.signal_date, '%Y-%m') AS month, year(l.signal_date) AS year FROM lat l"""))
def _(spark, sf):
    out = panels.state_surge_outcomes(
        cut_lineage(region_day(spark, sf)), cut_lineage(policy_day(spark, sf)), excess_week(spark, sf))
    names = {
        "signal_admissions_7dma": "admissions", "signal_rel_change": "rel", "baseline_response_index": "baseline",
        "latency_days": "latency", "excess_deaths_next_28d": "deaths", "covid_admissions_next_28d": "later",
        "max_icu_covid_share_next_28d": "icu", "mean_staffing_shortage_next_28d": "staff", "signal_month": "month",
        "signal_year": "year",
    }
    return out.withColumnsRenamed(names)


@query("pipe2_hospital_surges", "hospital_id:i state:s signal_week:d episode_no:i signal_admissions:f signal_rel_change:f baseline_admissions:f",
       sql("epi", "SELECT * FROM epi"))
def _(spark, sf):
    return episodes(spark, sf)


QUALITY_SQL = {
    "q0": ("ew", """SELECT hospital_id, state, signal_week, count(*) FILTER (event_week BETWEEN -4 AND -1) AS nb,
        count(*) FILTER (event_week IN (1, 2)) AS np, median(staffed_beds) FILTER (event_week BETWEEN -4 AND -1) AS bc,
        median(covid_census) FILTER (event_week BETWEEN -4 AND -1) AS bd, max(staffed_beds) FILTER (event_week = 1) AS c1,
        max(staffed_beds) FILTER (event_week = 2) AS c2, max(covid_census) FILTER (event_week = 1) AS d1,
        max(covid_census) FILTER (event_week = 2) AS d2 FROM ew WHERE event_week <= 4 GROUP BY 1, 2, 3"""),
    "q": ("q0 epi", """SELECT e.*, nb, np, CASE WHEN nb >= 3 THEN bc END AS bcap, CASE WHEN nb >= 3 THEN bd END AS bdem,
        CASE WHEN nb >= 3 AND np = 2 AND bc > 0 THEN c1 END AS w1, CASE WHEN nb >= 3 AND np = 2 AND bc > 0 THEN c2 END AS w2,
        nb >= 3 AND np = 2 AND bc > 0 AND abs(c2 - c1) <= greatest(bc, 50) AS persistent,
        CASE WHEN nb >= 3 AND np = 2 AND bc > 0 THEN ((c1 + c2) / 2 / bc - 1) * 100 END AS cap_pp,
        CASE WHEN nb >= 3 AND np = 2 AND bd > 0 THEN ((d1 + d2) / 2 / bd - 1) * 100 END AS dem_pp,
        nb >= 3 AND np = 2 AND bc > 0 AND bd > 0 AND abs(c2 - c1) <= greatest(bc, 50) AS ok
        FROM q0 JOIN epi e USING (hospital_id, state, signal_week)"""),
}


@query("pipe3_quality_audit", "hospital_id:i signal_week:d nb:i np:i bcap:f bdem:f w1:f w2:f persistent:b ok:b cap_pp:f dem_pp:f",
       sql("q", "SELECT * FROM q", QUALITY_SQL))
def _(spark, sf):
    audit = panels.quality_audit(episodes(spark, sf), facility_week(spark, sf))
    return audit.withColumnsRenamed({
        "n_baseline_good_weeks": "nb", "n_post_good_weeks": "np", "baseline_capacity_quality": "bcap",
        "baseline_demand_quality": "bdem", "capacity_week1": "w1", "capacity_week2": "w2",
        "persistent_capacity_ok": "persistent", "objective_quality_ok": "ok",
        "sustained_capacity_change_w1_2_pp": "cap_pp", "sustained_demand_change_w1_2_pp": "dem_pp",
    })


@query("win12_two_week_persistence", "persistent:b n:i", sql("q", "SELECT persistent, count(*) AS n FROM q GROUP BY 1", QUALITY_SQL))
def _(spark, sf):
    audit = panels.quality_audit(episodes(spark, sf), facility_week(spark, sf))
    return audit.groupBy(F.col("persistent_capacity_ok").alias("persistent")).agg(F.count("*").alias("n"))


TRIAL_SQL = {
    "trial": ("ew", f"""SELECT hospital_id, state, signal_week, avg(occupancy) FILTER (event_week IN (-4, -3, -2)) AS pre_mean,
        avg(occupancy) FILTER (event_week IN (2, 3, 4)) - avg(occupancy) FILTER (event_week IN (-4, -3, -2)) AS delta,
        CASE WHEN count(occupancy) FILTER (event_week IN (-4, -3, -2)) >= 2 THEN regr_slope(occupancy, event_week) FILTER (event_week IN (-4, -3, -2)) END AS pre_slope,
        stddev_samp(occupancy) FILTER (event_week IN (-4, -3, -2)) AS volatility, avg(occupancy) FILTER (event_week = -2) AS m2,
        avg(admissions) FILTER (event_week IN (-4, -3, -2)) AS adm_mean, regr_slope(admissions, event_week) FILTER (event_week IN (-4, -3, -2)) AS adm_slope,
        avg(staffed_beds) FILTER (event_week IN (-4, -3, -2)) AS beds, avg(icu_occupancy) FILTER (event_week IN (-4, -3, -2)) AS icu_mean,
        CASE WHEN count(icu_occupancy) FILTER (event_week IN (-4, -3, -2)) >= 2 THEN regr_slope(icu_occupancy, event_week) FILTER (event_week IN (-4, -3, -2) AND icu_occupancy IS NOT NULL) END AS icu_slope,
        {quarter_sql('signal_week')} AS quarter, {wave_sql('signal_week')} AS wave
        FROM ew WHERE event_week <= 4 GROUP BY 1, 2, 3
        HAVING count(*) FILTER (event_week IN (-4, -3, -2)) >= 2 AND count(*) FILTER (event_week IN (2, 3, 4)) >= 2"""),
    "modes": ("ew", """SELECT hospital_id, signal_week, subtype AS kind FROM (SELECT hospital_id, signal_week, subtype, row_number() OVER (
        PARTITION BY hospital_id, signal_week ORDER BY count(*) DESC, subtype) AS r FROM ew WHERE event_week IN (-4, -3, -2) GROUP BY 1, 2, 3) WHERE r = 1"""),
}

TRIAL_NAMES = {
    "occupancy_pre_mean": "pre_mean", "delta_occupancy": "delta", "occupancy_pre_slope": "pre_slope",
    "occupancy_pre_volatility": "volatility", "occupancy_week_m2": "m2", "admissions_pre_mean": "adm_mean",
    "admissions_pre_slope": "adm_slope", "staffed_beds_pre_mean": "beds", "icu_pre_mean": "icu_mean",
    "icu_pre_slope": "icu_slope", "signal_quarter": "quarter", "hospital_subtype": "kind",
}


def trial(spark, sf):
    """Target-trial episodes with short column names; the facility panel is staged once."""
    panel = cut_lineage(facility_week(spark, sf))
    return panels.target_trial(panels.hospital_surges(panel), panels.with_ratios(panel)).withColumnsRenamed(TRIAL_NAMES)


@query("pipe7_target_trial_panel",
       "hospital_id:i state:s signal_week:d delta:f pre_mean:f pre_slope:f9 volatility:f9 m2:f adm_mean:f adm_slope:f9 beds:f icu_mean:f9 icu_slope:f9 kind:s quarter:s wave:s",
       sql("trial modes", "SELECT t.*, m.kind FROM trial t JOIN modes m USING (hospital_id, signal_week) WHERE delta IS NOT NULL", TRIAL_SQL))
def _(spark, sf):
    return trial(spark, sf)


@query("pipe7_ratio_of_means", "hospital_id:i signal_week:d delta:f", sql("ew", """
SELECT hospital_id, signal_week, avg(occupied_beds) FILTER (event_week IN (2, 3, 4)) / avg(staffed_beds) FILTER (event_week IN (2, 3, 4))
- avg(occupied_beds) FILTER (event_week IN (-4, -3, -2)) / avg(staffed_beds) FILTER (event_week IN (-4, -3, -2)) AS delta FROM ew GROUP BY 1, 2
HAVING count(*) FILTER (event_week IN (-4, -3, -2)) >= 2 AND count(*) FILTER (event_week IN (2, 3, 4)) >= 2"""))
def _(spark, sf):
    out = panels.target_trial(episodes(spark, sf), facility_ratios(spark, sf), by_week_count=True, ratio_of_means=True)
    return out.withColumnRenamed("delta_occupancy", "delta")


def event_time(spark, sf, carry=()):
    panel = cut_lineage(facility_week(spark, sf))
    return panels.event_time_panel(panels.hospital_surges(panel), panels.with_ratios(panel), carry)


@query("pipe8_pretrend_features", "hospital_id:i signal_week:d pre_mean:f post_mean:f pre_slope:f pre_sd:f delta:f", sql("ew", """
SELECT hospital_id, signal_week, (SELECT avg(v) FROM unnest([m4, m3, m2]) AS t(v)) AS pre_mean, (SELECT avg(v) FROM unnest([p2, p3, p4]) AS t(v)) AS post_mean,
(m2 - m4) / 2 AS pre_slope, sd AS pre_sd, (SELECT avg(v) FROM unnest([p2, p3, p4]) AS t(v)) - (SELECT avg(v) FROM unnest([m4, m3, m2]) AS t(v)) AS delta FROM (
SELECT hospital_id, signal_week, avg(occupancy) FILTER (event_week = -4) AS m4, avg(occupancy) FILTER (event_week = -3) AS m3,
avg(occupancy) FILTER (event_week = -2) AS m2, avg(occupancy) FILTER (event_week = 2) AS p2, avg(occupancy) FILTER (event_week = 3) AS p3,
avg(occupancy) FILTER (event_week = 4) AS p4, stddev_samp(occupancy) FILTER (event_week IN (-4, -3, -2)) AS sd FROM ew GROUP BY 1, 2)"""))
def _(spark, sf):
    return panels.pretrend_features(event_time(spark, sf))


@query("pipe9_early_mediators", "hospital_id:i signal_week:d bed:f icu:f", sql("ew", """
SELECT hospital_id, signal_week, CASE WHEN b0 > 0 AND b1 > 0 THEN ln(b1) - ln(b0) END AS bed, CASE WHEN i0 > 0 AND i1 > 0 THEN ln(i1) - ln(i0) END AS icu FROM (
SELECT hospital_id, signal_week, avg(staffed_beds) FILTER (event_week IN (-4, -3, -2)) AS b0, avg(staffed_beds) FILTER (event_week IN (1, 2)) AS b1,
avg(icu_beds) FILTER (event_week IN (-4, -3, -2)) AS i0, avg(icu_beds) FILTER (event_week IN (1, 2)) AS i1 FROM ew WHERE event_week <= 4 GROUP BY 1, 2)"""))
def _(spark, sf):
    return panels.early_mediators(episodes(spark, sf), facility_week(spark, sf)).withColumnsRenamed(
        {"early_log_bed_change": "bed", "early_log_icu_bed_change": "icu"})


def lag_sql(windows: dict[str, tuple[int, ...]]) -> str:
    cols, inner = [], []
    for tag, weeks in {"pre": (-4, -3, -2), **windows}.items():
        inside = f"FILTER (event_week IN {weeks})"
        inner += [f"avg({c}) {inside} AS {tag}_{a}" for c, a in (("staffed_beds", "s"), ("occupied_beds", "o"), ("covid_census", "c"))]
        inner.append(f"count(DISTINCT event_week) {inside} AS {tag}_weeks")
    for t in windows:
        cols += [
            f"CASE WHEN {t}_s > 0 THEN {t}_o / {t}_s END - CASE WHEN pre_s > 0 THEN pre_o / pre_s END AS {t}_ratio",
            f"CASE WHEN pre_s > 0 THEN ({t}_o - pre_o) / pre_s END AS {t}_burden",
            f"CASE WHEN {t}_o > 0 AND pre_o > 0 THEN 100 * (ln({t}_o) - ln(pre_o)) END AS {t}_log",
            f"CASE WHEN pre_s > 0 THEN ({t}_c - pre_c) / pre_s END AS {t}_covid",
            f"100 * (ln(1 + {t}_c) - ln(1 + pre_c)) AS {t}_log1p",
        ]
    last = max(max(w) for w in windows.values())
    weeks = ", ".join(f"{t}_weeks" for t in ("pre", *windows))
    return f"SELECT hospital_id, signal_week, {weeks}, {', '.join(cols)} FROM (SELECT hospital_id, signal_week, {', '.join(inner)} FROM ew WHERE event_week <= {last} GROUP BY 1, 2)"


def lag_names(windows) -> dict[str, str]:
    ends = {"occupancy_ratio_change": "ratio", "fixed_occupied_burden": "burden", "log_occupied_change": "log",
            "fixed_covid_census": "covid", "log1p_covid_change": "log1p"}
    return {f"{t}_{a}": f"{t}_{b}" for t in windows for a, b in ends.items()}


def lag_columns(windows) -> str:
    names = [f"{n}:f" for n in lag_names(windows).values()]
    return "hospital_id:i signal_week:d " + " ".join([f"{t}_weeks:i" for t in ("pre", *windows)] + names)


OUTCOMES = {"w24": (2, 3, 4)}
LAGS = {"lag35": (3, 4, 5), "lag36": (3, 4, 5, 6)}


@query("pipe10_denominator_independent", lag_columns(OUTCOMES), sql("ew", lag_sql(OUTCOMES)))
def _(spark, sf):
    return panels.lagged_outcomes(episodes(spark, sf), facility_week(spark, sf), OUTCOMES).withColumnsRenamed(lag_names(OUTCOMES))


@query("pipe11_strict_lags", lag_columns(LAGS), sql("ew", lag_sql(LAGS)))
def _(spark, sf):
    return panels.lagged_outcomes(episodes(spark, sf), facility_week(spark, sf), LAGS).withColumnsRenamed(lag_names(LAGS))


@query("pipe17_event_time_panel", "episode_id:s event_week:i calendar_week:d occupancy:f", sql("ew", """
SELECT CAST(hospital_id AS VARCHAR) || '__' || CAST(signal_week AS VARCHAR) AS episode_id, event_week, week AS calendar_week, occupancy FROM ew"""))
def _(spark, sf):
    return event_time(spark, sf)


@query("prj27_event_interactions", "hospital_id:i signal_week:d event_week:i xm4:f x0:f x3:f", sql("ew epi", """
SELECT hospital_id, signal_week, event_week, CASE WHEN event_week = -4 THEN r ELSE 0 END AS xm4, CASE WHEN event_week = 0 THEN r ELSE 0 END AS x0,
CASE WHEN event_week = 3 THEN r ELSE 0 END AS x3 FROM (SELECT ew.*, e.signal_rel_change AS r FROM ew JOIN epi e USING (hospital_id, signal_week))"""))
def _(spark, sf):
    from crestline.plans.suites import event_interactions

    rows, names = event_interactions(event_time(spark, sf, ["signal_rel_change"]), "signal_rel_change")
    return rows.withColumnsRenamed({names[-4]: "xm4", names[0]: "x0", names[3]: "x3"})


@query("prj28_modifier_interaction", "hospital_id:i signal_week:d product:f", sql("epi", """
SELECT hospital_id, signal_week, signal_rel_change * (signal_admissions - avg(signal_admissions) OVER ()) / stddev_samp(signal_admissions) OVER () AS product FROM epi"""))
def _(spark, sf):
    rows = zscore(episodes(spark, sf), ["signal_admissions"])
    return rows.withColumn("product", F.col("signal_rel_change") * F.col("signal_admissions_z"))
