"""Name matching, matched controls and stacked cohorts over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.cleaning import DEPLOY_SQL, deployments
from checks.registry import query
from checks.standins import crosswalk, facility_ratios, sql, table
from crestline.functions.calendars import week_start_sunday, week_span_label
from crestline.functions.changes import log_level
from crestline.functions.cleaning import composite_key, facility_name
from crestline.operators import matching
from crestline.operators.regression import panel_regression, estimates_frame
from crestline.plans import suites
from crestline.session import cut_lineage

# --- names ------------------------------------------------------------------------------------


def names(spark, sf):
    """Left: every part's name without its first letter.  Right: the distinct names per brand.
    Cities: the manufacturer's number in words of differing case and signs."""
    part = table(spark, sf, "part")
    left = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.expr("substring(p_name, 2)").alias("name"),
                       F.concat(F.lit("Port-"), F.expr("CAST(p_size % 5 AS STRING)")).alias("city"))
    right = part.groupBy(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).agg(
        F.min("p_partkey").alias("rid"), F.concat(F.lit("PORT "), F.min(F.expr("CAST(p_size % 5 AS STRING)"))).alias("city"))
    return left, right


NAMES = {
    "ln": ("", "SELECT DISTINCT p_brand AS brand, substring(p_name, 2) AS name, 'port ' || CAST(p_size % 5 AS VARCHAR) AS lcity FROM part"),
    "rn": ("", "SELECT p_brand AS brand, p_name AS rname, min(p_partkey) AS rid, 'PORT ' || min(CAST(p_size % 5 AS VARCHAR)) AS rcity FROM part GROUP BY 1, 2"),
    "bg": ("ln rn", """SELECT *, list_sort(list_distinct(string_split(name, ' '))) AS ta, list_sort(list_distinct(string_split(rname, ' '))) AS tb FROM ln JOIN rn USING (brand)"""),
    "st": ("bg", """SELECT *, array_to_string(ta, ' ') AS a, array_to_string(tb, ' ') AS b, array_to_string(list_sort(list_intersect(ta, tb)), ' ') AS c FROM bg"""),
    "sc": ("st", """SELECT brand, name, lcity, rid, rcity, 100.0 * (1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)) AS score,
        CASE WHEN c <> '' THEN 100.0 * (1.0 - least(levenshtein(c, a) / CAST(greatest(length(a), length(c)) AS DOUBLE), levenshtein(c, b) / CAST(greatest(length(b), length(c)) AS DOUBLE))) ELSE 0.0 END AS part
        FROM st"""),
    "tp": ("sc", """SELECT brand, name, max(rid) FILTER (k = 1) AS matched_id, max(score) FILTER (k = 1) AS score, max(score) FILTER (k = 2) AS second_score FROM (
        SELECT *, row_number() OVER (PARTITION BY brand, name ORDER BY score DESC, rid) AS k FROM (SELECT DISTINCT brand, name, rid, score FROM sc)) GROUP BY 1, 2"""),
    "cs": ("sc", "SELECT brand, name, lcity, rid, rcity, least(100.0, greatest(score, part) + CASE WHEN lcity = lower(rcity) THEN 2.0 ELSE 0.0 END) AS score FROM sc"),
    "ct": ("cs", """SELECT brand, name, lcity, max(rid) FILTER (k = 1) AS matched_id, max(rcity) FILTER (k = 1) AS matched_city, max(score) FILTER (k = 1) AS score,
        max(score) FILTER (k = 2) AS second_score FROM (SELECT *, row_number() OVER (PARTITION BY brand, name, lcity ORDER BY score DESC, rid) AS k FROM cs) GROUP BY 1, 2, 3"""),
}


@query("join11_blocked_name_match", "id:i matched_id:i score:f second_score:f score_gap:f match_ok:b", sql("tp", """
SELECT p_partkey AS id, matched_id, score, second_score, score - second_score AS score_gap,
coalesce(score >= 80 AND (second_score IS NULL OR score - second_score >= 10), FALSE) AS match_ok
FROM part LEFT JOIN tp ON tp.brand = p_brand AND tp.name = substring(p_name, 2)""", NAMES))
def _(spark, sf):
    left, right = names(spark, sf)
    return matching.match_names(left, right, "brand", "id", "rid", "name", min_score=80.0, min_gap=10.0, scorer="edit")


@query("pipe14_match_audit", "id:i matched_id:i matched_city:s score:f second_score:f score_gap:f match_ok:b reason:s", sql("ct", """
SELECT p_partkey AS id, matched_id, matched_city, score, second_score, score - second_score AS score_gap,
coalesce(score >= 85 AND (second_score IS NULL OR score - second_score >= 3), FALSE) AS match_ok,
CASE WHEN coalesce(score >= 85 AND (second_score IS NULL OR score - second_score >= 3), FALSE) THEN 'accepted'
WHEN score IS NULL THEN 'no names in block' ELSE 'manual review required' END AS reason
FROM part LEFT JOIN ct ON ct.brand = p_brand AND ct.name = substring(p_name, 2) AND lcity = 'port ' || CAST(p_size % 5 AS VARCHAR)""", NAMES))
def _(spark, sf):
    left, right = names(spark, sf)
    return matching.match_names(left, right, "brand", "id", "rid", "name", "city", scorer="edit_set")


@query("join11_token_set_match", "id:i matched_id:i matched_city:s score:f second_score:f score_gap:f match_ok:b reason:s")
def _(spark, sf):
    left, right = names(spark, sf)
    return matching.match_names(left, right, "brand", "id", "rid", "name", "city")


# --- controls ---------------------------------------------------------------------------------

AXES = ["occupancy_mean", "occupancy_slope", "staffed_beds_mean"]
OPTIONAL = ["admissions_mean", "admissions_slope"]


def regional(rows, spark, sf):
    """Rows with the nation's region as the state, so that candidate pools are of useful size."""
    places = crosswalk(spark, sf).withColumnRenamed("county_fips", "state")
    return rows.join(places, "state").withColumn("state", F.col("area_id")).drop("area_id")


def cohorts(spark, sf):
    starts = regional(deployments(spark, sf), spark, sf).withColumn("start", week_start_sunday(F.col("start_date")))
    return starts.select(F.col("hospital_id").alias("cohort_id"), "state", "start", "hospital_id")


def matches(spark, sf):
    treated = cut_lineage(cohorts(spark, sf))
    panel = regional(facility_ratios(spark, sf), spark, sf)
    starts = treated.select("state", "start").distinct()
    levels = {"occupancy": True, "staffed_beds": False, "admissions": True}
    features = cut_lineage(matching.pre_features(starts, panel, "state", "hospital_id", "start", "week", levels))
    controls = matching.nearest_controls(
        treated, features, treated, "state", "hospital_id", "start", "cohort_id", AXES, OPTIONAL,
        needed=["occupancy_mean", "staffed_beds_mean"])
    return matching.matched_cohorts(treated, cut_lineage(controls), "cohort_id", "state", "hospital_id", "start")


def _filled(c: str) -> str:
    return f"coalesce({c}, (SELECT median(m.{c}) FROM u m WHERE m.cohort_id = u.cohort_id)) AS {c}"


SHORT = ["occ", "occ_s", "beds", "adm", "adm_s"]
MATCH = {
    **DEPLOY_SQL,
    "coh": ("deploy xwalk", """SELECT hospital_id AS cohort_id, area_id AS state, start_date - CAST(dayofweek(start_date) AS INT) AS start, hospital_id
        FROM deploy JOIN xwalk ON state = county_fips"""),
    "frr": ("fr xwalk", "SELECT fr.* EXCLUDE (state), area_id AS state FROM fr JOIN xwalk ON state = county_fips"),
    "feat": ("coh frr", """SELECT c.state, c.start, f.hospital_id, avg(occupancy) AS occ,
        CASE WHEN count(occupancy) >= 2 THEN regr_slope(occupancy, date_diff('day', c.start, week) / 7.0) END AS occ_s, avg(staffed_beds) AS beds,
        avg(admissions) AS adm, CASE WHEN count(*) >= 2 THEN regr_slope(admissions, date_diff('day', c.start, week) / 7.0) END AS adm_s, count(DISTINCT week) AS wk
        FROM (SELECT DISTINCT state, start FROM coh) c JOIN frr f ON f.state = c.state AND f.week BETWEEN c.start - 28 AND c.start - 7 GROUP BY 1, 2, 3"""),
    "pool": ("feat", "SELECT * FROM feat WHERE wk >= 3 AND occ IS NOT NULL AND beds IS NOT NULL AND hospital_id NOT IN (SELECT hospital_id FROM coh)"),
    "u": ("pool feat coh", """SELECT c.cohort_id, 1 AS t, f.* FROM coh c JOIN feat f USING (state, start, hospital_id) WHERE wk >= 3 AND occ IS NOT NULL
        UNION ALL SELECT c.cohort_id, 0, p.* FROM coh c JOIN pool p USING (state, start)"""),
    "fl": ("u", f"SELECT cohort_id, t, state, start, hospital_id, adm AS adm0, {', '.join(_filled(c) for c in SHORT)} FROM u"),
    "sd": ("fl", f"""SELECT cohort_id, {', '.join(f'CASE WHEN stddev_samp({c}) > 1e-12 THEN 1 / stddev_samp({c}) ELSE 0 END AS w_{c}' for c in SHORT)},
        max(CASE WHEN t = 1 AND adm0 IS NOT NULL THEN 1 ELSE 0 END) AS gate, count(adm0) FILTER (t = 0) AS gn, max(t) AS ht FROM fl GROUP BY 1"""),
    "dist": ("fl sd", f"""SELECT a.cohort_id, a.state, a.start, b.hospital_id, sqrt({' + '.join(
        f"pow(w_{c} * (b.{c} - a.{c}), 2)" if i < 3 else f"CASE WHEN gate = 1 AND gn >= 5 THEN pow(w_{c} * (b.{c} - a.{c}), 2) ELSE 0 END" for i, c in enumerate(SHORT))}) AS distance
        FROM fl a JOIN fl b ON a.cohort_id = b.cohort_id AND a.t = 1 AND b.t = 0 JOIN sd ON sd.cohort_id = a.cohort_id"""),
    "near": ("dist", """SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY cohort_id ORDER BY distance, hospital_id) AS k FROM dist) WHERE k <= 3"""),
    "mt": ("near coh", """SELECT cohort_id, state, start, hospital_id, 0 AS treated, distance FROM near UNION ALL
        SELECT cohort_id, state, start, hospital_id, 1, 0.0 FROM coh WHERE cohort_id IN (SELECT cohort_id FROM near)"""),
    "stk": ("mt fr", """SELECT m.cohort_id, m.state, m.treated, f.hospital_id, f.week, CAST(round(date_diff('day', m.start, f.week) / 7.0) AS INT) AS event_week,
        f.occupancy, f.staffed_beds FROM mt m JOIN fr f USING (hospital_id) WHERE f.week BETWEEN m.start - 42 AND m.start + 42"""),
}


@query("join12_nearest_controls", "cohort_id:i state:s start:d hospital_id:i treated:i distance:f", sql("mt", "SELECT * FROM mt", MATCH))
def _(spark, sf):
    return matches(spark, sf)


def stacked(spark, sf):
    rows = matching.stacked_panel(
        cut_lineage(matches(spark, sf)).select("cohort_id", "state", "start", "hospital_id", "treated"),
        facility_ratios(spark, sf).drop("state"), "hospital_id", "start", "week")
    return rows.withColumns({
        "unit": composite_key(F.col("cohort_id").cast("string"), F.col("hospital_id").cast("string")),
        "calendar_week": week_span_label(F.col("week")),
        "log_beds": log_level(F.col("staffed_beds")),
    })


@query("join13_stacked_cohorts", "cohort_id:i hospital_id:i week:d event_week:i treated:i occupancy:f", sql("stk", "SELECT * FROM stk", MATCH))
def _(spark, sf):
    return stacked(spark, sf)


@query("pipe15_matched_stack", "cohort_id:i hospital_id:i event_week:i treated:i log_beds:f", sql("stk", """
SELECT cohort_id, hospital_id, event_week, treated, CASE WHEN staffed_beds > 0 THEN ln(staffed_beds) END AS log_beds FROM stk
WHERE cohort_id IN (SELECT cohort_id FROM stk GROUP BY 1 HAVING min(treated) = 0 AND max(treated) = 1)""", MATCH))
def _(spark, sf):
    return suites.valid_cohorts(cut_lineage(stacked(spark, sf)))


CHANGE = {**MATCH, "cg": ("stk", """SELECT cohort_id, state, hospital_id, treated, avg(occupancy) FILTER (event_week BETWEEN 1 AND 4) - avg(occupancy) FILTER (event_week IN (-4, -3, -2)) AS delta
        FROM stk GROUP BY 1, 2, 3, 4"""),
          "cd": ("cg", "SELECT * FROM cg WHERE delta IS NOT NULL")}


@query("est32_stacked_change", "n:i clusters:i coef:f se:f", sql("cd", """
SELECT sum(k) AS n, count(*) AS clusters, any_value(b) AS coef, sqrt(sum((p - b * q) ** 2) * count(*) / (count(*) - 1.0) * (sum(k) - 1.0) / (sum(k) - 1.0)) / any_value(tq) AS se FROM (
SELECT state, count(*) AS k, sum(d * delta) AS p, sum(d * d) AS q, sum(sum(d * delta)) OVER () / sum(sum(d * d)) OVER () AS b, sum(sum(d * d)) OVER () AS tq FROM (
SELECT state, delta - avg(delta) OVER (PARTITION BY cohort_id) AS delta, treated - avg(treated) OVER (PARTITION BY cohort_id) AS d FROM cd) GROUP BY 1)""", CHANGE))
def _(spark, sf):
    rows = stacked(spark, sf).groupBy("cohort_id", "state", "hospital_id", "treated").agg(
        (F.avg(F.when(F.col("event_week").between(1, 4), F.col("occupancy")))
         - F.avg(F.when(F.col("event_week").isin(-4, -3, -2), F.col("occupancy")))).alias("delta"))
    fit = panel_regression(rows, "delta", "treated", [], "state", "cohort_id")[1]
    return estimates_frame(spark, [fit])


@query("est31_stacked_event_study", "event_week:i coef:f se:f")
def _(spark, sf):
    # the stand-in weeks lie three days off the starts, so no row rounds to week +6; with one treated unit per
    # cohort and few cohorts, years are the finest calendar effects that leave the interactions identified
    rows = stacked(spark, sf).withColumn("year", F.date_format("week", "yyyy"))
    return suites.event_study(
        rows, "occupancy", "treated", "unit", "state", ["year", "event_week"], tuple(range(-6, 6)), cohort="cohort_id").coefficients()
