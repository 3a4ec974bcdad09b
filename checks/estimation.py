"""Distributed estimation over the provided tables.

The study table holds one row per surge episode: outcome ``delta`` (occupancy change),
exposure ``x`` (relative size of the signal), pre-period covariates, and the year.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from checks.olssql import demeaned, held_out, orthogonal, regression, slope
from checks.panels import QUALITY_SQL, TRIAL_NAMES, TRIAL_SQL
from checks.registry import query
from checks.standins import facility_week, sql
from crestline.operators import expectation, folds, orthogonal as dml, regression as reg
from crestline.operators.aggregates import replicate_summary
from crestline.operators.gram import cluster_grams
from crestline.operators.learners import fold_sizes
from crestline.operators.splines import spline_basis
from crestline.operators.trees import boosted, forest
from crestline.operators.windows import demean
from crestline.plans import panels, suites
from crestline.session import cut_lineage

EP = ["hospital_id", "signal_week"]
YEARS = range(1992, 2005)

STUDY = {
    **TRIAL_SQL, **QUALITY_SQL,
    "study": ("trial epi", """SELECT t.hospital_id, t.state, t.signal_week, delta, pre_mean, volatility, adm_mean, beds, icu_mean, pre_slope,
        signal_rel_change AS x, signal_admissions AS adm, baseline_admissions AS base, CAST(year(signal_week) AS VARCHAR) AS yr
        FROM trial t JOIN epi e USING (hospital_id, signal_week) WHERE delta IS NOT NULL AND volatility IS NOT NULL"""),
}
YEAR_DUMMIES = [f"CASE WHEN yr = '{y}' THEN 1 ELSE 0 END" for y in YEARS]


def study(spark, sf) -> DataFrame:
    panel = cut_lineage(facility_week(spark, sf))
    signals = panels.hospital_surges(panel)
    rows = panels.target_trial(signals, panels.with_ratios(panel)).withColumnsRenamed(TRIAL_NAMES)
    extra = signals.select(
        *EP, F.col("signal_rel_change").alias("x"), F.col("signal_admissions").alias("adm"),
        F.col("baseline_admissions").alias("base"),
    )
    out = rows.join(extra, EP).where(F.col("volatility").isNotNull()).withColumn("yr", F.year("signal_week").cast("string"))
    return cut_lineage(out)


def ssql(names: str, body: str, extra: dict) -> str:
    return sql(names, body, {**STUDY, **extra})


def fit_frame(spark, *fits: reg.Fit) -> DataFrame:
    return reg.estimates_frame(spark, list(fits), exposure_only=True)


# --- moments and absorption -------------------------------------------------------------------

GRAM = ["delta", "x", "pre_mean"]
G0 = {"g0": ("study", demeaned("study", GRAM, "hospital_id", ["state", "hospital_id"]))}


@query("agg26_cluster_grams", "state:s n:i entities:i i:i j:i value:f", ssql("g0", "\nUNION ALL\n".join(
    f"SELECT state, count(*) AS n, count(DISTINCT hospital_id) AS entities, {i} AS i, {j} AS j, sum(v{i} * v{j}) AS value FROM g0 GROUP BY 1"
    for i in range(3) for j in range(i, 3)), G0))
def _(spark, sf):
    g = cluster_grams(study(spark, sf), GRAM, "state", "hospital_id")
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col("val")[k] * g.scale[GRAM[i]] * g.scale[GRAM[j]]).alias("value"))
        for k, (i, j) in enumerate(pairs)
    ])
    return g.table.select(F.col("c").alias("state"), "n", "entities", F.inline(cells))


ABS = orthogonal("a", "a0", 15, 13, ["hospital_id", "signal_week"])
ABS0 = {"a0": ("study", demeaned("study", [*YEAR_DUMMIES, "x", "delta"], "hospital_id", EP)), **ABS}
ABS_SQL = ssql("a13", "SELECT hospital_id, signal_week, v13 AS x_abs, v14 AS delta_abs FROM a13", ABS0)


@query("est1_absorb", "hospital_id:i signal_week:d x_abs:f delta_abs:f", ABS_SQL)
def _(spark, sf):
    return reg.absorb(study(spark, sf), ["x", "delta"], "state", "hospital_id", ["yr"])


@query("est1_absorb_iterative", "hospital_id:i signal_week:d x_abs:f5 delta_abs:f5", ABS_SQL)
def _(spark, sf):
    # crossed effects: neither the hospitals nor the years lie within the other
    return reg.absorb_iterative(study(spark, sf), ["x", "delta"], ["hospital_id", "yr"], tol=1e-8)


EST2 = regression("m", "study", "delta", "x", ["pre_mean", "adm_mean"], YEAR_DUMMIES, "hospital_id", "state")
EST2_SQL = ssql(f"m{len(YEAR_DUMMIES) + 2}", EST2[1], EST2[0])
CONTROLS = ["pre_mean", "adm_mean"]


def primary(spark, sf):
    return reg.panel_regression(study(spark, sf), "delta", "x", CONTROLS, "state", "hospital_id", ["yr"], spec="primary")


@query("est2_cluster_ols", "n:i clusters:i coef:f se:f", EST2_SQL)
def _(spark, sf):
    return fit_frame(spark, primary(spark, sf)[1])


@query("est3_iid_ols", "n:i coef:f se:f", ssql("i2", """
SELECT count(*) AS n, sum(v2 * v3) / sum(v2 * v2) AS coef, sqrt(greatest(sum(v3 * v3) - sum(v2 * v3) * sum(v2 * v3) / sum(v2 * v2), 0) / (count(*) - 3) / sum(v2 * v2)) AS se FROM i2""",
    {"i0": ("study", demeaned("study", ["1.0", "pre_mean", "x", "delta"], None, ["state"])), **orthogonal("i", "i0", 4, 2, ["state"])}))
def _(spark, sf):
    rows = study(spark, sf).withColumn("one", F.lit(1.0))
    model = reg.Regression(cluster_grams(rows, ["delta", "x", "pre_mean", "one"], "state"))
    return fit_frame(spark, model.classical("delta", ["x", "pre_mean", "one"]))


@query("est4_fe_wrapper", "n:i clusters:i entities:i coef:f se:f std_beta:f", ssql(f"m{len(YEAR_DUMMIES) + 2}", f"""
SELECT f.*, (SELECT count(DISTINCT hospital_id) FROM study) AS entities,
coef * (SELECT stddev_samp(x) FROM study) / (SELECT stddev_samp(delta) FROM study) AS std_beta FROM ({EST2[1]}) f""", EST2[0]))
def _(spark, sf):
    return fit_frame(spark, primary(spark, sf)[1])


GRID = {
    "year": (YEAR_DUMMIES, CONTROLS),
    "linear": ([], [*CONTROLS, "date_diff('day', DATE '1990-01-01', signal_week)"]),
    "entity": ([], CONTROLS),
}
GRID_PARTS = {k: regression(f"s{k}", "study", "delta", "x", c, d, "hospital_id", "state") for k, (d, c) in GRID.items()}


@query("est5_spec_grid", "spec:s n:i coef:f se:f", ssql(
    " ".join(f"s{k}{len(d) + len(c)}" for k, (d, c) in GRID.items()),
    "\nUNION ALL\n".join(f"SELECT '{k}' AS spec, n, coef, se FROM ({GRID_PARTS[k][1]})" for k in GRID),
    reduce(lambda a, b: {**a, **b}, [p[0] for p in GRID_PARTS.values()])))
def _(spark, sf):
    rows = study(spark, sf).withColumn("day", F.datediff("signal_week", F.lit("1990-01-01").cast("date")).cast("double"))
    specs = {
        "year": dict(controls=CONTROLS, entity="hospital_id", factors=["yr"]),
        "linear": dict(controls=[*CONTROLS, "day"], entity="hospital_id"),
        "entity": dict(controls=CONTROLS, entity="hospital_id"),
    }
    return reg.specification_grid(rows, specs, "delta", "x", "state")


SETS = {"none": [], "level": ["pre_mean"], "both": CONTROLS}
SET_PARTS = {k: regression(f"n{k}", "study", "delta", "x", c, [], "hospital_id", "state") for k, c in SETS.items()}


@query("est5_nested_controls", "label:s n:i coef:f se:f", ssql(
    " ".join(f"n{k}{len(c)}" for k, c in SETS.items()),
    "\nUNION ALL\n".join(f"SELECT '{k}' AS label, n, coef, se FROM ({SET_PARTS[k][1]})" for k in SETS),
    reduce(lambda a, b: {**a, **b}, [p[0] for p in SET_PARTS.values()])))
def _(spark, sf):
    return reg.nested_controls(study(spark, sf), SETS, "delta", "x", "state", "hospital_id")


LOO_BASE = {"loo": ("study", "SELECT s.*, g.excluded FROM study s JOIN (SELECT DISTINCT state AS excluded FROM study) g ON s.state <> g.excluded")}
LOO = regression("l", "loo", "delta", "x", CONTROLS, [], "hospital_id", "state", group="excluded")


@query("est6_leave_one_cluster_out", "excluded:s n:i coef:f se:f", ssql("l2", f"SELECT * FROM ({LOO[1]})", {**LOO_BASE, **LOO[0]}))
def _(spark, sf):
    model = reg.Regression(cluster_grams(study(spark, sf), ["delta", "x", *CONTROLS], "state", "hospital_id"))
    return model.leave_one_out("delta", ["x", *CONTROLS])


@query("agg24_leave_one_out_summary", "n_models:i median_coef:f min_coef:f max_coef:f sd_coef:f fraction_negative:f", ssql("l2", f"""
SELECT count(*) AS n_models, median(coef) AS median_coef, min(coef) AS min_coef, max(coef) AS max_coef, stddev_samp(coef) AS sd_coef,
avg(CASE WHEN coef < 0 THEN 1.0 ELSE 0.0 END) AS fraction_negative FROM ({LOO[1]})""", {**LOO_BASE, **LOO[0]}))
def _(spark, sf):
    model = reg.Regression(cluster_grams(study(spark, sf), ["delta", "x", *CONTROLS], "state", "hospital_id"))
    return replicate_summary(model.leave_one_out("delta", ["x", *CONTROLS]))


REPS = 999
BOOT = {
    "b0": ("study", demeaned("study", ["x", "delta"], "hospital_id", ["state"])),
    "bc": ("b0", "SELECT state, sum(v0 * v1) AS p, sum(v0 * v0) AS q, count(*) AS n FROM b0 GROUP BY 1"),
    "br": ("bc", f"""SELECT r.rep, bc.state, q, p, CASE WHEN md5(CAST(r.rep AS VARCHAR) || '_' || state) < '8' THEN -1.0 ELSE 1.0 END * p AS sp, n
        FROM bc, (SELECT unnest(range(0, {REPS + 1})) AS rep) r"""),
    "bt": ("br", """SELECT rep, CASE WHEN rep = 0 THEN sum(p) ELSE sum(sp) END / sum(q) AS b, sum(q) AS q FROM br GROUP BY 1"""),
    "bv": ("br bt", """SELECT rep, b / sqrt(sum((CASE WHEN rep = 0 THEN p ELSE sp END - b * br.q) ** 2) * count(*) / (count(*) - 1) * (sum(n) - 1) / (sum(n) - 1)) * any_value(bt.q) AS t
        FROM br JOIN bt USING (rep) GROUP BY rep, b"""),
}


@query("est7_wild_bootstrap", "reps_valid:i observed_t:f p_value:f t_p025:f t_median:f t_p975:f", ssql("bv", """
SELECT count(*) FILTER (rep > 0) AS reps_valid, max(t) FILTER (rep = 0) AS observed_t,
(count(*) FILTER (rep > 0 AND abs(t) >= (SELECT abs(t) - 1e-12 FROM bv WHERE rep = 0)) + 1.0) / (count(*) FILTER (rep > 0) + 1) AS p_value,
quantile_cont(t, 0.025) FILTER (rep > 0) AS t_p025, quantile_cont(t, 0.5) FILTER (rep > 0) AS t_median, quantile_cont(t, 0.975) FILTER (rep > 0) AS t_p975 FROM bv""", BOOT))
def _(spark, sf):
    model = reg.Regression(cluster_grams(study(spark, sf), ["delta", "x"], "state", "hospital_id"))
    found, _ = model.wild_bootstrap("delta", ["x"], reps=REPS)
    return spark.createDataFrame([{k: float(v) for k, v in found.items()}])


WALD = {"w0": ("study", demeaned("study", ["x", "pre_mean", "delta"], "hospital_id", ["state", *EP])), **orthogonal("w", "w0", 3, 1, ["state", *EP])}
WALD_SQL = """
SELECT n, (b1 * b1 * v22 - 2 * b1 * b2 * v12 + b2 * b2 * v11) / (v11 * v22 - v12 * v12) AS stat FROM (
SELECT n, b1, b2, f * m11 / a1 / a1 AS v11, f * m22 / a2 / a2 AS v22, f * m12 / a1 / a2 AS v12 FROM (
SELECT sum(c) AS n, count(*) / (count(*) - 1.0) * (sum(c) - 1.0) / (sum(c) - {k}.0) AS f, any_value(b1) AS b1, any_value(b2) AS b2, any_value(a1) AS a1, any_value(a2) AS a2,
sum((y1 - b1 * s11 - b2 * s12) ** 2) AS m11, sum((y2 - b1 * s12 - b2 * s22) ** 2) AS m22, sum((y1 - b1 * s11 - b2 * s12) * (y2 - b1 * s12 - b2 * s22)) AS m12 FROM (
SELECT t.*, sum(y1) OVER () / sum(s11) OVER () AS b1, sum(y2) OVER () / sum(s22) OVER () AS b2, sum(s11) OVER () AS a1, sum(s22) OVER () AS a2 FROM (
SELECT state, count(*) AS c, sum(v0 * yv) AS y1, sum(v1 * yv) AS y2, sum(v0 * v0) AS s11, sum(v1 * v1) AS s22, sum(v0 * v1) AS s12 FROM (
SELECT state, v0, v1, {y} AS yv FROM {src}) GROUP BY 1) t)))"""


@query("est9_joint_wald", "n:i stat:f", ssql("w1 w0", WALD_SQL.format(k=2, y="y0", src="(SELECT a.*, b.v2 AS y0 FROM w1 a JOIN w0 b USING (hospital_id, signal_week))"), WALD))
def _(spark, sf):
    model = reg.Regression(cluster_grams(study(spark, sf), ["delta", "x", "pre_mean"], "state", "hospital_id"))
    fit = model.fit("delta", ["x", "pre_mean"])
    return spark.createDataFrame([(fit.n, reg.wald(fit, ["x", "pre_mean"])["stat"])], "n long, stat double")


RANKED = ["x", "pre_mean", "twice", "adm_mean"]
RANK = {"rk": ("study", "SELECT *, x * 2 - pre_mean AS twice FROM study"), "rk0": ("rk", demeaned("rk", [*RANKED, "delta"], "hospital_id", EP)), **orthogonal("rk", "rk0", 5, 3, EP)}


@query("est10_rank_subset", "term:s kept:b within:f4", ssql("rk0 rk1 rk2 rk3", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS term, sum(v{i} * v{i}) > 1e-10 * (SELECT sum(v{i} * v{i}) FROM rk0) AS kept, sum(v{i} * v{i}) AS within FROM rk{i}" for i, c in enumerate(RANKED)), RANK))
def _(spark, sf):
    rows = study(spark, sf).withColumn("twice", F.col("x") * 2 - F.col("pre_mean"))
    model = reg.Regression(cluster_grams(rows, ["delta", *RANKED], "state", "hospital_id"))
    return spark.createDataFrame([(c, k, v) for c, v, k in model.net_variances(RANKED)], "term string, kept boolean, within double")


@query("est11_varying_controls", "control:s kept:b within:f3", ssql("study", """
SELECT control, sqrt(ss) > 1e-6 AS kept, ss AS within FROM (
SELECT 'pre_mean' AS control, sum((v - m) * (v - m)) AS ss FROM (SELECT pre_mean AS v, avg(pre_mean) OVER (PARTITION BY hospital_id) AS m FROM study)
UNION ALL SELECT 'size', sum((v - m) * (v - m)) FROM (SELECT CAST(hospital_id AS DOUBLE) AS v, avg(CAST(hospital_id AS DOUBLE)) OVER (PARTITION BY hospital_id) AS m FROM study))""", {}))
def _(spark, sf):
    rows = study(spark, sf).withColumn("size", F.col("hospital_id").cast("double"))
    model = reg.Regression(cluster_grams(rows, ["delta", "x", "pre_mean", "size"], "state", "hospital_id"))
    kept = model.varying(["pre_mean", "size"])
    net = demean(rows, ["hospital_id"], ["pre_mean", "size"], "_net")
    sums = net.agg(*[F.sum(F.col(f"{c}_net") ** 2).alias(c) for c in ("pre_mean", "size")])
    return sums.unpivot([], ["pre_mean", "size"], "control", "within").withColumn("kept", F.col("control").isin(kept))


# --- expectations from other clusters or folds ------------------------------------------------

EXPAND = {"ex": ("study", "SELECT s.*, g.g, s.state <> g.g AS tr FROM study s, (SELECT DISTINCT state AS g FROM study) g")}
HELD = held_out("h", "ex", "delta", ["pre_mean", "adm_mean"], YEAR_DUMMIES, EP, "g", "tr")


@query("est12_left_out_expectation", "hospital_id:i signal_week:d resid:f", ssql(f"h{len(YEAR_DUMMIES) + 3}", HELD[1], {**EXPAND, **HELD[0]}))
def _(spark, sf):
    rows = expectation.left_out_linear(study(spark, sf), "delta", CONTROLS, ["yr"], "state", "expected")
    return rows.withColumn("resid", F.col("delta") - F.col("expected"))


IMPUTE = {
    **EXPAND,
    "im": ("ex", """SELECT *, coalesce(icu_mean, median(CASE WHEN tr THEN icu_mean END) OVER (PARTITION BY g)) AS icu2,
        coalesce(pre_slope, median(CASE WHEN tr THEN pre_slope END) OVER (PARTITION BY g)) AS slope2 FROM ex"""),
}
IMPUTED = held_out("p", "im", "delta", ["icu2", "slope2", "adm_mean"], YEAR_DUMMIES, EP, "g", "tr")


@query("est13_imputed_expectation", "hospital_id:i signal_week:d resid:f", ssql(f"p{len(YEAR_DUMMIES) + 4}", IMPUTED[1], {**IMPUTE, **IMPUTED[0]}))
def _(spark, sf):
    rows = expectation.left_out_linear_imputed(
        study(spark, sf), "delta", ["icu_mean", "pre_slope", "adm_mean"], ["yr"], "state", "expected")
    return rows.withColumn("resid", F.col("delta") - F.col("expected"))


@query("prj31_fold_medians", "fold:s field:s median:f", ssql("ex", """
SELECT g AS fold, 'icu_mean' AS field, median(icu_mean) AS median FROM ex WHERE tr GROUP BY 1 UNION ALL
SELECT g, 'beds', median(beds) FROM ex WHERE tr GROUP BY 1""", EXPAND))
def _(spark, sf):
    return expectation.left_out_medians(study(spark, sf), ["icu_mean", "beds"], "state").withColumnRenamed("column", "field")


@query("est14_balanced_folds", "hospital_id:i rows:i fold:i", ssql("study", """
SELECT hospital_id, n AS rows, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM (
SELECT hospital_id, n, row_number() OVER (ORDER BY n DESC, md5(CAST(hospital_id AS VARCHAR))) - 1 AS r FROM (SELECT hospital_id, count(*) AS n FROM study GROUP BY 1))""", {}))
def _(spark, sf):
    return folds.balanced_folds(study(spark, sf), "hospital_id", 5)


FOLD_SQL = """SELECT hospital_id, (row_number() OVER (ORDER BY md5(CAST(hospital_id AS VARCHAR) || '_{seed}')) - 1) % 5 AS fold FROM (SELECT DISTINCT hospital_id FROM study)"""


@query("est15_random_folds", "hospital_id:i fold:i", ssql("study", FOLD_SQL.format(seed=7), {}))
def _(spark, sf):
    return folds.random_folds(study(spark, sf), "hospital_id", 5, 7)


NUMERICS = ["pre_mean", "volatility", "adm_mean", "beds"]


def cross_ctes(seed: int, tag: str = "", outcome_seed: int | None = None) -> dict[str, tuple[str, str]]:
    """Cross-fitted linear residuals of exposure and outcome over seeded entity folds."""
    base = {}
    for short, y, own in (("t", "x", seed), ("y", "delta", outcome_seed)):
        split = f"x{tag}" if own is None or short == "t" else f"o{tag}"
        if own is not None:
            base |= {
                f"f{split}_": ("study", FOLD_SQL.format(seed=own)),
                f"f{split}": (f"f{split}_", f"SELECT s.*, g.g, f.fold <> g.g AS tr FROM study s JOIN f{split}_ f USING (hospital_id), (SELECT unnest(range(0, 5)) AS g) g"),
            }
        ctes, body = held_out(f"c{short}{tag}_", f"f{split}", y, NUMERICS, [], EP, "g", "tr")
        base |= ctes
        base[f"r{short}{tag}"] = (f"c{short}{tag}_{len(NUMERICS) + 1}", body)
    base[f"res{tag}"] = (f"rt{tag} ry{tag}", f"""SELECT s.*, a.resid AS tres, b.resid AS yres FROM study s JOIN rt{tag} a USING (hospital_id, signal_week)
        JOIN ry{tag} b USING (hospital_id, signal_week)""")
    return base


CROSS = cross_ctes(7)


def residuals(spark, sf) -> DataFrame:
    rows = study(spark, sf)
    split = folds.with_folds(rows, folds.random_folds(rows, "hospital_id", 5, 7), "hospital_id")
    return suites.linear_residuals(split, {"x": "tres", "delta": "yres"}, NUMERICS, [], "fold")


@query("est18_crossfit_linear", "hospital_id:i signal_week:d tres:f yres:f", ssql("res", "SELECT * FROM res", CROSS))
def _(spark, sf):
    return residuals(spark, sf)


def origin_sql(source: str, y: str, x: str, group: str | None = None) -> str:
    """Slope through the origin with clustered error, per group."""
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""SELECT {g}sum(c) AS n, count(*) AS clusters, any_value(b) AS theta,
sqrt(sum((xy - b * xx) * (xy - b * xx)) * count(*) / (count(*) - 1)) / any_value(sxx) AS se FROM (
SELECT t.*, sum(xy) OVER w / sum(xx) OVER w AS b, sum(xx) OVER w AS sxx FROM (
SELECT {g}state, count(*) AS c, sum({x} * {y}) AS xy, sum({x} * {x}) AS xx FROM {source} GROUP BY {g}state) t
WINDOW w AS ({f'PARTITION BY {group}' if group else ''})) {by}"""


@query("est19_orthogonal_estimate", "n:i entities:i clusters:i theta:f se:f exposure_sd:f outcome_sd:f std_theta:f", ssql("res", f"""
SELECT r.*, d.*, theta * exposure_sd / outcome_sd AS std_theta FROM ({origin_sql('res', 'yres', 'tres')}) r,
(SELECT count(DISTINCT hospital_id) AS entities, stddev_samp(tres) AS exposure_sd, stddev_samp(yres) AS outcome_sd FROM res) d""", CROSS))
def _(spark, sf):
    return dml.slope_through_origin(residuals(spark, sf), "yres", "tres", "state", "hospital_id")


@query("prj36_effect_translation", "effect_per_sd:f low:f high:f", ssql("res", f"""
SELECT 100 * theta * s AS effect_per_sd, 100 * (theta - 1.959963984540054 * se) * s AS low, 100 * (theta + 1.959963984540054 * se) * s AS high
FROM ({origin_sql('res', 'yres', 'tres')}), (SELECT stddev_samp(tres) AS s FROM res)""", CROSS))
def _(spark, sf):
    out = dml.per_sd(dml.slope_through_origin(residuals(spark, sf), "yres", "tres", "state", "hospital_id"), 100.0)
    return out.withColumnsRenamed({"ci_low_per_sd": "low", "ci_high_per_sd": "high"})


@query("est20_support_trimming", "n:i theta:f se:f", ssql("sup", origin_sql("sup", "yres", "tres"), {
    **CROSS, "sup": ("res", "SELECT * FROM res WHERE abs(tres) <= (SELECT quantile_cont(abs(tres), 0.99) FROM res)")}))
def _(spark, sf):
    rows = dml.support(cut_lineage(residuals(spark, sf)), "tres", 0.99)
    return dml.slope_through_origin(rows, "yres", "tres", "state", "hospital_id")


FALSE = {**CROSS}
for _y in ("pre_mean", "volatility"):
    _c, _b = held_out(f"f{_y}", "fx", _y, [c for c in NUMERICS if c != _y], [], EP, "g", "tr")
    FALSE |= _c
    FALSE[f"r{_y}"] = (f"f{_y}{len(NUMERICS)}", _b)
    FALSE[f"z{_y}"] = (f"r{_y} res", f"SELECT s.state, s.tres, r.resid AS yres FROM res s JOIN r{_y} r USING (hospital_id, signal_week)")


@query("est21_falsification", "outcome:s n:i theta:f se:f", ssql("zpre_mean zvolatility", "\nUNION ALL\n".join(
    f"SELECT '{y}' AS outcome, n, theta, se FROM ({origin_sql('z' + y, 'yres', 'tres')})" for y in ("pre_mean", "volatility")), FALSE))
def _(spark, sf):
    rows = cut_lineage(residuals(spark, sf))
    return suites.falsification(rows, ["pre_mean", "volatility"], "tres", NUMERICS, [], "fold", "state", "hospital_id", exclude_outcome=True)


LONG = {**CROSS, "long": ("res", "\nUNION ALL\n".join(
    f"SELECT state, '{c}' AS covariate, ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z, tres, yres FROM res WHERE {c} IS NOT NULL"
    for c in ("pre_mean", "volatility", "icu_mean")))}


@query("est22_residual_balance", "covariate:s n:i coef_per_sd:f se:f", ssql("long", f"""
SELECT covariate, n, theta AS coef_per_sd, se FROM ({origin_sql('long', 'tres', 'z', 'covariate')})""", LONG))
def _(spark, sf):
    return dml.balance(residuals(spark, sf), ["pre_mean", "volatility", "icu_mean"], ["tres"], "state", "hospital_id")


@query("est23_covariate_benchmark", "response:s covariate:s n:i coef_per_sd:f se:f", ssql("long", "\nUNION ALL\n".join(
    f"SELECT '{y}' AS response, covariate, n, theta AS coef_per_sd, se FROM ({origin_sql('long', y, 'z', 'covariate')})" for y in ("tres", "yres")), LONG))
def _(spark, sf):
    return dml.balance(residuals(spark, sf), ["pre_mean", "volatility", "icu_mean"], ["tres", "yres"], "state", "hospital_id")


MECH = {**CROSS,
        "k0": ("res", "SELECT state, hospital_id, yres, tres, adm, " + ", ".join(f"{c}" for c in ("pre_mean", "yr")) + " FROM res"),
        "ka0": ("k0", demeaned("k0", [*YEAR_DUMMIES, "pre_mean", "tres", "adm"], None, ["state", "yres"])),
        **orthogonal("ka", "ka0", 16, 13, ["state", "yres"])}
MECH["kb"] = ("ka13", "SELECT state, yres, v13 AS c, v14 AS t, v15 AS m FROM ka13")
MECH |= {"kc0": ("kb", demeaned("kb", ["c", "t", "m"], None, ["state"])), **orthogonal("kc", "kc0", 3, 1, ["state"]),
         "kd0": ("kb", demeaned("kb", ["t", "m", "yres"], None, ["state"])), **orthogonal("kd", "kd0", 3, 1, ["state"])}


@query("est24_mechanism", "n:i a:f a_se:f b:f b_se:f product:f total:f fraction:f", ssql("kc1 kd1", f"""
SELECT a.n, a.coef AS a, a.se AS a_se, b.coef AS b, b.se AS b_se, a.coef * b.coef AS product, t.theta AS total, a.coef * b.coef / t.theta AS fraction
FROM ({slope('kc1', 1, 2, 'state', 2)}) a, ({slope('kd1', 1, 2, 'state', 2)}) b, ({origin_sql('kb', 'yres', 't')}) t""", MECH))
def _(spark, sf):
    return suites.mechanism(residuals(spark, sf), ["adm"], "tres", "yres", ["pre_mean"], "state", "yr", "hospital_id", min_rows=50)


HET = {**CROSS, "h0": ("res", "SELECT state, tres AS v0, tres * (pre_mean - avg(pre_mean) OVER ()) / stddev_samp(pre_mean) OVER () AS v1, yres AS v2 FROM res"),
       **orthogonal("h", "h0", 3, 1, ["state"]),
       "hr0": ("h0", "SELECT state, v1 AS v0, v0 AS v1, v2 FROM h0"), **orthogonal("hr", "hr0", 3, 1, ["state"])}


@query("est25_continuous_heterogeneity", "modifier:s n:i theta:f interaction:f interaction_se:f theta_low:f theta_high:f", ssql("h1 hr1", f"""
SELECT 'pre_mean' AS modifier, i.n, m.coef AS theta, i.coef AS interaction, i.se AS interaction_se, m.coef - i.coef AS theta_low, m.coef + i.coef AS theta_high
FROM ({slope('h1', 1, 2, 'state', 2)}) i, ({slope('hr1', 1, 2, 'state', 2)}) m""", HET))
def _(spark, sf):
    return suites.continuous_heterogeneity(residuals(spark, sf), ["pre_mean"], "tres", "yres", "state")


CAT = {**CROSS, "big": ("res", "SELECT state, hospital_id, signal_week, tres, yres, CASE WHEN yr < '1997' THEN 'early' WHEN yr < '1999' THEN 'mid' ELSE 'recent' END AS era FROM res"),
       "cj0": ("big", demeaned("big", ["tres", "CASE WHEN era = 'mid' THEN tres ELSE 0 END", "CASE WHEN era = 'recent' THEN tres ELSE 0 END", "yres"], None, ["state", *EP])),
       **orthogonal("cj", "cj0", 4, 2, ["state", *EP])}
CAT_JOINT = WALD_SQL.format(k=3, y="y0", src="(SELECT a.state, a.v1 AS v0, a.v2 AS v1, b.v3 AS y0 FROM cj2 a JOIN cj1 b USING (hospital_id, signal_week))")


@query("est26_categorical_heterogeneity", "level:s n:i theta:f joint_stat:f5", ssql("big cj1 cj2", f"""
SELECT era AS level, (SELECT count(*) FROM big) AS n, sum(tres * yres) / sum(tres * tres) AS theta, any_value(j.stat) AS joint_stat FROM big, ({CAT_JOINT}) j GROUP BY 1""", CAT))
def _(spark, sf):
    era = F.when(F.col("yr") < "1997", "early").when(F.col("yr") < "1999", "mid").otherwise("recent")
    return suites.categorical_heterogeneity(residuals(spark, sf).withColumn("era", era), "era", "tres", "yres", "state")


SENS = f"SELECT *, theta / se AS stat, clusters - 1.0 AS dof FROM ({origin_sql('res', 'yres', 'tres')})"


@query("est27_partial_r2", "partial_r2:f equal_strength:f", ssql("res", f"""
SELECT stat * stat / (stat * stat + dof) AS partial_r2, (sqrt((stat * stat / dof) ** 2 + 4 * stat * stat / dof) - stat * stat / dof) / 2 AS equal_strength FROM ({SENS})""", CROSS))
def _(spark, sf):
    out = dml.slope_through_origin(residuals(spark, sf), "yres", "tres", "state", "hospital_id")
    dof = (F.col("clusters") - 1).cast("double")
    return out.select(dml.partial_r2(F.col("stat"), dof).alias("partial_r2"), dml.equal_strength(F.col("stat"), dof).alias("equal_strength"))


@query("est28_robustness_value", "rv:f rv_extreme:f rv_half:f", ssql("res", f"""
SELECT CASE WHEN f < 1e-15 THEN 0 ELSE 2 / (1 + sqrt(1 + 4 / (f * f))) END AS rv, f * f / (1 + f * f) AS rv_extreme,
2 / (1 + sqrt(1 + 16 / (f * f))) AS rv_half FROM (SELECT abs(stat) / sqrt(dof) AS f FROM ({SENS}))""", CROSS))
def _(spark, sf):
    out = dml.slope_through_origin(residuals(spark, sf), "yres", "tres", "state", "hospital_id")
    out = out.withColumn("dof", (F.col("clusters") - 1).cast("double"))
    return dml.robustness(dml.robustness(out, 1.0, 1.0, prefix="rv"), 0.5, 1.0, prefix="rv_half")


#: Two-sided 5 % quantiles of Student's t by degrees of freedom.
T05 = {10: 2.228138851964939, 15: 2.131449545559323, 20: 2.085963447265837, 21: 2.079613844727662, 22: 2.073873067904015, 23: 2.068657610419041, 24: 2.063898561628021}


@query("est28_robustness_value_alpha", "rv05:f rv05_extreme:f", ssql("res", f"""
SELECT CASE WHEN f < c THEN 0 WHEN f > 1 / c THEN extreme ELSE 2 / (1 + sqrt(1 + 4 / ((f - c) * (f - c)))) END AS rv05, extreme AS rv05_extreme FROM (
SELECT *, CASE WHEN f <= c THEN 0 ELSE (f * f - c * c) / (1 + f * f) END AS extreme FROM (
SELECT abs(stat) / sqrt(dof) AS f, CASE CAST(dof - 1 AS INT) {' '.join(f'WHEN {d} THEN {t}' for d, t in T05.items())} END / sqrt(dof - 1) AS c FROM ({SENS})))""", CROSS))
def _(spark, sf):
    out = dml.slope_through_origin(residuals(spark, sf), "yres", "tres", "state", "hospital_id")
    return dml.robustness(out.withColumn("dof", (F.col("clusters") - 1).cast("double")), 1.0, 0.05, prefix="rv05")


SEEDS, PLR_SEEDS = range(1, 21), range(1, 11)
REPEAT = {k: v for s in SEEDS for k, v in cross_ctes(s, f"r{s}", s + suites.OUTCOME_SEED).items()}


def repeats_sql(seeds) -> str:
    return "\nUNION ALL\n".join(f"""SELECT {s} AS seed, n, theta, se, exposure_r2, outcome_r2 FROM ({origin_sql(f'resr{s}', 'yres', 'tres')}),
(SELECT 1 - sum(tres * tres) / regr_syy(x, x) AS exposure_r2, 1 - sum(yres * yres) / regr_syy(delta, delta) AS outcome_r2 FROM resr{s})""" for s in seeds)


def repeats(spark, sf, seeds):
    return suites.repeated_estimates(study(spark, sf), "x", "delta", NUMERICS, [], "state", "hospital_id", list(seeds))


def result_names(seeds) -> str:
    return " ".join(f"resr{s}" for s in seeds)


@query("est29_repeated_crossfit", "seed:i n:i theta:f se:f exposure_r2:f outcome_r2:f", ssql(result_names(SEEDS), repeats_sql(SEEDS), REPEAT))
def _(spark, sf):
    return repeats(spark, sf, SEEDS)


@query("est30_partially_linear", "theta:f se:f", ssql(result_names(PLR_SEEDS), f"""
WITH r AS ({repeats_sql(PLR_SEEDS)}), m AS (SELECT median(theta) AS t FROM r)
SELECT any_value(t) AS theta, sqrt(median(se * se + (theta - t) ** 2)) AS se FROM r, m""".replace("WITH r", "SELECT * FROM (WITH r") + ")", REPEAT))
def _(spark, sf):
    return suites.partially_linear(repeats(spark, sf, PLR_SEEDS))


# --- event studies and change models ----------------------------------------------------------


def event_rows(spark, sf) -> DataFrame:
    panel = cut_lineage(facility_week(spark, sf))
    rows = panels.event_time_panel(panels.hospital_surges(panel), panels.with_ratios(panel), ["signal_rel_change"])
    return cut_lineage(rows.withColumnRenamed("signal_rel_change", "x").withColumn("month", F.date_format("calendar_week", "yyyy-MM")))


EVENT_WEEKS = [k for k in range(-4, 7) if k != -1]
EVENT = {
    "ev": ("ew epi", """SELECT ew.hospital_id, ew.state, ew.signal_week, CAST(ew.hospital_id AS VARCHAR) || '_' || CAST(ew.signal_week AS VARCHAR) AS ep,
        event_week, occupancy, e.signal_rel_change AS x, CAST(year(week) AS VARCHAR) AS cy FROM ew JOIN epi e USING (hospital_id, signal_week) WHERE occupancy IS NOT NULL"""),
}


def event_parts() -> tuple[dict, str, str]:
    ctes, names, selects = dict(EVENT), [], []
    fixed = [f"CASE WHEN cy = '{y}' THEN 1 ELSE 0 END" for y in YEARS] + [f"CASE WHEN event_week = {k} THEN 1 ELSE 0 END" for k in EVENT_WEEKS]
    for target in EVENT_WEEKS:
        others = [f"CASE WHEN event_week = {k} THEN x ELSE 0 END" for k in EVENT_WEEKS if k != target]
        tag = f"e{target + 9}_"
        part, body = regression(tag, "ev", "occupancy", f"CASE WHEN event_week = {target} THEN x ELSE 0 END", others, fixed, "ep", "state")
        ctes |= part
        names.append(f"{tag}{len(fixed) + len(others)}")
        selects.append(f"SELECT {target} AS event_week, n, clusters, coef, se FROM ({body})")
    return ctes, " ".join(names), "\nUNION ALL\n".join(selects)


EVENT_CTES, EVENT_NAMES, EVENT_SQL = event_parts()


def study_of_events(spark, sf, factors=("cy", "event_week")):
    rows = event_rows(spark, sf).withColumn("cy", F.year("calendar_week").cast("string"))
    return suites.event_study(rows, "occupancy", "x", "episode_id", "state", list(factors))


@query("est31_event_study", "event_week:i n:i clusters:i coef:f se:f", ssql(EVENT_NAMES, EVENT_SQL, EVENT_CTES))
def _(spark, sf):
    return study_of_events(spark, sf).coefficients().where(F.col("event_week") != -1)


@query("est31_event_study_weeks", "event_week:i coef:f se:f")
def _(spark, sf):
    return study_of_events(spark, sf, ("calendar_week", "event_week")).coefficients()


@query("est31_joint_tests", "test:s stat:f p_value:f")
def _(spark, sf):
    fit = study_of_events(spark, sf)
    rows = [(n, *(fit.joint(w)[k] for k in ("stat", "p_value"))) for n, w in (("pre", (-4, -3, -2)), ("post", (2, 3, 4)))]
    return spark.createDataFrame(rows, "test string, stat double, p_value double")


@query("est8_average_bootstrap", "reps_valid:i observed_effect:f p_value:f")
def _(spark, sf):
    found, _ = study_of_events(spark, sf).average_bootstrap(reps=REPS)
    return spark.createDataFrame([{k: float(v) for k, v in found.items()}])


CHANGE = regression("ch", "study", "delta", "x", [], YEAR_DUMMIES, "hospital_id", "state")


@query("est32_change_model", "n:i clusters:i coef:f se:f", ssql(f"ch{len(YEAR_DUMMIES)}", CHANGE[1], CHANGE[0]))
def _(spark, sf):
    return fit_frame(spark, reg.panel_regression(study(spark, sf), "delta", "x", [], "state", "hospital_id", ["yr"])[1])


def spline_sql(i: int, d: int) -> str | None:
    names = ["lo"] * 4 + ["mid"] + ["hi"] * 4
    if d == 0:
        if names[i] == names[i + 1]:
            return None
        return f"(CASE WHEN x >= {names[i]} AND x {'<=' if names[i + 1] == 'hi' else '<'} {names[i + 1]} THEN 1.0 ELSE 0.0 END)"
    parts = []
    for j, a, b in ((i, names[i], names[i + d]), (i + 1, names[i + d + 1], names[i + 1])):
        inner = spline_sql(j, d - 1)
        if inner and a != b:
            parts.append(f"(x - {a}) / ({b} - {a}) * {inner}")
    return f"({' + '.join(parts)})" if parts else None


@query("prj34_spline_basis", "hospital_id:i signal_week:d spline_1:f spline_2:f spline_3:f spline_4:f", ssql("study", f"""
SELECT hospital_id, signal_week, {', '.join(f'{spline_sql(i, 3)} AS spline_{i}' for i in range(1, 5))} FROM study, (SELECT min(x) AS lo, quantile_cont(x, 0.5) AS mid, max(x) AS hi FROM study)""", {}))
def _(spark, sf):
    return spline_basis(study(spark, sf), "x")[0]


@query("est33_spline_test", "n:i dof:i stat:f")
def _(spark, sf):
    found = suites.spline_test(study(spark, sf), "delta", "x", "state", "hospital_id", ["yr"])
    return spark.createDataFrame([(found["n"], found["dof"], found["stat"])], "n long, dof long, stat double")


PRETREND = {y: regression(f"pt{y}", "study", y, "x", [], [], "hospital_id", "state") for y in ("pre_mean", "volatility", "adm_mean")}


@query("est34_pretrend_checks", "outcome:s n:i coef:f se:f", ssql(" ".join(f"pt{y}0" for y in PRETREND), "\nUNION ALL\n".join(
    f"SELECT '{y}' AS outcome, n, coef, se FROM ({p[1]})" for y, p in PRETREND.items()), reduce(lambda a, b: {**a, **b}, [p[0] for p in PRETREND.values()])))
def _(spark, sf):
    return suites.outcome_checks(study(spark, sf), list(PRETREND), "x", "state", "hospital_id", [])


POSTLEVEL = regression("pl", "study", "delta + pre_mean", "x", ["pre_mean"], [], "hospital_id", "state")


@query("est35_post_level", "n:i coef:f se:f", ssql("pl1", POSTLEVEL[1], POSTLEVEL[0]))
def _(spark, sf):
    rows = study(spark, sf).withColumn("post", F.col("delta") + F.col("pre_mean"))
    return fit_frame(spark, reg.panel_regression(rows, "post", "x", ["pre_mean"], "state", "hospital_id")[1])


PLACEBO = regression("pb", "study", "delta", "base", ["adm_mean"], [], "hospital_id", "state")


@query("est36_placebo_exposure", "n:i coef:f se:f", ssql("pb1", PLACEBO[1], PLACEBO[0]))
def _(spark, sf):
    return fit_frame(spark, reg.panel_regression(study(spark, sf), "delta", "base", ["adm_mean"], "state", "hospital_id")[1])


WINDOWS = {"w1_2": (1, 2), "w3_4": (3, 4), "w5_6": (5, 6)}
EXPOSURES = {"relative": "e.signal_rel_change", "absolute": "e.signal_admissions - e.baseline_admissions"}
SIGNS = {"wn": ("ew epi", f"""SELECT ew.hospital_id, ew.signal_week, {', '.join(f'any_value({x}) AS {n}' for n, x in EXPOSURES.items())},
    avg(occupancy) FILTER (event_week BETWEEN -4 AND -2) AS pre, {', '.join(f'avg(occupancy) FILTER (event_week BETWEEN {a} AND {b}) AS {w}' for w, (a, b) in WINDOWS.items())}
    FROM ew JOIN epi e USING (hospital_id, signal_week) GROUP BY 1, 2""")}


def sign_sql(value: str) -> str:
    return f"CASE WHEN sum({value}) < 0 THEN 'negative' WHEN sum({value}) > 0 THEN 'positive' WHEN sum({value}) = 0 THEN 'zero' END"


@query("est37_sign_pattern", "exposure:s weeks:s change:s log_change:s", ssql("wn", "\nUNION ALL\n".join(
    f"SELECT '{n}' AS exposure, '{w}' AS weeks, {sign_sql(f'{n} * ({w} - pre)')} AS change, {sign_sql(f'{n} * CASE WHEN {w} > 0 AND pre > 0 THEN ln({w} / pre) END')} AS log_change FROM wn"
    for n in EXPOSURES for w in WINDOWS), SIGNS))
def _(spark, sf):
    panel = cut_lineage(facility_week(spark, sf))
    rows = panels.event_time_panel(panels.hospital_surges(panel), panels.with_ratios(panel), ["signal_rel_change", "signal_admissions", "baseline_admissions"])
    within = lambda a, b: F.avg(F.when(F.col("event_week").between(a, b), F.col("occupancy")))
    wide = rows.groupBy(*EP, "state", F.col("signal_rel_change").alias("relative"), (F.col("signal_admissions") - F.col("baseline_admissions")).alias("absolute")).agg(
        within(-4, -2).alias("pre"), *[within(*ab).alias(w) for w, ab in WINDOWS.items()])
    pre = F.col("pre")
    outcomes = lambda w: {"change": F.col(w) - pre, "log_change": F.when((F.col(w) > 0) & (pre > 0), F.ln(F.col(w) / pre))}
    cells = F.array(*[F.struct(F.lit(n).alias("exposure"), F.lit(w).alias("weeks"), F.lit(o).alias("outcome"), F.col(n).cast("double").alias("t"), y.alias("y"))
                      for n in EXPOSURES for w in WINDOWS for o, y in outcomes(w).items()])
    found = dml.slope_through_origin(wide.select(*EP, "state", F.inline(cells)), "y", "t", "state", "hospital_id", ["exposure", "weeks", "outcome"])
    return dml.sign_pattern(found, ["exposure", "weeks"], "outcome", ["change", "log_change"])


@query("est38_reference_difference", "theta:f difference:f relative_difference:f", ssql("res", f"""
SELECT theta, theta + 0.0035222953999 AS difference, (theta + 0.0035222953999) / -0.0035222953999 AS relative_difference FROM ({origin_sql('res', 'yres', 'tres')})""", CROSS))
def _(spark, sf):
    out = dml.slope_through_origin(residuals(spark, sf), "yres", "tres", "state", "hospital_id")
    return dml.against_reference(out, -0.0035222953999)


# --- innovations ------------------------------------------------------------------------------

INNO = {
    **EXPAND,
    "inn": ("q", """SELECT hospital_id, state, signal_week, 100 * ln((w1 + w2) / 2 / bcap) AS post, 100 * ln(signal_admissions / baseline_admissions) AS pre,
        dem_pp, bcap, bdem, signal_admissions AS adm, CAST(year(signal_week) AS VARCHAR) AS yr FROM q WHERE ok AND (w1 + w2) > 0 AND baseline_admissions > 0"""),
    "inx": ("inn", "SELECT s.*, g.g, s.state <> g.g AS tr FROM inn s, (SELECT DISTINCT state AS g FROM inn) g"),
}
IN_POST = held_out("ip", "inx", "post", ["dem_pp", "bcap"], YEAR_DUMMIES, EP, "g", "tr")
IN_PRE = held_out("iq", "inx", "pre", ["bdem"], YEAR_DUMMIES, EP, "g", "tr")
INNO |= {**IN_POST[0], **IN_PRE[0], "ipr": (f"ip{len(YEAR_DUMMIES) + 3}", IN_POST[1]), "iqr": (f"iq{len(YEAR_DUMMIES) + 2}", IN_PRE[1])}


def quality_rows(spark, sf) -> DataFrame:
    panel = cut_lineage(facility_week(spark, sf))
    audit = panels.quality_audit(panels.hospital_surges(panel), panel).where("objective_quality_ok")
    rows = panels.log_responses(audit).withColumn("pre", 100 * F.ln(F.col("signal_admissions") / F.col("baseline_admissions")))
    return cut_lineage(rows.where(F.col("post_log_capacity_change").isNotNull() & F.col("pre").isNotNull()).withColumn("yr", F.year("signal_week").cast("string")))


@query("pipe4_response_innovation", "hospital_id:i signal_week:d post_resid:f5 pre_resid:f5 innovation:f5", ssql("ipr iqr", """
SELECT hospital_id, signal_week, a.resid AS post_resid, b.resid AS pre_resid, a.resid - b.resid AS innovation FROM ipr a JOIN iqr b USING (hospital_id, signal_week)""", INNO))
def _(spark, sf):
    out = panels.response_innovation(
        quality_rows(spark, sf), "post_log_capacity_change", "pre",
        ["sustained_demand_change_w1_2_pp", "baseline_capacity_quality"], ["baseline_demand_quality"], ["yr"], min_train=50)
    return out.withColumnsRenamed({"post_log_capacity_change_residual": "post_resid", "pre_residual": "pre_resid", "response_innovation": "innovation"})


IN_ONLY = held_out("io", "inx", "pre", ["bdem", "adm"], YEAR_DUMMIES, EP, "g", "tr")


@query("pipe5_preonly_innovation", "hospital_id:i signal_week:d innovation:f5", ssql(f"io{len(YEAR_DUMMIES) + 3}", f"""
SELECT hospital_id, signal_week, resid AS innovation FROM ({IN_ONLY[1]})""", {**INNO, **IN_ONLY[0]}))
def _(spark, sf):
    out = panels.preonly_innovation(quality_rows(spark, sf), "pre", ["baseline_demand_quality", "signal_admissions"], ["yr"])
    return out.withColumnRenamed("preonly_innovation", "innovation")


SUITE_SQL = f"""
SELECT 'main' AS part, n, theta, se FROM ({origin_sql('res', 'yres', 'tres')}) UNION ALL SELECT 'support', n, theta, se FROM ({origin_sql('sup99', 'yres', 'tres')})
UNION ALL SELECT 'balance ' || covariate, n, theta, se FROM ({origin_sql('long', 'tres', 'z', 'covariate')})
UNION ALL SELECT 'falsification pre_mean', n, theta, se FROM ({origin_sql('zpre_mean', 'yres', 'tres')})
UNION ALL SELECT 'falsification volatility', n, theta, se FROM ({origin_sql('zvolatility', 'yres', 'tres')})
UNION ALL SELECT 'nuisance x', count(*), 1 - sum(tres * tres) / regr_syy(x, x), sqrt(avg(tres * tres)) FROM res WHERE tres IS NOT NULL
UNION ALL SELECT 'nuisance delta', count(*), 1 - sum(yres * yres) / regr_syy(delta, delta), sqrt(avg(yres * yres)) FROM res WHERE yres IS NOT NULL
UNION ALL SELECT 'overlap ' || p, NULL, any_value(c), avg(CASE WHEN abs(tres) <= c THEN 1.0 ELSE 0.0 END) FROM res,
(SELECT '50' AS p, quantile_cont(abs(tres), 0.5) AS c FROM res UNION ALL SELECT '90', quantile_cont(abs(tres), 0.9) FROM res UNION ALL SELECT '95', quantile_cont(abs(tres), 0.95) FROM res
UNION ALL SELECT '99', quantile_cont(abs(tres), 0.99) FROM res) WHERE tres IS NOT NULL GROUP BY p"""


@query("pipe16_orthogonal_suite", "part:s n:i theta:f se:f5", ssql("sup99 res long zpre_mean zvolatility", SUITE_SQL, {
    **FALSE, **LONG, "sup99": ("res", "SELECT * FROM res WHERE abs(tres) <= (SELECT quantile_cont(abs(tres), 0.99) FROM res)")}))
def _(spark, sf):
    parts = suites.orthogonal_suite(
        cut_lineage(residuals(spark, sf)), "tres", "yres", "state", "hospital_id", ["pre_mean", "volatility", "icu_mean"],
        outcomes=["pre_mean", "volatility"], numerics=NUMERICS, nuisance={"x": "tres_hat", "delta": "yres_hat"})
    rows = [
        *[parts[k].select(F.lit(k).alias("part"), "n", "theta", "se") for k in ("main", "support")],
        parts["balance"].select(F.concat(F.lit("balance "), "covariate").alias("part"), "n", F.col("coef_per_sd").alias("theta"), "se"),
        parts["falsification"].select(F.concat(F.lit("falsification "), "outcome").alias("part"), "n", "theta", "se"),
        parts["nuisance"].select(F.concat(F.lit("nuisance "), "target").alias("part"), "n", F.col("r2").alias("theta"), F.col("rmse").alias("se")),
        parts["overlap"].select(
            F.concat(F.lit("overlap "), F.round(F.col("prob") * 100).cast("int").cast("string")).alias("part"), F.lit(None).cast("long").alias("n"),
            F.col("cutoff").alias("theta"), F.col("keep_fraction").alias("se")),
    ]
    return reduce(DataFrame.unionByName, rows)


# --- learners (no SQL counterpart: trees) -----------------------------------------------------


def tree_rows(spark, sf, k=5):
    return cut_lineage(suites.with_balanced_folds(study(spark, sf), "hospital_id", k))


@query("est16_crossfit_forest", "n:i theta:f se:f")
def _(spark, sf):
    res = suites.tree_residuals(tree_rows(spark, sf), {"x": "tres", "delta": "yres"}, [*NUMERICS, "icu_mean"], ["kind", "yr"], "fold", forest(seed=11))
    return dml.slope_through_origin(res, "yres", "tres", "state", "hospital_id")


@query("est17_crossfit_boosted", "n:i r2:f rmse:f")
def _(spark, sf):
    res = suites.tree_residuals(tree_rows(spark, sf), {"delta": "yres"}, NUMERICS, [], "fold", boosted())
    return suites.nuisance_quality(res, {"delta": "yres_hat"})


def forest_repeats(spark, sf, seeds, trees):
    return suites.repeated_tree_estimates(study(spark, sf), "x", "delta", [*NUMERICS, "icu_mean"], ["kind", "yr"], "state", "hospital_id", list(seeds), forest(trees, seed=11))


@query("est29_repeated_forest", "seed:i n:i theta:f se:f exposure_r2:f outcome_r2:f")
def _(spark, sf):
    return forest_repeats(spark, sf, SEEDS, 300)


@query("est30_partially_linear_forest", "theta:f se:f")
def _(spark, sf):
    return suites.partially_linear(forest_repeats(spark, sf, PLR_SEEDS, 400))


@query("est21_falsification_boosted", "outcome:s n:i theta:f se:f")
def _(spark, sf):
    rows = tree_rows(spark, sf)
    rows = cut_lineage(suites.tree_residuals(rows, {"x": "tres"}, NUMERICS, ["yr"], "fold", boosted()))
    return suites.falsification(rows, ["pre_mean", "volatility"], "tres", NUMERICS, ["yr"], "fold", "state", "hospital_id", exclude_outcome=True, learner=boosted())


@query("est14_fold_sizes", "fold:i test_n:i train_n:i test_entities:i train_entities:i", ssql("study", """
SELECT fold, sum(n) AS test_n, (SELECT count(*) FROM study) - sum(n) AS train_n, count(*) AS test_entities,
(SELECT count(DISTINCT hospital_id) FROM study) - count(*) AS train_entities FROM (
SELECT n, CASE WHEN (r // 3) % 2 = 0 THEN r % 3 ELSE 2 - r % 3 END AS fold FROM (
SELECT n, row_number() OVER (ORDER BY n DESC, md5(CAST(hospital_id AS VARCHAR))) - 1 AS r FROM (SELECT hospital_id, count(*) AS n FROM study GROUP BY 1))) GROUP BY 1""", {}))
def _(spark, sf):
    return fold_sizes(tree_rows(spark, sf, 3), "fold", "hospital_id")
