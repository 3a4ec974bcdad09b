"""Estimation suites: event studies, mechanisms, heterogeneity, cross-fitted estimates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from crestline.operators.splines import spline_basis
from crestline.operators.aggregates import fit_quality, replicate_summary
from crestline.operators.expectation import left_out_linear
from crestline.operators.folds import balanced_folds, fold_lists, with_folds
from crestline.operators.gram import cluster_grams
from crestline.operators.joins import week_scaffold
from crestline.operators.moments import MomentStore, Side
from crestline.operators.quantiles import exact_quantiles
from crestline.operators.orthogonal import (
    balance, median_of_repetitions, per_sd, slope_through_origin, support,
)
from crestline.operators.regression import Fit, Regression, absorb, estimates_frame, wald
from crestline.operators.trees import Ensemble, Model, crossfit_trees
from crestline.operators.windows import collapse_rare, zscore
from crestline.session import cut_lineage

PRE_WEEKS, POST_WEEKS = (-4, -3, -2), (2, 3, 4)


def event_interactions(
    rows: DataFrame, exposure: str, weeks: Sequence[int] = tuple(range(-4, 7)), reference: int = -1
) -> tuple[DataFrame, dict[int, str]]:
    """Exposure times event-week indicators, without the reference week."""
    names = {k: f"x_event_{'m' if k < 0 else 'p'}{abs(k)}" for k in weeks if k != reference}
    made = {n: F.when(F.col("event_week") == k, F.col(exposure)).otherwise(F.lit(0.0)) for k, n in names.items()}
    return rows.where(F.col("event_week").isin(*weeks)).withColumns(made), names


@dataclass
class EventStudy:
    model: Regression
    fit: Fit
    outcome: str
    names: dict[int, str]
    weeks: tuple[int, ...]
    reference: int

    def coefficients(self) -> DataFrame:
        """Every event week in order; the reference week is 0 with no error."""
        spark = self.model.grams.table.sparkSession
        week = {n: k for k, n in self.names.items()}
        rows = estimates_frame(spark, [self.fit])
        table = F.create_map(*[F.lit(x) for n, k in week.items() for x in (n, k)])
        found = rows.select(table[F.col("term")].alias("event_week"), "n", "clusters", "coef", "se", "p_value", "ci_low", "ci_high")
        return week_scaffold(found, "event_week", self.weeks[0], self.weeks[-1], self.reference, ["coef", "ci_low", "ci_high"])

    def joint(self, weeks: Sequence[int]) -> dict[str, float]:
        return wald(self.fit, [self.names[k] for k in weeks])

    def average_bootstrap(self, weeks: Sequence[int] = POST_WEEKS, reps: int = 999, signs=None) -> tuple[dict, np.ndarray]:
        """Wild bootstrap of the mean effect over the weeks, the weeks left out under the null."""
        return self.model.wild_bootstrap(
            self.outcome, self.fit.regressors, tested=[self.names[k] for k in weeks], reps=reps, signs=signs
        )


def event_study(
    rows: DataFrame, outcome: str, exposure: str, entity: str, cluster: str,
    factors: Sequence[str] = ("calendar_week", "event_week"),
    weeks: Sequence[int] = tuple(range(-4, 7)), reference: int = -1, cohort: str | None = None,
) -> EventStudy:
    """Exposure by event week with entity, calendar-week and event-week effects.

    With ``cohort``, rows without outcome go first and then cohorts left without treated or control units.
    """
    made, names = event_interactions(rows, exposure, weeks, reference)
    made = made.dropna(subset=[outcome, exposure])
    if cohort:
        made = valid_cohorts(cut_lineage(made), cohort, exposure)
    model = Regression(cluster_grams(made, [outcome, *names.values()], cluster, entity, factors))
    if model.rank(list(names.values())) < len(names):
        raise ValueError("the event-week interactions are not of full rank after absorption")
    fit = model.fit(outcome, list(names.values()), "event_study")
    return EventStudy(model, fit, outcome, names, tuple(weeks), reference)


def valid_cohorts(rows: DataFrame, cohort: str = "cohort_id", treated: str = "treated") -> DataFrame:
    """Rows of cohorts that hold treated and control units."""
    spans = rows.groupBy(cohort).agg(F.min(treated).alias("lo"), F.max(treated).alias("hi"))
    return rows.join(spans.where("lo = 0 AND hi = 1").select(cohort), cohort, "left_semi")


def spline_test(df: DataFrame, outcome: str, exposure: str, cluster: str, entity: str, factors: Sequence[str]) -> dict:
    """Global test of a cubic spline in the exposure; dependent basis columns are dropped."""
    based, names = spline_basis(df.dropna(subset=[outcome, exposure, cluster, entity, *factors]), exposure)
    model = Regression(cluster_grams(based, [outcome, *names], cluster, entity, factors))
    kept = model.full_rank_subset(names)
    fit = model.fit(outcome, kept, "spline")
    return {**wald(fit, kept), "kept": kept, "n": fit.n, "clusters": fit.clusters}


def outcome_checks(
    df: DataFrame, outcomes: Sequence[str], exposure: str, cluster: str, entity: str, factors: Sequence[str],
    controls: Sequence[str] = (),
) -> DataFrame:
    """The same model over a list of outcomes (pre-trend and placebo checks), each on its own rows."""
    fits = []
    for y in outcomes:
        model = Regression(cluster_grams(df, [y, exposure, *controls], cluster, entity, factors), spec=y)
        fits.append(model.fit(y, [exposure, *controls], "check"))
    return estimates_frame(df.sparkSession, fits, exposure_only=True)


def mechanism(
    df: DataFrame, mediators: Sequence[str], t: str, y: str, controls: Sequence[str], cluster: str, factor: str, entity: str,
    min_rows: int = 500,
) -> DataFrame:
    """Exposure-to-mediator and mediator-to-outcome paths, their product and share of the total."""
    spark, rows = df.sparkSession, []
    for m in mediators:
        use = df.dropna(subset=[m, t, y, cluster, factor, *controls])
        if use.limit(min_rows).count() < min_rows:
            continue
        net = absorb(use, [m, t, *controls], cluster, None, [factor])
        names = [f"{m}_abs", f"{t}_abs", *[f"{c}_abs" for c in controls]]
        model = Regression(cluster_grams(net, [y, *names], cluster))
        fits = model.fits({
            "a": (f"{m}_abs", [f"{t}_abs", *names[2:]]), "b": (y, [f"{t}_abs", f"{m}_abs"]), "total": (y, [f"{t}_abs"]),
        })
        a, b, total = fits["a"], fits["b"], fits["total"]
        product, theta = float(a.beta[0] * b.beta[1]), float(total.beta[0])
        rows.append((m, a.n, a.clusters, float(a.beta[0]), float(a.se[0]), float(b.beta[1]), float(b.se[1]), product, theta,
                     product / theta if abs(theta) > 1e-12 else None))
    return spark.createDataFrame(
        rows, "mediator string, n long, clusters long, a double, a_se double, b double, b_se double, product double, "
              "total double, fraction double")


def continuous_heterogeneity(df: DataFrame, modifiers: Sequence[str], t: str, y: str, cluster: str) -> DataFrame:
    """Effect at the mean of each modifier and one deviation below and above."""
    rows = []
    for m in modifiers:
        use = zscore(df.dropna(subset=[m, t, y, cluster]), [m]).withColumn("_tz", F.col(t) * F.col(f"{m}_z"))
        fit = Regression(cluster_grams(use, [y, t, "_tz"], cluster)).fit(y, [t, "_tz"])
        b0, b1 = (float(v) for v in fit.beta)
        rows.append((m, fit.n, b0, b1, float(fit.se[1]), b0 - b1, b0 + b1))
    return df.sparkSession.createDataFrame(
        rows, "modifier string, n long, theta double, interaction double, interaction_se double, theta_low double, theta_high double")


def categorical_heterogeneity(df: DataFrame, modifier: str, t: str, y: str, cluster: str, min_rows: int = 0) -> DataFrame:
    """Implied effect per level with a joint test that all levels agree."""
    use = df.dropna(subset=[modifier, t, y, cluster])
    if min_rows:
        use = collapse_rare(use, modifier, min_rows)
    levels = [r[0] for r in use.select(F.col(modifier).cast("string")).distinct().orderBy(modifier).collect()]
    names = [f"_t_{i}" for i in range(1, len(levels))]
    made = {n: F.when(F.col(modifier) == v, F.col(t)).otherwise(F.lit(0.0)) for n, v in zip(names, levels[1:])}
    fit = Regression(cluster_grams(use.withColumns(made), [y, t, *names], cluster)).fit(y, [t, *names])
    test = wald(fit, names) if names else {"stat": None, "p_value": None}
    rows = [
        (modifier, levels[0], v, fit.n, float(fit.beta[0] + (fit.beta[i] if i else 0.0)), test["stat"], test["p_value"])
        for i, v in enumerate(levels)
    ]
    return df.sparkSession.createDataFrame(
        rows, "modifier string, reference string, level string, n long, theta double, joint_stat double, joint_p double")


def linear_residuals(df: DataFrame, targets: dict[str, str], numerics: Sequence[str], factors: Sequence[str], fold: str,
                     min_train: int = 2) -> DataFrame:
    """Rows with cross-fitted linear residuals ``target -> name``."""
    out = df
    for y, name in targets.items():
        out = left_out_linear(out, y, numerics, factors, fold, f"{name}_hat", min_train)
        out = out.withColumn(name, F.col(y) - F.col(f"{name}_hat"))
    return out


def tree_residuals(df: DataFrame, targets: dict[str, str], numerics: Sequence[str], factors: Sequence[str], fold: str,
                   learner: Ensemble, k: int = 5) -> DataFrame:
    """Rows with cross-fitted residuals ``target -> name`` of a tree ensemble, all targets grown together."""
    models = [Model(f"{name}_hat", y) for y, name in targets.items()]
    out = crossfit_trees(df.withColumn("_f", F.array(fold)), models, numerics, factors, "_f", k, learner).drop("_f")
    return out.withColumns({name: F.col(y) - F.col(f"{name}_hat") for y, name in targets.items()})


def repeated_tree_estimates(df: DataFrame, t: str, y: str, numerics: Sequence[str], factors: Sequence[str], cluster: str, entity: str,
                            seeds: Sequence[int], learner: Ensemble, k: int = 5, outcome_seeds: Sequence[int] | None = None) -> DataFrame:
    """``repeated_estimates`` with tree nuisance models: the trees of all repeats, folds and both targets grow together."""
    seeds = list(seeds)
    outcome_seeds = [s + OUTCOME_SEED for s in seeds] if outcome_seeds is None else list(outcome_seeds)
    use = cut_lineage(df.dropna(subset=[t, y, cluster, entity]))
    split = use.join(fold_lists(use, entity, k, [*seeds, *outcome_seeds], "_folds_of"), entity)
    models = [Model(f"_t{i}", t, i) for i in range(len(seeds))] + [Model(f"_y{i}", y, len(seeds) + i) for i in range(len(seeds))]
    made = crossfit_trees(split, models, numerics, factors, "_folds_of", k, learner)
    each = F.array(*[F.struct(F.lit(s).cast("long").alias("seed"), F.col(f"_t{i}").alias("_th"), F.col(f"_y{i}").alias("_yh")) for i, s in enumerate(seeds)])
    long = cut_lineage(made.select(F.col(t).cast("double").alias("_t"), F.col(y).cast("double").alias("_y"), F.col(cluster).alias("_c"), F.col(entity).alias("_e"), F.inline(each)))
    long = long.withColumns({"_tr": F.col("_t") - F.col("_th"), "_yr": F.col("_y") - F.col("_yh")}).where("_tr IS NOT NULL AND _yr IS NOT NULL")
    r2 = lambda res, c: (1 - F.try_divide(F.sum(F.col(res) * F.col(res)), F.regr_sxx(F.col(c), F.col(c))))
    quality = long.groupBy("seed").agg(r2("_tr", "_t").alias("exposure_r2"), r2("_yr", "_y").alias("outcome_r2"))
    return slope_through_origin(long, "_yr", "_tr", "_c", "_e", ["seed"]).join(quality, "seed")


def orthogonal_suite(df: DataFrame, t: str, y: str, cluster: str, entity: str, covariates: Sequence[str],
                     prob: float = 0.99, outcomes: Sequence[str] = (), numerics: Sequence[str] = (), factors: Sequence[str] = (),
                     fold: str = "fold", nuisance: dict[str, str] | None = None, audit: Sequence[float] = (0.5, 0.9, 0.95, 0.99),
                     learner: Ensemble | None = None) -> dict[str, DataFrame]:
    """All parts of the suite from two residual columns: main estimate, estimate on common support, exposure
    balance, quantiles of the absolute exposure residual with the share kept; with ``outcomes`` their
    falsification (by linear models or by ``learner``), with ``nuisance`` (target -> prediction) the quality of the nuisance models."""
    exposed = df.where(F.col(t).isNotNull()).withColumn("_abs", F.abs(F.col(t)))
    main = per_sd(slope_through_origin(df, y, t, cluster, entity))
    trimmed = per_sd(slope_through_origin(support(exposed, t, prob), y, t, cluster, entity))
    cuts = {r["prob"]: r["quantile"] for r in exact_quantiles(exposed, "_abs", list(audit)).collect()}
    kept = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.lit(cuts.get(p)).cast("double").alias("cutoff"), F.col(f"_k{i}").alias("keep_fraction")) for i, p in enumerate(audit)])
    overlap = exposed.agg(*[F.avg((F.col("_abs") <= F.lit(cuts.get(p))).cast("double")).alias(f"_k{i}") for i, p in enumerate(audit)]).select(F.inline(kept))
    parts = {"main": main, "support": trimmed, "balance": balance(df, covariates, [t], cluster, entity), "overlap": overlap}
    if outcomes:
        parts["falsification"] = falsification(df, outcomes, t, numerics, factors, fold, cluster, entity, exclude_outcome=True, learner=learner)
    if nuisance:
        parts["nuisance"] = nuisance_quality(df, nuisance)
    return parts


def falsification(df: DataFrame, outcomes: Sequence[str], t: str, numerics: Sequence[str], factors: Sequence[str], fold: str,
                  cluster: str, entity: str, exclude_outcome: bool = False, learner: Ensemble | None = None, k: int = 5) -> DataFrame:
    """Orthogonal estimates for outcomes that the exposure cannot have changed, by linear models, all from one
    moment store, or by a tree ensemble.

    Folds may split entities: a store's unit is an entity within a fold.
    """
    if learner is not None:
        parts = []
        for y in outcomes:
            res = tree_residuals(df, {y: "_y_res"}, [c for c in numerics if not (exclude_outcome and c == y)], factors, fold, learner, k)
            parts.append(slope_through_origin(res, "_y_res", t, cluster, entity).withColumn("outcome", F.lit(y)))
        return reduce(DataFrame.unionByName, parts)
    unit = df.withColumn("_unit", F.when(F.col(fold).isNotNull(), F.to_json(F.struct(F.col(fold).alias("f"), F.col(entity).alias("e")))))
    store = MomentStore.build(unit, [t, *outcomes, *numerics], "_unit", cluster, factors)
    names = [r[0] for r in store.table.select(F.get_json_object("e", "$.f")).distinct().orderBy(F.get_json_object("e", "$.f")).collect()]
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.get_json_object("e", "$.f")).cast("int") - 1
    folds = store.table.select("e").distinct().select("e", F.array(place).alias("folds"))
    pairs = {y: (Side(t), Side(y, 0, tuple(c for c in numerics if not (exclude_outcome and c == y)), tuple(factors))) for y in outcomes}
    found = store.slopes(folds, pairs, len(names), 2, entity=F.get_json_object("e", "$.e"))
    return found.withColumnRenamed("label", "outcome")


#: What the outcome's seed is ahead of the exposure's, so that a repeat splits the groups twice.
OUTCOME_SEED = 17


def repeated_estimates(df: DataFrame, t: str, y: str, numerics: Sequence[str], factors: Sequence[str], cluster: str, entity: str,
                       seeds: Sequence[int], k: int = 5, outcome_seeds: Sequence[int] | None = None) -> DataFrame:
    """One orthogonal estimate per repeat, with the R-squared of both nuisance models.

    Exposure and outcome are split by seeds of their own.  The rows are read once, into moments per
    entity; the models and slopes of all repeats are sums over these.
    """
    seeds = list(seeds)
    outcome_seeds = [s + OUTCOME_SEED for s in seeds] if outcome_seeds is None else list(outcome_seeds)
    store = MomentStore.build(df, [t, y, *numerics], entity, cluster, factors)
    folds = fold_lists(store.table, "e", k, [*seeds, *outcome_seeds])
    side = lambda c, split: Side(c, split, tuple(numerics), tuple(factors))
    pairs = {str(s): (side(t, i), side(y, len(seeds) + i)) for i, s in enumerate(seeds)}
    return store.slopes(folds, pairs, k).withColumn("seed", F.col("label").cast("long")).drop("label")


def repetition_summary(reps: DataFrame) -> DataFrame:
    return replicate_summary(reps.withColumnRenamed("theta", "coef"))


def partially_linear(reps: DataFrame) -> DataFrame:
    """Median over repeated splits with the deviation-adjusted error."""
    return median_of_repetitions(reps)


def with_balanced_folds(df: DataFrame, entity: str, k: int = 5) -> DataFrame:
    return with_folds(df, balanced_folds(df, entity, k), entity)


def nuisance_quality(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """R-squared and RMSE of cross-fitted predictions ``target -> prediction``."""
    parts = [fit_quality(df, y, p).withColumn("target", F.lit(y)) for y, p in pairs.items()]
    return reduce(DataFrame.unionByName, parts)
