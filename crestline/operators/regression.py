"""Fixed-effect regressions with cluster-robust inference, read from cluster moments.

Every result follows from the small matrices of ``ClusterGrams``: absorbed factor dummies are
partialled out of the total, scores per cluster are linear in the cluster's own matrix, and a
left-out cluster is a subtraction.  Tasks work on cluster rows; the driver solves systems of
the size of the design.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from crestline.functions.tails import chi2_upper, normal_two_sided, t_two_sided
from crestline.operators.gram import ClusterGrams, cluster_grams, reduce_arrays, triangle, unpack
from crestline.operators.windows import demean
from crestline.session import cut_lineage

#: Entries of a cluster's matrix up to which left-out errors come from summed outer products; models of a block beyond.
SQUARES, MODELS = 800, 512
Z95 = 1.959963984540054  # fixed value: two-sided 95 % normal quantile

ESTIMATES = (
    "spec string, label string, exposure string, outcome string, term string, n long, "
    "entities long, clusters long, coef double, se double, stat double, p_value double, "
    "ci_low double, ci_high double, std_beta double, extra map<string,double>"
)


@dataclass
class Totals:
    gram: np.ndarray
    n: int
    entities: int
    clusters: int


@dataclass
class Projection:
    """Combinations of the moment columns: regressors and outcome net of absorbed factors."""

    x: np.ndarray  # width x k
    y: np.ndarray  # width
    xx: np.ndarray
    bread: np.ndarray
    beta: np.ndarray
    residual: np.ndarray


@dataclass
class Fit:
    spec: str
    label: str
    outcome: str
    regressors: list[str]
    beta: np.ndarray
    cov: np.ndarray
    n: int
    entities: int
    clusters: int
    std_beta: np.ndarray
    extra: dict[str, float] = field(default_factory=dict)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def rows(self) -> list[tuple]:
        out = []
        for j, term in enumerate(self.regressors):
            b, s = float(self.beta[j]), float(self.se[j])
            stat = b / s if s > 0 else float("nan")
            out.append((
                self.spec, self.label, self.regressors[0], self.outcome, term, self.n, self.entities,
                self.clusters, b, s, stat, normal_two_sided(stat), b - Z95 * s, b + Z95 * s,
                float(self.std_beta[j]), dict(self.extra),
            ))
        return out


def pseudo_inverse(a: np.ndarray) -> np.ndarray:
    if a.size == 0:
        return a
    w, v = np.linalg.eigh((a + a.T) / 2)
    keep = w > max(w.max(), 0.0) * 1e-11
    return (v[:, keep] / w[keep]) @ v[:, keep].T


def rank_of(a: np.ndarray) -> int:
    """Rank of a moment matrix after scaling its diagonal to one."""
    d = np.sqrt(np.clip(np.diag(a), 0.0, None))
    ok = d > 0
    if not ok.any():
        return 0
    s = a[np.ix_(ok, ok)] / np.outer(d[ok], d[ok])
    return int((np.linalg.eigvalsh(s) > 1e-10).sum())


def project(gram: np.ndarray, y: int, x: np.ndarray, absorbed: np.ndarray) -> Projection:
    width = len(gram)
    names = np.concatenate([[y], x]).astype(int)
    combos = np.zeros((width, len(names)))
    combos[names, np.arange(len(names))] = 1.0
    if len(absorbed):
        gamma = pseudo_inverse(gram[np.ix_(absorbed, absorbed)]) @ gram[np.ix_(absorbed, names)]
        combos[absorbed, :] -= gamma
    net = combos.T @ gram @ combos
    xx, xy = net[1:, 1:], net[1:, 0]
    bread = pseudo_inverse(xx)
    beta = bread @ xy
    wx, wy = combos[:, 1:], combos[:, 0]
    return Projection(wx, wy, xx, bread, beta, wy - wx @ beta)


def small_sample(clusters: int, n: int, k: int) -> float:
    if clusters < 2 or n <= k:
        return float("nan")
    return clusters / (clusters - 1) * (n - 1) / (n - k)


def totals(g: ClusterGrams) -> Totals:
    width = g.width

    def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
        gram = sum(unpack(p, v, width) for p, v in zip(b["pos"], b["val"]))
        return {
            "gram": gram,
            "counts": np.array([b["n"].sum(), b["entities"].sum(), len(b)], dtype=float),
        } if len(b) else {}

    out = reduce_arrays(g.table, part)
    n, entities, clusters = (int(round(v)) for v in out["counts"])
    return Totals(out["gram"].reshape(width, width), n, entities, clusters)


class Regression:
    """Fits on one moment table; designs that share rows share the pass over the data."""

    def __init__(self, grams: ClusterGrams, spec: str = ""):
        self.grams = grams
        self.spec = spec
        self.total = totals(grams)

    # -- designs ---------------------------------------------------------------------------

    def net_variances(self, columns: Sequence[str]) -> list[tuple[str, float, bool]]:
        """Columns in order, with what is left of each one's sum of squares net of the absorbed effects and of the
        columns kept before it, and whether it is kept: one Cholesky factorisation that leaves out dependent columns."""
        idx = self.grams.index(columns)
        net = project(self.total.gram, int(idx[0]), idx, self.grams.absorbed).xx.copy()
        whole, out = np.diag(net).copy(), []
        for q, c in enumerate(columns):
            left = max(float(net[q, q]), 0.0)
            keep = left > 1e-10 * whole[q] and whole[q] > 1e-20 * self.total.n
            out.append((c, left * self.grams.scale[c] ** 2, bool(keep)))
            if keep:
                net -= np.outer(net[:, q], net[q]) / net[q, q]
        return out

    def varying(self, columns: Sequence[str]) -> list[str]:
        """Columns with variance left after the absorbed effects."""
        return [c for c in columns if self.net_variances([c])[0][2]]

    def rank(self, columns: Sequence[str]) -> int:
        idx = self.grams.index(columns)
        return rank_of(project(self.total.gram, int(idx[0]), idx, self.grams.absorbed).xx)

    def full_rank_subset(self, columns: Sequence[str]) -> list[str]:
        """Columns in order, each kept when it adds to the rank."""
        return [c for c, _, kept in self.net_variances(columns) if kept]

    def _projection(self, outcome: str, regressors: Sequence[str], gram: np.ndarray | None = None) -> Projection:
        g = self.grams
        return project(
            self.total.gram if gram is None else gram,
            int(g.index([outcome])[0]), g.index(regressors), g.absorbed,
        )

    def _back(self, outcome: str, regressors: Sequence[str]) -> np.ndarray:
        """Factors that return scaled coefficients to original units."""
        s = self.grams.scale
        return np.array([s[outcome] / s[c] for c in regressors])

    # -- estimates -------------------------------------------------------------------------

    def fits(self, designs: dict[str, tuple[str, Sequence[str]]]) -> dict[str, Fit]:
        """Cluster-robust fits of ``label -> (outcome, regressors)``, one pass for all scores."""
        width = self.grams.width
        plans = {k: self._projection(y, x) for k, (y, x) in designs.items()}

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = {}
            for p, v in zip(b["pos"], b["val"]):
                gram = unpack(p, v, width)
                for k, plan in plans.items():
                    s = plan.x.T @ gram @ plan.residual
                    m = np.outer(s, s)
                    out[k] = out[k] + m if k in out else m
            return out

        meats = reduce_arrays(self.grams.table, part)
        t, fits = self.total, {}
        for k, (outcome, regressors) in designs.items():
            plan, size = plans[k], len(regressors)
            meat = meats[k].reshape(size, size)
            cov = plan.bread @ meat @ plan.bread * small_sample(t.clusters, t.n, size)
            back = self._back(outcome, regressors)
            sd = self.grams.sd
            std = np.array([
                b * f * sd[c] / sd[outcome] if sd[outcome] > 0 else float("nan")
                for b, f, c in zip(plan.beta, back, regressors)
            ])
            fits[k] = Fit(
                self.spec, k, outcome, list(regressors), plan.beta * back, cov * np.outer(back, back),
                t.n, t.entities, t.clusters, std,
            )
        return fits

    def fit(self, outcome: str, regressors: Sequence[str], label: str = "main") -> Fit:
        return self.fits({label: (outcome, regressors)})[label]

    def classical(self, outcome: str, regressors: Sequence[str], label: str = "iid") -> Fit:
        """Homoskedastic covariance with residual degrees of freedom and t tails."""
        plan = self._projection(outcome, regressors)
        dof = self.total.n - len(regressors)
        sigma2 = float(plan.residual @ self.total.gram @ plan.residual) / dof
        back = self._back(outcome, regressors)
        fit = Fit(
            self.spec, label, outcome, list(regressors), plan.beta * back,
            plan.bread * sigma2 * np.outer(back, back), self.total.n, self.total.entities,
            self.total.clusters, np.full(len(regressors), np.nan), {"dof": float(dof)},
        )
        fit.extra["p_t"] = t_two_sided(float(fit.beta[0] / fit.se[0]), dof)
        return fit

    # -- leaving clusters out --------------------------------------------------------------

    def leave_one_out(self, outcome: str, regressors: Sequence[str]) -> DataFrame:
        """``(excluded, n, entities, coef, se, p_value)`` per left-out cluster, no second scan.

        Subtracting a cluster's matrix equals refitting as long as entities lie within clusters;
        otherwise each model is refitted on the remaining rows.
        """
        g, t, width, k = self.grams, self.total, self.grams.width, len(regressors)
        spark = g.table.sparkSession
        schema = "excluded string, n long, entities long, coef double, se double, p_value double"
        if not g.nested:
            return self._refit_each(outcome, regressors, schema)
        used = np.concatenate([g.index([outcome]), g.index(regressors), g.absorbed]).astype(int)
        x, absorbed, gram_all = np.arange(1, 1 + k), np.arange(1 + k, len(used)), t.gram[np.ix_(used, used)]
        i, j = triangle(len(used))
        clusters, n_all, e_all, back = t.clusters, t.n, t.entities, float(self._back(outcome, regressors)[0])

        def own(p, v) -> np.ndarray:
            return unpack(p, v, width)[np.ix_(used, used)]

        # (a' G r)^2 over all clusters is a quadratic form of the sum of outer products of their matrices
        spread = len(i) <= SQUARES

        def part(b: pd.DataFrame) -> dict[str, np.ndarray]:
            flat = np.array([own(p, v)[i, j] for p, v in zip(b["pos"], b["val"])]).reshape(-1, len(i))
            return {"t": flat.T @ flat}

        squares = reduce_arrays(g.table, part)["t"].reshape(len(i), len(i)) if spread else None

        def solve(batches):
            for b in batches:
                rows = []
                for c, n, e, p, v in zip(b["c"], b["n"], b["entities"], b["pos"], b["val"]):
                    mine = own(p, v)
                    plan = project(gram_all - mine, 0, x, absorbed)
                    left = plan.x @ plan.bread[0]
                    pairs = np.outer(left, plan.residual)
                    weight = pairs[i, j] + np.where(i != j, pairs[j, i], 0.0)
                    q = float(weight @ squares @ weight) - float(weight @ mine[i, j]) ** 2 if spread else np.nan
                    beta = float(plan.beta[0]) * back
                    var = max(q, 0.0) * small_sample(clusters - 1, n_all - n, k) if clusters > 2 else np.nan
                    se = math.sqrt(var) * back if var == var else np.nan
                    rows.append((c, n_all - n, e_all - e, beta, se if se == se else None, normal_two_sided(beta / se) if se > 0 else None, list(left), list(plan.residual)))
                yield pd.DataFrame(rows, columns=["excluded", "n", "entities", "coef", "se", "p_value", "a", "r"])

        found = cut_lineage(g.table.mapInPandas(solve, f"{schema}, a array<double>, r array<double>"))
        if spread:
            return found.drop("a", "r")
        return self._wide_errors(found, own, back, k).select(*found.columns[:6])

    def _wide_errors(self, found: DataFrame, own, back: float, k: int) -> DataFrame:
        """Errors of left-out fits of designs too wide for squared moments: scores of every model, models in blocks.

        A block of models goes to the clusters, each task adds its squared scores, and only these sums come back.
        """
        t, spark = self.total, found.sparkSession
        block = F.pmod(F.xxhash64("excluded"), F.lit(max(1, -(-t.clusters // MODELS))))
        parts = []
        for (number,) in found.select(block).distinct().collect():
            some = found.where(block == number).select("excluded", "n", "coef", "a", "r").toPandas()
            a, r, names = np.array(some["a"].tolist()), np.array(some["r"].tolist()), {c: q for q, c in enumerate(some["excluded"])}

            def part(b: pd.DataFrame, a=a, r=r, names=names) -> dict[str, np.ndarray]:
                q = np.zeros(len(names))
                for c, p, v in zip(b["c"], b["pos"], b["val"]):
                    s = np.einsum("ij,ij->i", a @ own(p, v), r) ** 2
                    s[names.get(c, [])] = 0.0
                    q += s
                return {"q": q}

            q = reduce_arrays(self.grams.table, part)["q"]
            rows = []
            for c, n, coef, value in zip(some["excluded"], some["n"], some["coef"], q):
                se = math.sqrt(value * small_sample(t.clusters - 1, int(n), k)) * back if t.clusters > 2 else None
                rows.append((c, se, normal_two_sided(coef / se) if se else None))
            parts.append(spark.createDataFrame(rows, "excluded string, se double, p_value double"))
        errors = reduce(DataFrame.unionByName, parts)
        return found.drop("se", "p_value").join(errors, "excluded")

    def _refit_each(self, outcome: str, regressors: Sequence[str], schema: str) -> DataFrame:
        g, rows = self.grams, []
        for (c,) in g.table.select("c").collect():
            kept = g.sample.where(F.col(g.options["cluster"]).cast("string") != c)
            model = Regression(cluster_grams(kept, **g.options))
            f = model.fit(outcome, regressors)
            b, s = float(f.beta[0]), float(f.se[0])
            rows.append((c, f.n, f.entities, b, s, normal_two_sided(b / s)))
        return g.table.sparkSession.createDataFrame(rows, schema)

    # -- wild cluster bootstrap ------------------------------------------------------------

    def wild_bootstrap(
        self,
        outcome: str,
        regressors: Sequence[str],
        tested: Sequence[str] | None = None,
        reps: int = 999,
        signs: Callable[[str, int], np.ndarray] | None = None,
    ) -> tuple[dict[str, float], np.ndarray]:
        """Bootstrap-t of the mean of the tested coefficients with the null imposed.

        A replicate flips residuals per cluster, so its moments are a signed sum of cluster
        terms: one pass adds them for all replicates, a second gives their variances.
        """
        regressors = list(regressors)
        tested = list(tested or regressors[:1])
        signs = signs or md5_signs
        width = self.grams.width
        plan = self._projection(outcome, regressors)
        held = [j for j, c in enumerate(regressors) if c not in tested]
        contrast = np.array([1.0 / len(tested) if c in tested else 0.0 for c in regressors])
        contrast = contrast * self._back(outcome, regressors)
        wx = plan.x
        wr = wx[:, held]
        xy = wx.T @ self.total.gram @ plan.y
        b_r = pseudo_inverse(plan.xx[np.ix_(held, held)]) @ xy[held] if held else np.zeros(0)
        fitted = wr @ b_r
        null_residual = plan.y - fitted

        def terms(p, v):
            gram = unpack(p, v, width)
            gx = wx.T @ gram
            return gx @ fitted, gx @ null_residual, gx @ wx

        def first(b: pd.DataFrame) -> dict[str, np.ndarray]:
            out = np.zeros((reps, len(regressors)))
            for c, p, v in zip(b["c"], b["pos"], b["val"]):
                f, q, _ = terms(p, v)
                out += f[None, :] + signs(c, reps)[:, None] * q[None, :]
            return {"xy": out}

        star = reduce_arrays(self.grams.table, first)["xy"].reshape(reps, len(regressors)) @ plan.bread
        row = contrast @ plan.bread

        def second(b: pd.DataFrame) -> dict[str, np.ndarray]:
            out = np.zeros(reps)
            for c, p, v in zip(b["c"], b["pos"], b["val"]):
                f, q, xx = terms(p, v)
                score = f[None, :] + signs(c, reps)[:, None] * q[None, :] - star @ xx
                out += (score @ row) ** 2
            return {"var": out}

        var = reduce_arrays(self.grams.table, second)["var"]
        var = var * small_sample(self.total.clusters, self.total.n, len(regressors))
        observed = self.fit(outcome, regressors)
        pick = np.array([1.0 / len(tested) if c in tested else 0.0 for c in regressors])
        effect, se = float(pick @ observed.beta), float(np.sqrt(pick @ observed.cov @ pick))
        ok = var > 0
        t_star = (star[ok] @ contrast) / np.sqrt(var[ok])
        t_obs = effect / se
        return {
            "reps_requested": reps,
            "reps_valid": int(ok.sum()),
            "reps_failed": int(reps - ok.sum()),
            "observed_effect": effect,
            "observed_se": se,
            "observed_t": t_obs,
            "p_value": float(((np.abs(t_star) >= abs(t_obs) - 1e-12).sum() + 1) / (len(t_star) + 1)),
            "t_p025": float(np.quantile(t_star, 0.025)),
            "t_median": float(np.quantile(t_star, 0.5)),
            "t_p975": float(np.quantile(t_star, 0.975)),
        }, t_star


def md5_signs(cluster: str, reps: int) -> np.ndarray:
    """Rademacher signs that depend only on (replicate, cluster)."""
    return np.array([
        -1.0 if hashlib.md5(f"{r}_{cluster}".encode()).hexdigest() < "8" else 1.0 for r in range(1, reps + 1)
    ])


def wald(fit: Fit, terms: Sequence[str]) -> dict[str, float]:
    """Joint test that the named coefficients are zero."""
    idx = [fit.regressors.index(t) for t in terms]
    b, v = fit.beta[idx], fit.cov[np.ix_(idx, idx)]
    stat = float(b @ np.linalg.solve(v, b))
    return {"stat": stat, "dof": len(idx), "p_value": chi2_upper(stat, len(idx))}


def estimates_frame(spark: SparkSession, fits: Sequence[Fit], exposure_only: bool = False) -> DataFrame:
    rows = [r for f in fits for r in (f.rows()[:1] if exposure_only else f.rows())]
    return spark.createDataFrame(rows, ESTIMATES)


def panel_regression(
    df: DataFrame,
    outcome: str,
    exposure: str,
    controls: Sequence[str] = (),
    cluster: str = "state",
    entity: str | None = None,
    factors: Sequence[str] = (),
    spec: str = "",
    drop_constant: bool = True,
) -> tuple[Regression, Fit]:
    """Complete cases, absorb, fit: the usual wrapper."""
    model = Regression(cluster_grams(df, [outcome, exposure, *controls], cluster, entity, factors), spec)
    kept = model.varying(controls) if drop_constant else list(controls)
    return model, model.fit(outcome, [exposure, *kept])


def specification_grid(
    df: DataFrame, specs: dict[str, dict], outcome: str, exposure: str, cluster: str
) -> DataFrame:
    """Exposure rows of several specifications: ``name -> {controls, entity, factors}``.

    Specifications of one entity share one moment store, so the rows are read once for each entity,
    not for each specification; every model keeps the rows complete for itself.
    """
    from crestline.operators.moments import MomentStore

    stores: dict[str | None, MomentStore] = {}
    for entity in dict.fromkeys(o.get("entity") for o in specs.values()):
        mine = [o for o in specs.values() if o.get("entity") == entity]
        columns = list(dict.fromkeys([outcome, exposure, *[c for o in mine for c in o.get("controls", ())]]))
        factors = list(dict.fromkeys(f for o in mine for f in o.get("factors", ())))
        unit = df if entity else df.withColumn("_unit", F.col(cluster))
        stores[entity] = MomentStore.build(unit, columns, entity or "_unit", cluster, factors)
    fits = []
    for name, options in specs.items():
        controls = list(options.get("controls", ()))
        entity = options.get("entity")
        grams = stores[entity].grams([outcome, exposure, *controls], options.get("factors", ()), within=entity is not None)
        model = Regression(grams, name)
        kept = model.varying(controls) if options.get("drop_constant", True) else controls
        fits.append(model.fit(outcome, [exposure, *kept]))
    return estimates_frame(df.sparkSession, fits, exposure_only=True)


def nested_controls(
    df: DataFrame, sets: dict[str, Sequence[str]], outcome: str, exposure: str, cluster: str,
    entity: str | None = None, factors: Sequence[str] = (),
) -> DataFrame:
    """Growing control sets on the rows complete for all of them: one moment pass."""
    union = list(dict.fromkeys(c for s in sets.values() for c in s))
    model = Regression(cluster_grams(df, [outcome, exposure, *union], cluster, entity, factors))
    fits = model.fits({name: (outcome, [exposure, *cs]) for name, cs in sets.items()})
    return estimates_frame(df.sparkSession, list(fits.values()), exposure_only=True)


def absorb(
    df: DataFrame, columns: Sequence[str], cluster: str, entity: str | None, factors: Sequence[str], suffix: str = "_abs"
) -> DataFrame:
    """Rows with columns net of entity and factor effects (complete rows only).

    Factor effects come from the moments; taking them off each row and demeaning by entity
    gives the joint residual exactly, without rounds of alternating demeaning.
    """
    columns, factors = list(columns), list(factors)
    kept = df.dropna(subset=[*columns, cluster, *([entity] if entity else []), *factors])
    model = Regression(cluster_grams(kept, columns, cluster, entity, factors))
    g = model.grams
    start, out = len(columns), kept
    gamma = pseudo_inverse(model.total.gram[start:, start:]) @ model.total.gram[start:, :start]
    for j, c in enumerate(columns):
        net = F.col(c).cast("double") - F.lit(g.mean[c])
        for f in factors:
            effect = {v: float(gamma[i, j] * g.scale[c]) for i, (h, v) in enumerate(g.levels) if h == f}
            table = F.create_map(*[F.lit(x) for pair in effect.items() for x in pair])
            net = net - F.try_element_at(table, F.col(f).cast("string"))
        out = out.withColumn(c + suffix, net)
    if entity is None:
        return out
    made = [c + suffix for c in columns]
    within = demean(out, [entity], made, "_in")
    return within.drop(*made).withColumnsRenamed({f"{c}_in": c for c in made})


def absorb_iterative(
    df: DataFrame, columns: Sequence[str], effects: Sequence[str], tol: float = 1e-10, rounds: int = 1000, suffix: str = "_abs"
) -> DataFrame:
    """Alternating group demeaning for several effects that all have many levels.

    Each sweep is a combining aggregate and a join per effect; lineage is cut per sweep.
    Raises if ``rounds`` sweeps do not bring the largest change under ``tol``.
    """
    made = [c + suffix for c in columns]
    out = df.dropna(subset=[*columns, *effects]).withColumns({m: F.col(c).cast("double") for c, m in zip(columns, made)})
    for _ in range(rounds):
        out = out.withColumns({f"_old_{m}": F.col(m) for m in made})
        for e in effects:
            out = demean(out, [e], made, "_in").drop(*made).withColumnsRenamed({f"{m}_in": m for m in made})
        out = cut_lineage(out)
        change = out.agg(F.max(F.greatest(*[F.abs(F.col(m) - F.col(f"_old_{m}")) for m in made], F.lit(0.0)))).first()[0]
        out = out.drop(*[f"_old_{m}" for m in made])
        if change is None or change < tol:
            return out
    raise RuntimeError(f"no convergence in {rounds} sweeps: the last changed a value by {change:g}")
