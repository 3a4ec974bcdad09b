"""Regressions as SQL: columns are made orthogonal one after the other, then sums suffice.

``orthogonal`` emits one table expression per regressor.  After it, the last regressors are
orthogonal to everything before them, so a coefficient is a ratio of two sums.
"""

from __future__ import annotations


def demeaned(base: str, exprs: list[str], entity: str | None, carry: list[str], part: str | None = None) -> str:
    """Columns v0.. of ``base`` within entities, in the given order."""
    cols = []
    for i, e in enumerate(exprs):
        e = f"CAST({e} AS DOUBLE)"
        keys = ", ".join(k for k in (part, entity) if k)
        cols.append(f"{e} - avg({e}) OVER (PARTITION BY {keys}) AS v{i}" if entity else f"{e} AS v{i}")
    return f"SELECT {', '.join(carry)}, {', '.join(cols)} FROM {base}"


def orthogonal(name: str, start: str, width: int, steps: int, carry: list[str], part: str | None = None,
               train: str = "TRUE") -> dict[str, tuple[str, str]]:
    """Table expressions ``{name}1 .. {name}{steps}``; step j frees later columns of column j-1."""
    over = f"OVER (PARTITION BY {part})" if part else "OVER ()"
    out, before = {}, start
    for j in range(steps):
        def s(k):
            return f"sum(CASE WHEN {train} THEN v{j} * v{k} ELSE 0 END) {over}"
        cols = [f"v{k}" for k in range(j + 1)]
        cols += [f"v{k} - CASE WHEN {s(j)} > 1e-9 THEN v{j} * ({s(k)}) / ({s(j)}) ELSE 0 END AS v{k}" for k in range(j + 1, width)]
        out[f"{name}{j + 1}"] = (before, f"SELECT {', '.join(carry)}, {', '.join(cols)} FROM {before}")
        before = f"{name}{j + 1}"
    return out


def slope(source: str, x: int, y: int, cluster: str, k: int, group: str | None = None) -> str:
    """Coefficient and clustered error of the last regressor from its orthogonal columns."""
    g, by, on = (f"{group}, ", f"GROUP BY {group}", f"USING ({group})") if group else ("", "", "ON TRUE")
    return f"""SELECT {g}n, clusters, coef, sqrt(meat * clusters / (clusters - 1) * (n - 1) / (n - {k})) / sxx AS se FROM (
SELECT {g}sum(c) AS n, count(*) AS clusters, any_value(b) AS coef, any_value(sxx) AS sxx, sum((xy - b * xx) * (xy - b * xx)) AS meat FROM (
SELECT t.*, sum(xy) OVER w / sum(xx) OVER w AS b, sum(xx) OVER w AS sxx FROM (
SELECT {g}{cluster}, count(*) AS c, sum(v{x} * v{y}) AS xy, sum(v{x} * v{x}) AS xx FROM {source} GROUP BY {g}{cluster}) t
WINDOW w AS ({f'PARTITION BY {group}' if group else ''})) {by}) AS fitted"""


def regression(name: str, base: str, y: str, x: str, controls: list[str], dummies: list[str], entity: str | None,
               cluster: str, group: str | None = None, carry: list[str] | None = None) -> tuple[dict[str, tuple[str, str]], str]:
    """Table expressions and final query of one fixed-effect regression of y on x."""
    exprs = [*dummies, *controls, x, y]
    keep = list(dict.fromkeys([c for c in [group, cluster, *(carry or [])] if c]))
    ctes = {f"{name}0": (base, demeaned(base, exprs, entity, keep, group))}
    steps = len(exprs) - 2
    ctes |= orthogonal(name, f"{name}0", len(exprs), steps, keep, group)
    return ctes, slope(f"{name}{steps}", steps, steps + 1, cluster, len(controls) + 1, group)


def held_out(name: str, base: str, y: str, numerics: list[str], dummies: list[str], carry: list[str], part: str,
             train: str) -> tuple[dict[str, tuple[str, str]], str]:
    """Residual of y on rows outside ``train`` from a linear model fitted inside it, per part."""
    exprs = ["1.0", *dummies, *numerics, y]
    keep = list(dict.fromkeys([*carry, part, f"{train}"]))
    ctes = {f"{name}0": (base, demeaned(base, exprs, None, keep))}
    steps = len(exprs) - 1
    ctes |= orthogonal(name, f"{name}0", len(exprs), steps, keep, part, train)
    return ctes, f"SELECT {', '.join(carry)}, v{steps} AS resid FROM {name}{steps} WHERE NOT {train}"
