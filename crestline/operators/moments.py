"""A table of second moments per entity, from which splits, left-out units and specifications are keyed sums.

One combining aggregate over the rows gives, per (entity, cluster, which columns are there, factor
levels), the sums of products of all columns and a constant.  Least squares on any part of the
entities, and the sums that a residual-on-residual slope needs, are quadratic forms of these small
matrices, so repeated cross-fits, falsification outcomes and grids of specifications never go back
to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crestline.operators.expectation import least_squares
from crestline.operators.gram import ClusterGrams, entity_moments, reduce_arrays, triangle
from crestline.operators.orthogonal import slope_of_sums
from crestline.session import cut_lineage

#: Doubles of full matrices that a task lays out at once.
SLICE_VALUES = 4_000_000


@dataclass(frozen=True)
class Side:
    """One side of a residual-on-residual slope: a column as it is, or net of a linear model fitted on other folds."""

    target: str
    split: int | None = None  # which of an entity's folds
    numerics: tuple[str, ...] = ()
    factors: tuple[str, ...] = ()


@dataclass
class Layout:
    """What stands where in a cell's matrix: a constant, the columns, the levels of the factors."""

    columns: list[str]
    factors: list[str]
    levels: list[tuple[str, str]]

    @property
    def dense(self) -> int:
        return 1 + len(self.columns)

    @property
    def width(self) -> int:
        return self.dense + len(self.levels)

    def need(self, names: Sequence[str]) -> int:
        """The bits of ``has`` that rows complete in these columns and factors have."""
        return sum(1 << [*self.columns, *self.factors].index(c) for c in set(names))

    def matrices(self, cells: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Slices of cells with the full matrix of each: constant, columns, all levels."""
        dense, width = self.dense, self.width
        code = [{v: dense + i for i, (g, v) in enumerate(self.levels) if g == f} for f in self.factors]
        i, j = triangle(dense)
        step = max(1, SLICE_VALUES // (width * width))
        for first in range(0, len(cells), step):
            part = cells.iloc[first : first + step]
            full, row = np.zeros((len(part), width, width)), np.arange(len(part))
            flat = np.array(part["m"].tolist(), dtype=float).reshape(len(part), len(i))
            full[:, i, j] = full[:, j, i] = flat
            at = [part[f"f{k}"].map(c).to_numpy(int) for k, c in enumerate(code)]
            for a in at:
                full[row, a, :dense] = full[row, :dense, a] = full[:, 0, :dense]
            for a in at:
                for b in at:
                    full[row, a, b] = part["n"].to_numpy(float)
            yield part, full


@dataclass
class MomentStore:
    table: DataFrame  # e, c, has long, f0.., n, m array<double>: upper triangle over a constant and the columns
    layout: Layout

    @classmethod
    def build(cls, df: DataFrame, columns: Sequence[str], entity: str, cluster: str, factors: Sequence[str] = ()) -> MomentStore:
        """Moments of all rows with an entity and a cluster; missing values count as 0 and are told by ``has``."""
        columns, factors = list(dict.fromkeys(columns)), list(factors)
        flags = [F.col(c).isNotNull() for c in [*columns, *factors]]
        has = reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(flags)])
        rows = df.select(
            F.col(entity).cast("string").alias("e"), F.col(cluster).cast("string").alias("c"), has.alias("has"),
            *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"f{i}") for i, f in enumerate(factors)],
            *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)],
        ).where("e IS NOT NULL AND c IS NOT NULL")
        names = ["1", *[f"x{i}" for i in range(len(columns))]]
        value = lambda i: F.lit(1.0) if i == 0 else F.col(names[i])
        sums = [F.sum(value(i) * value(j)) for i, j in zip(*triangle(len(names)))]
        cells = rows.groupBy("e", "c", "has", *[f"f{i}" for i in range(len(factors))]).agg(F.count("*").alias("n"), F.array(*sums).alias("m"))
        table = cut_lineage(cells)
        seen = table.agg(F.lit(0), *[F.sort_array(F.collect_set(f"f{i}")).alias(f"l{i}") for i in range(len(factors))]).first()
        return cls(table, Layout(columns, factors, [(f, v) for i, f in enumerate(factors) for v in seen[f"l{i}"]]))

    # -- cross-fitted slopes ---------------------------------------------------------------

    def _models(self, folds: DataFrame, sides: Sequence[Side], k: int, min_train: int) -> dict[Side, np.ndarray]:
        """Per side and fold the combination of the matrix's columns that is the residual, from one pass over the cells."""
        layout, width = self.layout, self.layout.width
        fitted = [s for s in sides if s.split is not None]
        groups = list(dict.fromkeys((s.split, layout.need([s.target, *s.numerics, *s.factors])) for s in fitted))
        i, j = triangle(width)

        def part(cells: pd.DataFrame) -> dict[str, np.ndarray]:
            out = {f"{g}": np.zeros((k, len(i))) for g in range(len(groups))}
            for some, full in layout.matrices(cells):
                has, fold, flat = some["has"].to_numpy(), np.array(some["folds"].tolist()), full[:, i, j]
                for g, (split, need) in enumerate(groups):
                    ok = (has & need) == need
                    for f in range(k):
                        out[f"{g}"][f] += flat[ok & (fold[:, split] == f)].sum(axis=0)
            return out

        sums = reduce_arrays(self.table.join(folds, "e"), part) if groups else {}
        models: dict[Side, np.ndarray] = {}
        for s in sides:
            target = 1 + layout.columns.index(s.target)
            if s.split is None:
                models[s] = np.eye(width)[[target] * k]
                continue
            own = sums[f"{groups.index((s.split, layout.need([s.target, *s.numerics, *s.factors])))}"].reshape(k, len(i))
            num = np.array([1 + layout.columns.index(c) for c in s.numerics], int)
            dum = np.array([1 + len(layout.columns) + q for q, (f, _) in enumerate(layout.levels) if f in s.factors], int)
            models[s] = np.full((k, width), np.nan)
            for f in range(k):
                gram = np.zeros((width, width))
                gram[i, j] = gram[j, i] = own.sum(axis=0) - own[f]
                if gram[0, 0] < max(min_train, 1):
                    continue
                a, beta = least_squares(gram, 0, target, num, dum)
                models[s][f] = 0.0
                models[s][f, target], models[s][f, 0] = 1.0, -a
                models[s][f, np.concatenate([num, dum])] -= beta
        return models

    def slopes(self, folds: DataFrame, pairs: dict[str, tuple[Side, Side]], k: int, min_train: int = 2, entity: Column | None = None) -> DataFrame:
        """``label -> (exposure, outcome)``: one slope through the origin per label with clustered error, and the R-squared of both models.

        ``folds`` has an entity's fold in every split, ``(e, folds)``.  Rows complete for both sides
        count; two passes over the cells serve all labels.  ``entity`` tells the entity of a unit ``e``, by default itself.
        """
        models = self._models(folds, list(dict.fromkeys(s for p in pairs.values() for s in p)), k, min_train)
        layout, fields = self.layout, ["n", "ty", "tt", "t1", "y1", "yy", "rt", "rt1", "ry", "ry1"]

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for cells in batches:
                for some, full in layout.matrices(cells):
                    has, fold = some["has"].to_numpy(), np.array(some["folds"].tolist()).reshape(len(some), -1)
                    for label, (t, y) in pairs.items():
                        need = layout.need([x for s in (t, y) for x in (s.target, *s.numerics, *s.factors)])
                        u, v = (models[s][fold[:, s.split] if s.split is not None else np.zeros(len(some), int)] for s in (t, y))
                        ok = ((has & need) == need) & np.isfinite(u[:, 0]) & np.isfinite(v[:, 0])
                        if not ok.any():
                            continue
                        m, u, v = full[ok], u[ok], v[ok]
                        mu, mv = np.einsum("bij,bj->bi", m, u), np.einsum("bij,bj->bi", m, v)
                        a, b = 1 + layout.columns.index(t.target), 1 + layout.columns.index(y.target)
                        dot = lambda p, q: (p * q).sum(axis=1)
                        values = [m[:, 0, 0], dot(u, mv), dot(u, mu), mu[:, 0], mv[:, 0], dot(v, mv), m[:, a, a], m[:, 0, a], m[:, b, b], m[:, 0, b]]
                        yield pd.DataFrame({"label": label, "e": some["e"][ok], "c": some["c"][ok], **dict(zip(fields, values, strict=True))})

        schema = "label string, e string, c string, " + ", ".join(f"{f} double" for f in fields)
        cells = self.table.join(folds, "e").mapInPandas(score, schema)
        cells = cells.withColumn("e", F.col("e") if entity is None else entity).groupBy("label", "c", "e").agg(F.sum("n").cast("long").alias("n"), *[F.sum(f).alias(f) for f in fields[1:]])
        cells = cut_lineage(cells)
        spread = lambda s, s1: F.sum(s) - F.sum(s1) * F.sum(s1) / F.sum("n")
        quality = cells.groupBy("label").agg((1 - F.try_divide(F.sum("tt"), spread("rt", "rt1"))).alias("exposure_r2"), (1 - F.try_divide(F.sum("yy"), spread("ry", "ry1"))).alias("outcome_r2"))
        return slope_of_sums(cells, ["label"], "c").join(quality, "label")

    # -- within-entity moments -------------------------------------------------------------

    def grams(self, columns: Sequence[str], factors: Sequence[str] = (), within: bool = True) -> ClusterGrams:
        """The moments of ``cluster_grams`` for some of the columns and factors, on the rows complete in these."""
        columns, factors, layout = list(columns), list(factors), self.layout
        need = layout.need([*columns, *factors])
        cells = self.table.where(F.col("has").bitwiseAND(F.lit(need)) == need)
        dense = layout.dense
        place = {p: q for q, p in enumerate(zip(*triangle(dense)))}
        at = [1 + layout.columns.index(c) for c in columns]
        first = cells.agg(F.sum("n").alias("n"), *[F.sum(F.col("m")[place[0, a]]).alias(f"s{q}") for q, a in enumerate(at)], *[F.sum(F.col("m")[place[a, a]]).alias(f"q{q}") for q, a in enumerate(at)]).first()
        n = first["n"]
        if not n:
            raise ValueError("no complete rows for this design")
        means = np.array([first[f"s{q}"] / n for q in range(len(at))])
        sds = np.array([np.sqrt(max(first[f"q{q}"] - n * m * m, 0.0) / max(n - 1, 1)) for q, m in enumerate(means)])
        sds[sds < 1e-13 * np.abs(means)] = 0.0
        scale = np.where(sds > 0, sds, 1.0)
        centre = means if within or factors else np.zeros(len(at))
        codes = [layout.factors.index(f) for f in factors]
        used = [dense + q for q, (f, _) in enumerate(layout.levels) if f in factors]
        levels = [p for p in layout.levels if p[0] in factors]
        width = len(at) + len(levels)
        turn = np.zeros((layout.width, width))
        for q, a in enumerate(at):
            turn[a, q], turn[0, q] = 1 / scale[q], -centre[q] / scale[q]
        turn[used, np.arange(len(at), width)] = 1.0
        i, j = triangle(width)

        def raw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for some, full in layout.matrices(b):
                    flat = np.einsum("pi,bpq,qj->bij", turn, full, turn, optimize=True)[:, i, j]
                    for cluster, mine in some.groupby("c", sort=False).indices.items():
                        values = flat[mine].sum(axis=0)
                        pos = np.flatnonzero(values)
                        yield pd.DataFrame({"c": cluster, "pos": np.append(pos, -1).astype("int32"), "val": np.append(values[pos], some["n"].to_numpy(float)[mine].sum())})

        schema = "c string, pos int, val double"
        parts = cells.mapInPandas(raw, schema)
        nested = True
        if within:
            start, offsets, coded = len(at), [], []
            for q, f in zip(codes, factors, strict=True):
                own = [v for g, v in layout.levels if g == f]
                offsets.append(start)
                coded.append(F.create_map(*[F.lit(x) for p, v in enumerate(own) for x in (v, p)])[F.col(f"f{q}")].alias(f"k{len(coded)}"))
                start += len(own)
            sums = [((F.col("m")[place[0, a]] - F.lit(float(centre[q])) * F.col("n")) / F.lit(float(scale[q]))).alias(f"s{q}") for q, a in enumerate(at)]
            flat = cells.select("c", "e", F.col("n").alias("m"), *sums, *coded)
            nested = flat.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").isEmpty()
            parts = parts.unionByName(entity_moments(flat, len(at), offsets, width, nested))
        table = cut_lineage(ClusterGrams.listed(parts))
        named = lambda v: dict(zip(columns, map(float, v), strict=True))
        return ClusterGrams(table, columns, levels, named(sds), named(scale), named(centre), nested, cells, {"cluster": "c", "store": self, "columns": columns, "factors": factors, "within": within})
