"""Second moments per cluster: the one pass over the data that every regression here needs.

For columns ``z`` the table holds, per cluster, the sums of ``z z'`` after taking out entity
means, as the upper triangle of a small matrix.  With entity sums ``s`` and size ``n``

    sum of (z - mean)(z - mean)'  =  sum of z z'  -  s s' / n

so two combining aggregates give the within-entity moments and the rows are never joined
to their means.  Fitting, leaving clusters out and bootstrapping only read this table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from crestline.session import cut_lineage

SQL_WIDTH = 6  # columns up to which plain SQL sums are used; wider sums cost more to compile than Arrow costs to move
MAX_LEVELS = 4000  # levels of absorbed factors (quarters, weeks): calendar-sized, checked
FLUSH_VALUES = 4_000_000  # doubles a task holds before it hands partial sums on


@dataclass
class ClusterGrams:
    """Moment table and what is needed to read it."""

    table: DataFrame  # c, n, entities, pos array<int>, val array<double>
    columns: list[str]
    levels: list[tuple[str, str]]
    sd: dict[str, float]
    scale: dict[str, float]
    mean: dict[str, float]
    nested: bool
    sample: DataFrame = field(repr=False)
    options: dict = field(default_factory=dict, repr=False)

    @property
    def width(self) -> int:
        return len(self.columns) + len(self.levels)

    def index(self, names: Sequence[str]) -> np.ndarray:
        return np.array([self.columns.index(c) for c in names], dtype=int)

    @property
    def absorbed(self) -> np.ndarray:
        return np.arange(len(self.columns), self.width)

    @staticmethod
    def listed(parts: DataFrame) -> DataFrame:
        """One row per cluster from entries (c, pos, val); position -1 counts rows, -2 entities."""
        summed = parts.groupBy("c", "pos").agg(F.sum("val").alias("val"))
        entry = F.when(F.col("pos") >= 0, F.struct("pos", "val"))
        listed = summed.groupBy("c").agg(
            F.sum(F.when(F.col("pos") == -1, F.col("val"))).cast("long").alias("n"),
            F.coalesce(F.sum(F.when(F.col("pos") == -2, F.col("val"))), F.lit(0)).cast("long").alias("entities"),
            F.collect_list(entry).alias("m"),
        )
        return listed.select("c", "n", "entities", F.col("m.pos").alias("pos"), F.col("m.val").alias("val"))


def triangle(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def unpack(pos, val, width: int) -> np.ndarray:
    """Symmetric matrix from sparse upper-triangle entries."""
    i, j = triangle(width)
    flat = np.zeros(len(i))
    flat[np.asarray(pos, dtype=int)] = np.asarray(val, dtype=float)
    out = np.zeros((width, width))
    out[i, j] = flat
    out[j, i] = flat
    return out


def reduce_arrays(
    table: DataFrame, parts: Callable[[pd.DataFrame], dict[str, np.ndarray]]
) -> dict[str, np.ndarray]:
    """Sum fixed-size arrays over the table; tasks add up their share, Spark adds the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in parts(batch).items():
                flat = np.asarray(value, dtype=float).ravel()
                total[name] = total[name] + flat if name in total else flat
        for name, flat in total.items():
            yield pd.DataFrame({"name": name, "pos": np.arange(len(flat)), "val": flat})

    rows = (
        table.mapInPandas(run, "name string, pos long, val double")
        .groupBy("name", "pos")
        .agg(F.sum("val").alias("val"))
        .toPandas()
        .sort_values(["name", "pos"])
    )
    return {name: g["val"].to_numpy() for name, g in rows.groupby("name")}


def _emit(sums: dict[str, np.ndarray], extra: dict[str, float], extra_pos: int, width: int):
    i, j = triangle(width)
    for cluster, gram in sums.items():
        flat = gram[i, j]
        pos = np.flatnonzero(flat)
        yield pd.DataFrame({
            "c": cluster,
            "pos": np.append(pos, extra_pos).astype("int32"),
            "val": np.append(flat[pos], extra[cluster]),
        })


def _row_moments(dense: int, offsets: Sequence[int], width: int):
    """Task kernel: z z' per cluster over raw rows, dummies placed from level codes."""

    names = [f"z{i}" for i in range(dense)]

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        count: dict[str, float] = {}
        for b in batches:
            z = np.zeros((len(b), width))
            z[:, :dense] = b[names].to_numpy(float)
            for k, start in enumerate(offsets):
                z[np.arange(len(b)), start + b[f"k{k}"].to_numpy(int)] = 1.0
            for cluster, rows in b.groupby("c", sort=False).indices.items():
                part = z[rows]
                sums[cluster] = sums.get(cluster, 0.0) + part.T @ part
                count[cluster] = count.get(cluster, 0.0) + len(rows)
            if len(sums) * width * width > FLUSH_VALUES:
                yield from _emit(sums, count, -1, width)
                sums, count = {}, {}
        yield from _emit(sums, count, -1, width)

    return run


def _entity_moments(dense: int, offsets: Sequence[int], width: int, nested: bool):
    """Task kernel: what entity means explain, from one row of sums per (entity, cluster)."""

    def sums_of(b: pd.DataFrame, prefix: str) -> np.ndarray:
        out = np.zeros((len(b), width))
        out[:, :dense] = b[[f"{prefix}s{i}" for i in range(dense)]].to_numpy(float)
        if offsets and len(b):
            size = b[f"{prefix}m"].map(len).to_numpy()
            row = np.repeat(np.arange(len(b)), size)
            n = np.concatenate(b[f"{prefix}m"].to_numpy())
            for k, start in enumerate(offsets):
                np.add.at(out, (row, start + np.concatenate(b[f"{prefix}k{k}"].to_numpy()).astype(int)), n)
        return out

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        count: dict[str, float] = {}
        for b in batches:
            own = sums_of(b, "")
            n = b["n"].to_numpy(float)[:, None]
            mean = own / n if nested else sums_of(b, "w") / b["wn"].to_numpy(float)[:, None]
            for cluster, rows in b.groupby("c", sort=False).indices.items():
                s, m = own[rows], mean[rows]
                cross = s.T @ m
                gram = (m * n[rows]).T @ m - cross - cross.T
                sums[cluster] = sums.get(cluster, 0.0) + gram
                count[cluster] = count.get(cluster, 0.0) + len(rows)
            if len(sums) * width * width > FLUSH_VALUES:
                yield from _emit(sums, count, -2, width)
                sums, count = {}, {}
        yield from _emit(sums, count, -2, width)

    return run


def cluster_grams(
    df: DataFrame,
    columns: Sequence[str],
    cluster: str,
    entity: str | None = None,
    factors: Sequence[str] = (),
    centre: bool | None = None,
) -> ClusterGrams:
    """Moments of complete rows, per cluster, within entities, beside factor dummies.

    ``entity`` has any number of values; ``factors`` are small (quarter, month, week, wave).
    Columns are scaled, and centred when the absorbed effects span a constant, so that the
    matrices are well conditioned; fits return to the original scale.
    """
    columns, factors = list(columns), list(factors)
    options = dict(columns=columns, cluster=cluster, entity=entity, factors=factors, centre=centre)
    if centre is None:
        centre = entity is not None or bool(factors)
    rows = df.select(
        F.col(cluster).cast("string").alias("c"),
        (F.col(entity) if entity else F.lit("")).cast("string").alias("e"),
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)],
        *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(factors)],
    ).dropna()
    rows = cut_lineage(rows)
    stats = rows.agg(
        F.count("*").alias("n"),
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))],
        *[F.stddev_samp(f"x{i}").alias(f"s{i}") for i in range(len(columns))],
        *[F.sort_array(F.collect_set(f"f{i}")).alias(f"l{i}") for i in range(len(factors))],
    ).first()
    if stats["n"] == 0:
        raise ValueError("no complete rows for this design")
    levels = [(f, v) for i, f in enumerate(factors) for v in stats[f"l{i}"]]
    if len(levels) > MAX_LEVELS:
        raise ValueError("an absorbed factor has too many levels; pass it as the entity")
    sd = {c: float(stats[f"s{i}"] or 0.0) for i, c in enumerate(columns)}
    scale = {c: sd[c] if sd[c] > 0 else 1.0 for c in columns}
    mean = {c: float(stats[f"m{i}"]) if centre else 0.0 for i, c in enumerate(columns)}
    z = [((F.col(f"x{i}") - F.lit(mean[c])) / F.lit(scale[c])) for i, c in enumerate(columns)]
    width = len(columns) + len(levels)
    nested = entity is None or (
        rows.groupBy("e").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").isEmpty()
    )
    build = _sql_table if width <= SQL_WIDTH and nested else _kernel_table
    table = cut_lineage(build(rows, z, factors, levels, entity is not None, nested, width))
    return ClusterGrams(table, columns, levels, sd, scale, mean, nested, df, options)


def _sql_table(rows, z: list[Column], factors, levels, within: bool, nested: bool, width: int) -> DataFrame:
    z = z + [(F.col(f"f{factors.index(f)}") == F.lit(v)).cast("double") for f, v in levels]
    flat = rows.select("c", "e", *[c.alias(f"z{i}") for i, c in enumerate(z)])
    pairs = list(zip(*triangle(width)))
    moment = [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"q{i}_{j}") for i, j in pairs]
    if within:
        cells = flat.groupBy("c", "e").agg(
            F.count("*").alias("n"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(width)], *moment
        )
        net = [F.sum(F.col(f"q{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) for i, j in pairs]
        summed = cells.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("entities"), F.array(*net).alias("val"))
    else:
        summed = flat.groupBy("c").agg(
            F.count("*").alias("n"), F.lit(0).cast("long").alias("entities"),
            F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).alias("val"),
        )
    pos = F.sequence(F.lit(0), F.lit(len(pairs) - 1))
    return summed.select("c", "n", "entities", pos.alias("pos"), "val")


def _kernel_table(rows, z: list[Column], factors, levels, within: bool, nested: bool, width: int) -> DataFrame:
    dense = width - len(levels)
    offsets, codes, start = [], [], dense
    for k, f in enumerate(factors):
        names = [v for g, v in levels if g == f]
        offsets.append(start)
        codes.append(F.array_position(F.array(*[F.lit(v) for v in names]), F.col(f"f{k}")).cast("int") - 1)
        start += len(names)
    coded = rows.select(
        "c", "e", *[c.alias(f"z{i}") for i, c in enumerate(z)], *[c.alias(f"k{i}") for i, c in enumerate(codes)]
    )
    schema = "c string, pos int, val double"
    parts = coded.drop("e").mapInPandas(_row_moments(dense, offsets, width), schema)
    if within:
        # equal (entity, level) rows collapse first, so an entity's list is as long as its levels
        level_codes = [f"k{i}" for i in range(len(offsets))]
        cells = coded.groupBy("c", "e", *level_codes).agg(
            F.count("*").alias("m"), *[F.sum(f"z{i}").alias(f"s{i}") for i in range(dense)]
        )
        parts = parts.unionByName(entity_moments(cells, dense, offsets, width, nested))
    return ClusterGrams.listed(parts)


def entity_moments(cells: DataFrame, dense: int, offsets: Sequence[int], width: int, nested: bool) -> DataFrame:
    """What entity means explain, from sums ``s0..`` and sizes ``m`` per (c, e, level codes ``k0..``)."""
    level_codes = [f"k{i}" for i in range(len(offsets))]

    def per_entity(keys: list[str], prefix: str) -> DataFrame:
        listed = F.collect_list(F.struct(*level_codes, "m")).alias("_l")
        own = cells.groupBy(*keys).agg(
            F.sum("m").alias(f"{prefix}n"),
            *[F.sum(f"s{i}").alias(f"{prefix}s{i}") for i in range(dense)],
            *([listed] if offsets else []),
        )
        if not offsets:
            return own
        parts = [F.col(f"_l.{k}").alias(f"{prefix}{k}") for k in [*level_codes, "m"]]
        return own.select(*[c for c in own.columns if c != "_l"], *parts)

    both = per_entity(["c", "e"], "")
    if not nested:
        both = both.join(per_entity(["e"], "w"), "e")
    return both.drop("e").mapInPandas(_entity_moments(dense, offsets, width, nested), "c string, pos int, val double")
