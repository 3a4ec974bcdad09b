"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of a few dimensions.  Two vectors within squared
distance B lie, in at least one block, within the block's share of B, so joining each block under
its share finds every pair.  A candidate counts in the first block that has it, so the union of
all blocks needs no shuffle of pairs, and is checked exactly where it is found.

A vector goes to many cells, so labels that are not very large are one block and one cell: their
tiles are multiplied whole, and products too close to the threshold are checked exactly.

Pairs never leave the task that finds them: a task returns, for each of its vectors with a link,
how many rows it is linked with and the least vector that its links lead to.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crestline.llm.components import components
from crestline.llm.staging import staged
from crestline.llm.texts import mixed

#: Dimensions of a block.
BLOCK = 8
#: Vectors of one cell that a task compares at once; a fuller cell is dealt out as tiles of pairs.
TILE = 16384
#: Vectors up to which a label is one cell: each is sent to a task per tile then, to some tens of cells otherwise.
WHOLE = 1 << 19
#: Products that are looked at at once.
PRODUCTS = 1 << 21
#: What squared distances may be off by: coordinates are in single precision.
SLACK = 1e-5


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation: spreads what differs between two vectors over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(dims).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def turned(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors in single precision; a row's result does not depend on the rows beside it."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.einsum("ij,jk->ik", unit, rotation(x.shape[1]), optimize=False).astype(np.float32)


def block_bounds(dims: int, budget: float) -> tuple[list[int], np.ndarray]:
    """First dimension of each block, and its share of the squared distance."""
    firsts = list(range(0, dims, BLOCK))
    sizes = np.diff([*firsts, dims])
    return firsts, budget * sizes / dims + SLACK


def _placed(reps: DataFrame, budget: float, axes: int) -> DataFrame:
    """Each vector once per block and cell that its ball reaches: ``home`` marks its own cell.

    Cells are cubes over the block's first ``axes`` dimensions with sides of four radii.
    """

    def place(batches):
        for batch in batches:
            sizes = np.array(batch.column("dims"))
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                coords = turned(_matrix(part.column("v"), dims)).astype(np.float64)
                for k, (first, share) in enumerate(zip(*block_bounds(dims, budget), strict=True)):
                    near = coords[:, first : min(first + min(axes, BLOCK), dims)] / (4 * np.sqrt(share + SLACK))
                    own = np.floor(near).astype(np.int64)
                    low, high = np.floor(near - 0.25).astype(np.int64), np.floor(near + 0.25).astype(np.int64)
                    for step in product((0, 1), repeat=near.shape[1]):
                        up = np.array(step)
                        reach = ((low < high) | (up == 0)).all(axis=1)
                        cell = np.where(up == 1, high, low)[reach]
                        code = np.full(len(cell), k, np.uint64)
                        for c in cell.T:
                            code = mixed(code ^ mixed(c.astype(np.uint64)))
                        some = part.filter(pa.array(reach))
                        yield pa.record_batch({
                            "label": some.column("label"), "dims": some.column("dims"), "block": pa.array(np.full(len(cell), k, np.int32)), "cell": pa.array(code.astype(np.int64)),
                            "home": pa.array((cell == own[reach]).all(axis=1)), "id": some.column("id"), "n": some.column("n"), "v": some.column("v"),
                        })

    kind = reps.schema["v"].dataType.simpleString()
    return reps.select("label", "dims", "id", "n", "v").mapInArrow(place, f"label long, dims int, block int, cell long, home boolean, id long, n long, v {kind}")


class Met:
    """What the links of a task come to: per vector the rows it is linked with, and the least vector it is joined to."""

    def __init__(self, group: pa.Table):
        ids, self.at = np.unique(np.array(group.column("id")), return_inverse=True)
        self.ids, self.n = ids, np.zeros(len(ids), np.int64)
        self.n[self.at] = np.array(group.column("n"))
        self.linked, self.least = np.zeros(len(ids), np.int64), np.arange(len(ids))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        """Links between rows of the group."""
        p, q = self.at[p], self.at[q]
        for a, b in ((p, q), (q, p)):
            self.linked += np.bincount(a, self.n[b], len(self.ids)).astype(np.int64)
        a, b = self.least[p], self.least[q]
        while len(a := a[apart := a != b]):
            b = b[apart]
            np.minimum.at(self.least, np.maximum(a, b), np.minimum(a, b))
            while (self.least != (up := self.least[self.least])).any():
                self.least = up
            a, b = self.least[a], self.least[b]

    def table(self) -> pa.Table:
        some = np.flatnonzero(self.linked)
        return pa.table({"id": pa.array(self.ids[some]), "linked": pa.array(self.linked[some]), "least": pa.array(self.ids[self.least[some]])})


MET = "id long, linked long, least long"


def _tile_links(threshold: float):
    """Links of two tiles of a label, or within one: products in single precision, exact ones where these leave it open."""

    def find(group: pa.Table) -> pa.Table:
        met, side = Met(group), np.array(group.column("side"))
        dims = group.column("dims")[0].as_py()
        x = _matrix(group.column("v"), dims)
        length = np.sqrt((x * x).sum(axis=1))
        sound = (length > 0) & np.isfinite(length)  # squares may leave the range of doubles: no links then
        unit = (np.where(sound[:, None], x, 0.0) / np.where(sound, length, 1.0)[:, None]).astype(np.float32)
        unsure = 1e-5 + 4e-7 * dims  # more than rounding comes to
        own = not side.any()
        left, right = np.flatnonzero(side == 0), np.arange(len(x)) if own else np.flatnonzero(side == 1)
        other, step = unit[right], max(1, PRODUCTS // max(len(right), 1))
        for first in range(0, len(left), step):
            some = left[first : first + step]
            begin = first if own else 0  # within a tile each pair once
            product = unit[some] @ other[begin:].T
            i, j = np.nonzero(product >= threshold - unsure)
            near = product[i, j]
            p, q = some[i], right[begin + j]
            keep = np.ones(len(p), bool) if not own else p < q
            open_ = np.flatnonzero(keep & (near < threshold + unsure))
            for a in range(0, len(open_), 1 << 16):
                at = open_[a : a + (1 << 16)]
                keep[at] = (x[p[at]] * x[q[at]]).sum(axis=1) / (length[p[at]] * length[q[at]]) >= threshold
            met.add(p[keep], q[keep])
        return met.table()

    return find


def _links(threshold: float):
    """Links of a tile of one block: pairs within the block's share, unless an earlier block has them, checked exactly."""
    budget = 2 - 2 * threshold

    def find(group: pa.Table) -> pa.Table:
        met = Met(group)
        dims, block = group.column("dims")[0].as_py(), group.column("block")[0].as_py()
        x = _matrix(group.column("v"), dims)
        coords = turned(x).astype(np.float64)
        firsts, shares = block_bounds(dims, budget)
        mine = coords[:, firsts[block] : firsts[block] + BLOCK]
        ids, side = np.array(group.column("id")), np.array(group.column("side"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y, norms, length = mine[right], (mine[right] ** 2).sum(axis=1), np.sqrt((x * x).sum(axis=1))
        for first in range(0, len(left), 256):
            some = left[first : first + 256]
            gap = (mine[some] ** 2).sum(axis=1)[:, None] + norms - 2 * mine[some] @ y.T
            i, j = np.nonzero((gap <= shares[block] + SLACK) & (ids[some][:, None] < ids[right]))
            for begin in range(0, len(i), 1 << 16):
                p, q = some[i[begin : begin + (1 << 16)]], right[j[begin : begin + (1 << 16)]]
                apart = np.add.reduceat((coords[p] - coords[q]) ** 2, firsts, axis=1) <= shares
                p, q = (w[(apart.argmax(axis=1) == block) & apart[:, block]] for w in (p, q))
                cosine = (x[p] * x[q]).sum(axis=1) / (length[p] * length[q])
                met.add(p[cosine >= threshold], q[cosine >= threshold])
        return met.table()

    return find


def linked_vectors(reps: DataFrame, threshold: float, tile: int = TILE, whole: int = WHOLE) -> DataFrame:
    """Over all pairs of distinct vectors of one label and length with a cosine of at least ``threshold``, each met
    once: what they come to in each task that met some (``Met``)."""
    sizes = reps.groupBy("label", "dims").agg(F.count("*").alias("size"))
    most = sizes.agg(F.max("size")).first()[0] or 1
    spot = ["label", "dims"]
    tiled = reps.join(sizes.where(F.col("size") <= whole), spot).withColumn("s", F.ceil(F.col("size") / tile).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("s")).cast("int")
    dealt = tiled.select(*spot, "id", "n", "v", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("k"))
    pairs = dealt.select(*spot, "id", "n", "v", (F.col("mine") > F.col("k")).cast("int").alias("side"), F.least("mine", "k").alias("i"), F.greatest("mine", "k").alias("j"))
    found = pairs.groupBy(*spot, "i", "j").applyInArrow(_tile_links(threshold), MET)
    if most <= whole:
        return found
    return found.unionByName(_linked_in_cells(reps.join(sizes.where(F.col("size") > whole).drop("size"), spot, "left_semi"), most, threshold, tile))


def _linked_in_cells(reps: DataFrame, most: int, threshold: float, tile: int) -> DataFrame:
    axes = int(np.clip(np.ceil(np.log(max(most, 2) / 2048) / np.log(2.5)), 1, BLOCK))
    placed = staged(_placed(reps, 2 - 2 * threshold, axes), "blocks")
    spot = ["label", "dims", "block", "cell"]
    full = placed.groupBy(*spot).agg(F.count("*").alias("many")).where(F.col("many") > tile)
    tiled = placed.join(full, spot, "left").withColumn("s", F.ceil(F.coalesce("many", F.lit(1)) / tile).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("s")).cast("int")
    all_ = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    homes = tiled.where("home").select(*spot, "id", "n", "v", F.lit(0).alias("side"), mine.alias("i"), all_.alias("j"))
    others = tiled.select(*spot, "id", "n", "v", F.lit(1).alias("side"), all_.alias("i"), mine.alias("j"))
    return homes.unionByName(others).groupBy(*spot, "i", "j").applyInArrow(_links(threshold), MET)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", tile: int = TILE, whole: int = WHOLE
) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label (not null) and one length are linked where their cosine, in double
    precision, is at least ``threshold``.  A vector that is null, empty, zero or holds null or
    non-finite components links with nothing.  Equal vectors are compared once, for all of their
    copies.  Repeated keys keep a row each; a null key gets no links; an empty table gives no
    rows; other columns are not read.
    """
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = F.col("v").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda c: c != 0)
    own = own.withColumn("sound", F.coalesce(sound & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False)))
    reps = staged(own.where("sound").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("dims", F.size("v")), "vectors")
    met = staged(linked_vectors(reps, threshold, tile, whole), "links")
    degree = met.groupBy("id").agg(F.sum("linked").alias("linked"))
    group = components(met.select(F.col("id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("id"), "component")
    # sizes of written tables are those of packed files: no side is broadcast by them
    classes = reps.join(degree.hint("merge"), "id", "left").join(group.hint("merge"), "id", "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"),
    )
    out = own.join(classes, F.col("sound") & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
