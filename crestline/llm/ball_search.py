"""Ranked lexical search: exact inner products over sparse ball trees of documents.

What items can meet of a document is a sparse vector over the items' terms.  Trees of some
thousand documents are split at the median between two far documents; each node keeps its centroid
and the radius that holds all its documents.  By Cauchy and Schwarz no document of a node scores
more than the query's product with the centroid plus the query's length, over terms that the node
has at all, times the radius.  Nodes are opened best first while that bound reaches the score that
is still needed; leaves are scored in 64-bit integers, so results are exact.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from crestline.llm.staging import staged
from crestline.llm.texts import flat, slices, words

#: Documents of a tree and of a leaf, leaves that the first search opens; text bytes of the items that one pass looks for.
TREE, LEAF, OPENED, BLOCK_BYTES = 8192, 32, 4, 64 << 10
LAST = (1 << 63) - 1


@dataclass
class Items:
    """A block of items: their keys and, item by item, the distinct terms as codes into ``terms``."""

    keys: list
    terms: pa.Array
    codes: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        found = words(*flat(pa.array([t for _, t in rows], pa.large_string())))
        codes, terms = found.codes()
        return cls([k for k, _ in rows], terms, [np.unique(codes[a:b]) for a, b in zip(found.rows[:-1], found.rows[1:], strict=True)])


@dataclass
class Weights:
    """Corpus statistics: documents with terms, all their terms, and the weight of each of the block's terms."""

    documents: int
    length: int
    weight: np.ndarray

    @classmethod
    def of(cls, documents: int, length: int, held: np.ndarray) -> Weights:
        return cls(documents, length, np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64))

    def worth(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each occurrence count is worth in a document of n terms, before the term's weight."""
        if int(n.max(initial=0)) * 50 * self.documents >= 1 << 63:
            n = n.astype(object)
        m = (50 + (50 * n * self.documents) // self.length).astype(np.int64)
        return (1_000_000_000 * times) // (1000 * times + 20 * m)


class BallTree:
    """A tree over the rows of a sparse matrix with entries ``value`` at ``term``, row r at ``first[r]:first[r + 1]``.

    Levels are halves of halves; node k of a level has rows ``cuts[k]:cuts[k + 1]``.
    """

    def __init__(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, width: int, leaf: int = LEAF):
        n = len(first) - 1
        x, size = value.astype(np.float64), np.diff(first)
        squares = np.add.reduceat(x * x, first[:-1])
        self.rows = np.arange(n)
        depth = max(0, math.ceil(math.log2(max(n, 1) / leaf)))
        self.cuts = [np.array([0, n])]
        for _ in range(depth):
            self._split(first, term, x, size, squares, width)
        self.first = np.concatenate([[0], np.cumsum(size[self.rows])])
        take = np.repeat(first[self.rows] - self.first[:-1], size[self.rows]) + np.arange(self.first[-1])
        self.term, self.value, self.width = term[take], value[take], width
        self._bounds(x[take], squares[self.rows], width)

    def _split(self, first, term, x, size, squares, width) -> None:
        cuts, rows = self.cuts[-1], self.rows
        node = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        start = np.concatenate([[0], np.cumsum(size[rows])])
        take = np.repeat(first[rows] - start[:-1], size[rows]) + np.arange(start[-1])
        term, x = term[take], x[take]
        entry = np.repeat(node, size[rows]) * width + term
        products = []
        far = cuts[:-1]
        for _ in range(3):  # any row, one far from it, one far from that
            pivot = np.zeros((len(far), width))
            spans = np.repeat(np.arange(len(far)), size[rows[far]])
            at = np.concatenate([np.arange(start[f], start[f + 1]) for f in far])
            pivot[spans, term[at]] = x[at]
            products.append(np.add.reduceat(x * pivot.ravel()[entry], start[:-1]))
            distance = squares[rows] - 2 * products[-1]
            order = np.lexsort((distance, node))
            far = order[cuts[1:] - 1]
        order = np.lexsort((products[1] - products[2], node))
        self.rows = rows[order]
        self.cuts.append(np.sort(np.concatenate([cuts, (cuts[:-1] + cuts[1:]) // 2])))

    def _bounds(self, x: np.ndarray, squares: np.ndarray, width: int) -> None:
        """Centroids and radii of all levels, radii rounded up by more than their arithmetic can be off."""
        self.centre, self.radius = [], []
        size = np.diff(self.first)
        sums = None
        unsure = 8 * (width + 16) * 2.0**-53
        for cuts in reversed(self.cuts):
            count = np.diff(cuts)
            if sums is None:
                owner = np.repeat(np.arange(len(count)), count)
                sums = np.bincount(np.repeat(owner, size) * width + self.term, x, len(count) * width).reshape(len(count), width)
            else:
                sums = sums[0::2] + sums[1::2]
            centre = sums / np.maximum(count, 1)[:, None]
            owner = np.repeat(np.arange(len(count)), count)
            inner = np.add.reduceat(x * centre.ravel()[np.repeat(owner, size) * width + self.term], self.first[:-1])
            own = (centre * centre).sum(axis=1)
            gap = np.maximum(squares - 2 * inner + own[owner], 0) + unsure * (squares + own[owner])
            self.centre.insert(0, centre)
            self.radius.insert(0, np.sqrt(np.maximum.reduceat(gap, cuts[:-1])) * (1 + 1e-12))

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """By level and node, what no row's product with the query can exceed."""
        q, out = weight.astype(np.float64), []
        for centre, radius in zip(self.centre, self.radius, strict=True):
            near = centre[:, terms]
            length = np.sqrt((near > 0) @ (q * q))
            out.append((near @ q + length * radius) * (1 + 1e-9) + 1)
        return out

    def search(self, terms: np.ndarray, weight: np.ndarray, keys: np.ndarray, limit: int, least: int, leaves: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of score ``least`` or more, at most the best ``limit`` (ties by key), their scores, and how many were scored.

        With ``leaves``, only so many of the best leaves are looked at.
        """
        bound, deepest = self.bounds(terms, weight), len(self.cuts) - 1
        full = np.zeros(self.width, np.int64)
        full[terms] = weight
        heap, rows, scores, seen = [(-float(bound[0][0]), 0, 0)], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while heap and -heap[0][0] >= least and leaves != 0:
            _, level, node = heapq.heappop(heap)
            if level < deepest:
                for k in (2 * node, 2 * node + 1):
                    if bound[level + 1][k] >= least:
                        heapq.heappush(heap, (-float(bound[level + 1][k]), level + 1, k))
                continue
            a, b = self.cuts[level][node], self.cuts[level][node + 1]
            some = slice(self.first[a], self.first[b])
            score = np.add.reduceat(full[self.term[some]] * self.value[some], self.first[a:b] - self.first[a])
            good = np.flatnonzero(score >= least)
            seen += b - a
            leaves = None if leaves is None else leaves - 1
            if len(good):
                rows, scores = np.concatenate([rows, self.rows[a + good]]), np.concatenate([scores, score[good]])
                if len(rows) >= limit:
                    best = np.lexsort((keys[rows], -scores))[:limit]
                    rows, scores = rows[best], scores[best]
                    least = int(scores[-1])
        return rows, scores, seen


def document_terms(docs: DataFrame, shared) -> DataFrame:
    """Per document with terms: ``k``, ``n`` (all terms), and codes and counts of the block's terms in it."""

    def find(batches):
        terms = shared.value.terms
        for batch in batches:
            for part in slices(batch, "t"):
                found = words(*flat(part.column("t")))
                codes, distinct = found.codes()
                known = pc.index_in(distinct, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                code, row = known[codes] if len(codes) else codes.astype(np.int64), found.row_of()
                pair, times = np.unique((row * max(len(terms), 1) + code)[code >= 0], return_counts=True)
                n = np.diff(found.rows)
                bounds = np.searchsorted(pair // max(len(terms), 1), np.arange(len(n) + 1))
                rows = pa.record_batch({
                    "k": part.column("k"), "n": pa.array(n.astype(np.int64)),
                    "terms": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pair % max(len(terms), 1), pa.int32())),
                    "times": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(times, pa.int32())),
                })
                yield rows.filter(pa.array(n > 0))

    return docs.mapInArrow(find, "k long, n long, terms array<int>, times array<int>")


def _weights(found: DataFrame, n_terms: int) -> Weights:
    """Statistics of all documents; the driver gets one number per term of the block."""

    def count(batches):
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        some = np.flatnonzero(held)
        yield pa.record_batch({"term": pa.array(some), "df": pa.array(held[some])})

    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    held = np.zeros(n_terms, np.int64)
    for r in found.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        held[r["term"]] = r["df"]
    return Weights.of(total["n"], max(total["l"], 1), held)


def _trees(batches, weights: Weights, leaf: int, tree: int):
    """Trees over consecutive documents of a partition, with their keys."""
    held, n = [], 0

    def built():
        table = pa.Table.from_batches(held).combine_chunks()
        size = pc.list_value_length(table.column("terms")).to_numpy().astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        term = table.column("terms").combine_chunks().flatten().to_numpy().astype(np.int64)
        times = table.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
        value = weights.worth(times, np.repeat(table.column("n").to_numpy(), size))
        return BallTree(first, term, value, len(weights.weight), leaf), table.column("k").to_numpy()

    for batch in batches:
        while batch.num_rows:
            part, batch = batch.slice(0, tree - n), batch.slice(tree - n)
            held.append(part)
            n += part.num_rows
            if n == tree:
                yield built()
                held, n = [], 0
    if n:
        yield built()


def _searched(found: DataFrame, shared, weights: Weights, least: np.ndarray, limit: int, leaf: int, tree: int, leaves: int | None = None) -> DataFrame:
    """Rows (item, k, score) that each tree returns; ``item`` is the place in the block."""

    def search(batches):
        items: Items = shared.value
        for ball, keys in _trees(batches, weights, leaf, tree):
            who, key, got = [], [], []
            for i, terms in enumerate(items.codes):
                if len(terms):
                    rows, scores, _ = ball.search(terms, weights.weight[terms], keys, limit, int(least[i]), leaves)
                    who.append(np.full(len(rows), i, np.int32))
                    key.append(keys[rows])
                    got.append(scores)
            if who:
                yield pa.record_batch({"item": pa.array(np.concatenate(who)), "k": pa.array(np.concatenate(key)), "score": pa.array(np.concatenate(got))})

    return found.mapInArrow(search, "item int, k long, score long")


def _best(rows: DataFrame, limit: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "k"))).where(F.col("rank") <= limit)


def ranked_documents(
    docs: DataFrame, items: DataFrame, limit: int = 50, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    leaf: int = LEAF, tree: int = TREE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each item's ``limit`` highest-scoring documents: ``item``, ``rank`` (from 1), ``key``, ``score``.

    Scores above 0 only, equal scores by ascending key, null keys last.  Statistics cover all
    documents.  Null and empty texts have no terms, and items without terms have no rows; repeated
    documents and items count and are ranked each by itself; empty tables give no rows; other columns are not read.

    Items are taken in blocks of about ``block_bytes``.  A block reads the texts once and writes
    what its terms meet; a first search opens each tree's ``OPENED`` best leaves, and the score that its
    ``limit``-th best document of all trees has is what the second search needs at least.
    """
    spark = docs.sparkSession
    kind = items.schema[item].dataType
    all_items = items.where(F.octet_length(item_text) > 0).select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    total = all_items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("k"), F.col(text).alias("t"))
    out = None
    for b in range(blocks):
        mine = all_items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) if blocks > 1 else all_items
        block = Items.of([(r["i"], r["t"]) for r in mine.collect()])
        shared = spark.sparkContext.broadcast(block)
        found = staged(document_terms(texts, shared), "document-terms")
        weights = _weights(found, len(block.terms))
        some, n = found.where(F.size("terms") > 0), len(block.keys)
        first = _best(_searched(some, shared, weights, np.ones(n, np.int64), limit, leaf, tree, leaves=OPENED), limit)
        least = np.ones(n, np.int64)
        for r in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == limit).collect():  # a number per item
            least[r["item"]] = r["s"]
        best = _best(_searched(some, shared, weights, least, limit, leaf, tree), limit)
        names = spark.createDataFrame([(i, k) for i, k in enumerate(block.keys)], f"item int, `{item}` {kind.simpleString()}")
        result = best.join(names, "item").select(item, "rank", F.nullif("k", F.lit(LAST)).alias(key), "score")
        out = result if out is None else out.unionByName(result)
    return out
