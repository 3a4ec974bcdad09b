"""Near-duplicate documents by order MinHash, checked by banded alignment.

A text is its sequence of five-word shingles, each labelled with how often it has occurred before,
so that no element repeats.  A sketch takes the few shingles of least hash value and keeps them in
text order: two texts share it only if they hold the same shingles in the same order, which
follows edit similarity.  Candidates are checked by aligning the two sequences.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from crestline.llm.components import components
from crestline.llm.staging import staged
from crestline.llm.texts import Words, flat, mixed, slices, words

#: Words of a shingle, sketches per text, shingles per sketch.
SHINGLE, SKETCHES, DEPTH = 5, 16, 3
SIMILARITY = 0.8
#: Text bytes of one bucket that are compared at once; a fuller bucket is dealt out as tiles of pairs.
TILE_BYTES = 8 << 20

_ROUNDS = mixed(np.arange(2 * 4096, dtype=np.uint64) + np.uint64(77)).reshape(2, -1)


def shingles(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles of all rows in text order, and the rows' n + 1 offsets; a shorter text is one shingle."""
    n_words = np.diff(found.rows)
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, (n_words > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    if not ends[-1]:
        return np.zeros(0, np.uint64), ends
    row = np.repeat(np.arange(len(counts)), counts)
    first = found.rows[row] + np.arange(ends[-1]) - ends[row]
    last = found.rows[row + 1]
    h = found.hashes()
    code = np.zeros(len(row), np.uint64)
    for k in range(SHINGLE):
        at = first + k
        word = np.where(at < last, h[np.minimum(at, len(h) - 1)], np.uint64(0))
        code = mixed(code ^ word)
    order = np.argsort(code ^ mixed(row.astype(np.uint64)), kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = (code[order[1:]] == code[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    if same.any():
        run = np.arange(len(order))
        start = np.maximum.accumulate(np.where(same, 0, run))
        times = np.zeros(len(order), np.uint64)
        times[order] = (run - start).astype(np.uint64)
        again = times > 0
        code[again] = mixed(code[again] + times[again])
    return code, ends


def sketches(code: np.ndarray, ends: np.ndarray, n: int = SKETCHES, depth: int = DEPTH) -> np.ndarray:
    """``n`` sketches per row (rows without shingles get zeros): the ``depth`` least shingles, hashed in text order."""
    out = np.zeros((len(ends) - 1, n), np.uint64)
    has = np.flatnonzero(np.diff(ends) > 0)
    if not len(has):
        return out
    starts, sizes = ends[:-1][has], np.diff(ends)[has]
    row = np.repeat(np.arange(len(has)), sizes)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for m in range(n):
        value = (code ^ _ROUNDS[0, m]) * (_ROUNDS[1, m] | np.uint64(1))
        value ^= value >> np.uint64(29)
        places = np.zeros((depth, len(has)), np.int64)
        for d in range(depth):
            least = np.minimum.reduceat(value, starts)
            hit = np.flatnonzero(value == least[row])
            places[d, row[hit[::-1]]] = hit[::-1]
            value[hit] = top
        places.sort(axis=0)
        sketch = np.zeros(len(has), np.uint64)
        for d in range(depth):
            sketch = mixed(sketch ^ code[places[d]])
        out[has, m] = sketch
    return out


def aligned(at: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences without repeats: ``at[i]`` is where element i stands in the
    other one, -1 for nowhere.  Only matches within ``band`` of the diagonal count."""
    i = np.flatnonzero(at >= 0)
    j = at[i]
    j = j[np.abs(i - j) <= band]
    if (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def linked(code: np.ndarray, ends: np.ndarray, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join all rows whose shingles align well enough, directly or through others; a spanning forest.

    Each row is compared once with all that no link has reached yet.
    """
    n = len(ends) - 1
    distinct, ids = np.unique(code, return_inverse=True)
    place = np.full(len(distinct), -1, np.int64)
    sizes = np.diff(ends)
    waiting, links = np.arange(n), []
    while len(waiting):
        queue, waiting = [int(waiting[0])], waiting[1:]
        while queue and len(waiting):
            x = queue.pop()
            if not sizes[x]:
                continue
            mine = ids[ends[x] : ends[x + 1]]
            place[mine] = np.arange(len(mine))
            low, high = sizes[x] * similarity, sizes[x] / similarity
            near = waiting[(sizes[waiting] >= low) & (sizes[waiting] <= high) & (sizes[waiting] > 0)]
            reached = []
            if len(near):
                take = np.repeat(ends[near] - (np.cumsum(sizes[near]) - sizes[near]), sizes[near]) + np.arange(sizes[near].sum())
                at = place[ids[take]]
                begin = np.concatenate([[0], np.cumsum(sizes[near])])
                common = np.add.reduceat((at >= 0).astype(np.int64), begin[:-1])
                need = np.ceil((sizes[near] + sizes[x]) * similarity / (1 + similarity) - 1e-9)
                for k in np.flatnonzero(common >= need).tolist():
                    if aligned(at[begin[k] : begin[k + 1]], int(sizes[near[k]] + sizes[x] - 2 * need[k])) >= need[k]:
                        reached.append(int(near[k]))
            place[mine] = -1
            if reached:
                links += [(x, y) for y in reached]
                queue += reached
                waiting = waiting[~np.isin(waiting, reached)]
    return links


def _sketched(docs: DataFrame, n: int, depth: int) -> DataFrame:
    def sketch(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(*flat(part.column("text")))
                code, ends = shingles(found)
                made = sketches(code, ends, n, depth)
                hashes = found.hashes()
                names, values = [], part.column("text")
                for r, (a, b) in enumerate(zip(found.rows[:-1].tolist(), found.rows[1:].tolist(), strict=True)):
                    names.append(xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else b"text" + xxhash.xxh3_128_digest(values[r].as_py() or ""))
                yield pa.record_batch({
                    "id": part.column("id"), "same": pa.array(names, pa.binary()), "bytes": pa.array(np.diff(found.bounds[found.rows])),
                    "sketch": pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * n), pa.array(made.astype(np.int64).ravel())),
                })

    return docs.mapInArrow(sketch, "id long, same binary, bytes long, sketch array<long>")


def _by_bucket(similarity: float):
    """Links within each bucket of a partition that is sorted by bucket."""

    def link(batches):
        spot, ids, texts = None, [], []

        def flush():
            order = np.argsort(np.array(ids, np.int64), kind="stable").tolist()
            code, ends = shingles(words(*flat(pa.array([texts[i] for i in order], pa.large_string()))))
            pairs = linked(code, ends, similarity)
            mine = [ids[i] for i in order]
            return pa.record_batch({"a": pa.array([mine[x] for x, _ in pairs], pa.int64()), "b": pa.array([mine[y] for _, y in pairs], pa.int64())})

        for batch in batches:
            for key, one, text in zip(zip(*(batch.column(c).to_pylist() for c in ("m", "s", "i", "j")), strict=True), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key != spot:
                    if len(ids) > 1:
                        yield flush()
                    spot, ids, texts = key, [], []
                ids.append(one)
                texts.append(text)
        if len(ids) > 1:
            yield flush()

    return link


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", text: str = "text", n: int = SKETCHES, depth: int = DEPTH, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """One row per document: ``key``, ``class_id`` (the smallest key of its class) and ``kept`` (it is that document).

    Similarity is common / (a + b - common) for the aligned labelled shingles of two texts.
    Classes join what is linked directly or through others.  Texts of the same words are one
    class, whatever their case and signs; texts without words only where they are equal.  Null
    texts and null keys are classes of their own (``class_id`` is the key, kept).  Repeated rows
    share a class and a key; an empty table gives no rows; other columns are not read.

    A pair at the limit of 0.8 shares a sketch of three with chance 0.5 or more, so one of
    sixteen joins it but for 1 in 50,000; pairs in a bucket are all compared, in tiles where the
    bucket is large, and reported as a spanning forest of links rather than as pairs.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sound = own.where(F.col("id").isNotNull() & F.col("text").isNotNull())
    marked = staged(_sketched(sound, n, depth), "sketches")
    reps = marked.groupBy("same").agg(F.min("id").alias("id"), F.first("bytes").alias("bytes"), F.first("sketch").alias("sketch"))
    spread = reps.where("bytes > 0").select("id", "bytes", F.posexplode("sketch").alias("m", "s"))
    spread = staged(spread, "buckets")
    filled = spread.groupBy("m", "s").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("n > 1")
    # buckets of the same members are one
    filled = filled.groupBy("n", "bytes", "x", "y").agg(F.min(F.struct("m", "s")).alias("b")).select("b.m", "b.s", F.ceil(F.col("bytes") / tile_bytes).cast("int").alias("chunks"))
    inside = spread.select("m", "s", "id").join(filled, ["m", "s"]).withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    inside = inside.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("id", "m", "s", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    members = staged(inside, "members")
    wanted = members.select("id").distinct()
    # joins by key at every size: texts are dealt once, members follow them
    texts = sound.join(wanted.hint("merge"), "id", "left_semi").dropDuplicates(["id"])
    dealt = members.hint("merge").join(texts, "id").repartition("m", "s", "i", "j").sortWithinPartitions("m", "s", "i", "j")
    links = dealt.mapInArrow(_by_bucket(similarity), "a long, b long")
    group = components(links).select(F.col("node").alias("id"), "component")
    classes = reps.join(group, "id", "left").select("same", F.coalesce("component", "id").alias("class_id"))
    found = marked.select("id", "same").join(classes, "same").select(F.col("id").alias(key), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
    alone = own.where(F.col("id").isNull() | F.col("text").isNull()).select(F.col("id").alias(key), F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each class with all its columns; of repeated rows of a kept key one stays."""
    classes = near_duplicates(docs, key=key, text=text, **settings)
    gone = classes.where("not kept").select(key).distinct()
    stay = docs.where(F.col(key).isNotNull()).join(gone.hint("merge"), key, "left_anti").select(docs.columns)
    return stay.dropDuplicates([key]).unionByName(docs.where(F.col(key).isNull()))
