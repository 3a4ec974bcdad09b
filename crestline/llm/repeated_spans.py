"""Exact removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every string of ``size`` bytes stands for the suffix it begins.  Only suffixes that may repeat are
sorted: a string is filed under the least hash value among its 32-byte parts (equal strings choose
the same part), and what is filed under a part that occurs once in the corpus is unique.  The rest
is ordered by digits of eight bytes, most significant first, through ``size`` bytes and no
further; groups that a digit does not split are not sorted again and single suffixes leave.  The
groups that are left are exactly the repeated strings.  Strings under a part that is in very many
places are dealt by more of their bytes, in the end by all, so no task holds all that is around it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from crestline.llm.texts import BYTE_VALUES, flat, mixed, slices

SIZE, PART = 100, 32
#: Text bytes looked at together when anchors are chosen; text bytes that one partition of anchors stands for.
CHUNK_BYTES, PARTITION_BYTES = 1 << 20, 32 << 20
#: Pieces of an anchor from which on they are split and dealt apart; pieces laid out together.
HOT, BLOCK = 1 << 16, 1 << 14
#: In a packed place: the chunk holds the anchor several times.
KNOWN = 1 << 62


def part_values(data: np.ndarray) -> np.ndarray:
    """A 64-bit value of the 32 bytes from each place on."""
    with np.errstate(over="ignore"):
        h, factor = BYTE_VALUES[data], 0x9E3779B97F4A7C15
        for k in (1, 2, 4, 8, 16):
            h = h[:-k] * np.uint64(factor) + h[k:]
            factor = factor * factor % (1 << 64)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def anchors(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of ``size`` bytes within rows: row, place in the row, farthest and nearest
    distance of the starts of its strings before it, and the anchor's value."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    if len(data) < size:
        return none
    value = part_values(data)
    width = size - PART + 1
    best, at, covered = value, np.arange(len(value), dtype=np.int32), 1
    while covered < width:
        step = min(covered, width - covered)
        right = best[step:] < best[:-step]
        at = np.where(right, at[step:], at[:-step])
        best = np.where(right, best[step:], best[:-step])
        covered += step
    whole = np.zeros(len(at) + 1, np.int64)
    n = np.diff(offsets) - size
    rows = np.flatnonzero(n >= 0)
    np.add.at(whole, offsets[:-1][rows], 1)
    np.add.at(whole, offsets[:-1][rows] + n[rows] + 1, -1)
    starts = np.flatnonzero(np.cumsum(whole[:-1]) > 0)
    if not len(starts):
        return none
    chosen, row = at[starts].astype(np.int64), np.searchsorted(offsets, starts, "right") - 1
    fresh = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(starts)) - 1
    place, row = chosen[head], row[head]
    return row, place - offsets[row], place - starts[head], place - starts[tail], value[place]


def _anchor_rows(size: int):
    """Rows (k, h, id, p): h files the anchor (null: k does), p packs place and distances, k says where the row is dealt.

    Anchors that a chunk holds several times are known to repeat: they are dealt anywhere, and one
    marker (p = -1) goes where h belongs.  So a part that is everywhere sends no more than one or
    two rows per chunk to its place.
    """

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                row, place, far, near, value = anchors(*flat(part.column("text")), size)
                if not len(row):
                    continue
                _, back, times = np.unique(value, return_inverse=True, return_counts=True)
                known = times[back] > 1
                ids = part.column("id").to_numpy()[row]
                packed = (place << 14) | (far << 7) | near
                apart = mixed(value ^ mixed(packed.astype(np.uint64) ^ mixed(ids.astype(np.uint64))))
                once = np.unique(value[known])
                h = np.concatenate([value, once]).astype(np.int64)
                dealt = np.concatenate([np.where(known, apart, value), once]).astype(np.int64)
                yield pa.record_batch({
                    "k": pa.array(dealt), "h": pa.array(h, mask=h == dealt),
                    "id": pa.array(np.concatenate([ids, np.zeros(len(once), np.int64)])), "p": pa.array(np.concatenate([np.where(known, packed | KNOWN, packed), np.full(len(once), -1)])),
                })

    return emit


def _repeated_only(batches):
    """Of a partition's anchors those whose value is there more than once, or is known to repeat."""
    columns: dict[str, list[np.ndarray]] = {c: [] for c in ("k", "h", "id", "p")}
    for batch in batches:
        for c, held in columns.items():
            values = pc.coalesce(batch.column("h"), batch.column("k")) if c == "h" else batch.column(c)
            held.append(values.to_numpy(zero_copy_only=False))
    if not columns["h"]:
        return
    k, h, ids, p = (np.concatenate(v) for v in columns.values())
    order = np.argsort(k, kind="stable")
    k, h, ids, p = k[order], h[order], ids[order], p[order]
    known = p & KNOWN != 0  # also markers
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(k))))
    keep = (known | (np.bincount(group)[group] > 1) | (np.bincount(group, known) > 0)[group]) & (p >= 0)
    for first in range(0, int(keep.sum()), 1 << 17):
        at = np.flatnonzero(keep)[first : first + (1 << 17)]
        yield pa.record_batch({"id": pa.array(ids[at]), "a": pa.StructArray.from_arrays([pa.array(h[at]), pa.array(p[at] & ~KNOWN)], names=["h", "p"])})


def _region(value: np.ndarray, begin: np.ndarray, last: np.ndarray, seed: np.ndarray, reach: int) -> np.ndarray:
    """A 64-bit value of the bytes from begin through the part at last, which is less than ``reach`` bytes on."""
    for at in range(0, reach, PART):
        seed = mixed(seed ^ value[np.minimum(begin + at, last)])
    return seed


def _descend(value: np.ndarray, place: np.ndarray, h: np.ndarray, far: np.ndarray, near: np.ndarray, size: int, hot):
    """Split pieces by halving the distances of starts before the anchor: (level, piece, farthest, nearest, value, split).

    All strings that start lo to hi before an anchor hold the bytes from lo before it to size - hi after; the
    value is that of these bytes, which equal strings share.  ``hot(level, value)`` says what is split further.
    """
    item, lo, hi, level = np.arange(len(h)), np.zeros(len(h), np.int64), np.full(len(h), size - PART), 0
    while len(item):
        at = place[item]
        key = _region(value, at - lo, at - hi + size - PART, mixed(h[item].astype(np.uint64) ^ ((lo << 7) | hi).astype(np.uint64)), size) if level else h[item].astype(np.uint64)
        split = hot(level, key) & (hi > lo)
        yield level, item, np.minimum(far[item], hi), np.maximum(near[item], lo), key, split
        item, lo, hi = item[split], lo[split], hi[split]
        mid = (lo + hi) // 2
        item, lo, hi = np.concatenate([item, item]), np.concatenate([lo, mid + 1]), np.concatenate([mid, hi])
        meets = (lo <= far[item]) & (hi >= near[item])
        item, lo, hi, level = item[meets], lo[meets], hi[meets], level + 1


def _among(values: list[np.ndarray]):
    """Whether a value of a level is one of the hot ones."""
    return lambda level, key: np.isin(key, values[level]) if level < len(values) else np.zeros(len(key), bool)


def _piece_counts(size: int, values: list[np.ndarray]):
    """How many different pieces of text a task holds under each value of the level after ``values``.

    Counted chunk by chunk, as chunks send them; a text that the task had before and values with one
    piece in a task are left out.
    """
    level, hot = len(values), _among(values)

    def count(batches):
        seen: set[int] = set()
        keys, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        held = 0

        def summed():
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            return key, np.bincount(back, np.concatenate(times), len(key)).astype(np.int64)

        for batch in batches:
            names = batch.column("name").to_pylist()
            fresh = [name not in seen and not seen.add(name) for name in names]
            for part in slices(batch.filter(pa.array(fresh, pa.bool_())), "text", CHUNK_BYTES):
                data, offsets = flat(part.column("text"))
                row, place, far, near, anchor = anchors(data, offsets, size)
                if level:
                    some = hot(0, anchor)
                    row, place, far, near, anchor = (v[some] for v in (row, place, far, near, anchor))
                if not len(row):
                    continue
                value, place = part_values(data), offsets[row] + place
                for at, item, f, n, key, _ in _descend(value, place, anchor, far, near, size, hot):
                    if at != level or not len(item):
                        continue
                    own, back, often = np.unique(key, return_inverse=True, return_counts=True)
                    many = np.flatnonzero(often[back] > 1)  # what is there once is one piece
                    piece = _region(value, place[item[many]] - f[many], place[item[many]] - n[many] + size - PART, key[many] ^ ((f[many] << 7) | n[many]).astype(np.uint64), 2 * size)
                    first = np.unique(piece, return_index=True)[1]
                    often[:] = 1
                    found, pieces = np.unique(back[many[first]], return_counts=True)
                    often[found] = pieces
                    keys.append(own)
                    times.append(often)
                    held += len(own)
                if held > 1 << 22:
                    keys, times = ([v] for v in summed())
                    held = 0
        key, n = summed()
        yield pa.record_batch({"value": pa.array(key[n > 1].astype(np.int64)), "n": pa.array(n[n > 1])})

    return count


def hot_values(texts: DataFrame, size: int, hot: int) -> list[np.ndarray]:
    """By level of splitting, the exact values that ``hot`` pieces or more lie under, as far as tasks hold two of them.

    A value that is not listed has fewer than ``hot`` pieces and at most one more from each task; copies
    of a text count once for each task, so they alone make nothing hot.  Each level is one combining aggregate, and the next one looks only under the hot values of this one.  What
    comes to the driver is one number for every ``hot`` pieces.
    """
    found: list[np.ndarray] = []
    while True:
        counts = texts.select("text", F.xxhash64("text").alias("name")).mapInArrow(_piece_counts(size, found), "value long, n long").groupBy("value").agg(F.sum("n").alias("n"))
        level = np.sort(np.array([r["value"] for r in counts.where(F.col("n") >= hot).select("value").collect()], np.int64).astype(np.uint64))
        if not len(level):
            return found
        found.append(level)


def _cut(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> pa.Array:
    """Pieces of a buffer, laid end to end."""
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    take = np.repeat(begin - bounds[:-1], length) + np.arange(bounds[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[take]))])


def _split_pieces(data: np.ndarray, place: np.ndarray, h: np.ndarray, p: np.ndarray, ids: np.ndarray, size: int, hot):
    """Batches like those of ``_contexts`` for pieces of hot anchors, split until their values are not hot."""
    leaves = []
    for _, item, far, near, key, split in _descend(part_values(data), place, h, (p >> 7) & 127, p & 127, size, hot):
        leaves.append(tuple(v[~split] for v in (item, far, near, key)))
    item, far, near, key = (np.concatenate(v) for v in zip(*leaves, strict=True))
    order = np.lexsort((item, key))  # equal pieces side by side, the earliest first
    for first in range(0, len(order), BLOCK):
        at = order[first : first + BLOCK]
        who, q = item[at], (p[item[at]] >> 14 << 14) | (far[at] << 7) | near[at]
        pieces = _cut(data, place[who] - far[at], far[at] - near[at] + size)
        codes = pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, fresh = np.unique((codes << 14) | (q & 16383), return_index=True)
        again = np.ones(len(at), bool)
        again[fresh] = False
        k = np.where(again, mixed(key[at] ^ mixed(q.astype(np.uint64) ^ mixed(ids[who].astype(np.uint64)))), key[at])
        yield pa.record_batch({
            "k": pa.array(k.astype(np.int64)), "id": pa.array(ids[who]), "p": pa.array(np.where(again, ~q, q)),
            "bytes": pa.array(np.where(again, None, np.array(pieces.to_pylist(), object)), pa.binary()),
        })


def _contexts(size: int, values: list[np.ndarray]):
    """Rows (k, id, p, bytes): the bytes of all strings filed under an anchor, in one piece, dealt by its value k.

    Of pieces that a chunk holds several times only the earliest is compared further; the others
    repeat it and pass with p negated.  Pieces of hot anchors are split.
    """

    hot = _among(values)

    def emit(batches):
        for batch in batches:
            for part in slices(batch, "text", CHUNK_BYTES):
                data, offsets = flat(part.column("text"))
                lists = part.column("found")
                values = lists.flatten()
                n = np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(part)), n)
                h, p = (values.field(i).to_numpy() for i in range(2))
                ids = part.column("id").to_numpy()[row]
                order = np.lexsort((p, ids))
                row, h, p, ids = row[order], h[order], p[order], ids[order]
                far, near = (p >> 7) & 127, p & 127
                pieces = _cut(data, offsets[row] + (p >> 14) - far, far - near + size)
                codes = pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                key = (codes << 14) | (p & 16383)
                _, first = np.unique(key, return_index=True)
                again = np.ones(len(key), bool)
                again[first] = False
                if values:
                    apart = ~again & hot(0, h.astype(np.uint64))
                    if apart.any():
                        yield from _split_pieces(data, (offsets[row] + (p >> 14))[apart], h[apart], p[apart], ids[apart], size, hot)
                        rest = np.flatnonzero(~apart)
                        h, p, ids, again, pieces = h[rest], p[rest], ids[rest], again[rest], pieces.take(pa.array(rest))
                k = np.where(again, mixed(h.astype(np.uint64) ^ mixed(p.astype(np.uint64) ^ mixed(ids.astype(np.uint64)))), h.astype(np.uint64))
                yield pa.record_batch({
                    "k": pa.array(k.astype(np.int64)), "id": pa.array(ids), "p": pa.array(np.where(again, ~p, p)),
                    "bytes": pa.array(np.where(again, None, np.array(pieces.to_pylist(), object)), pa.binary()),
                })

    return emit


def radix_groups(text: np.ndarray, at: np.ndarray, group: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes ``text[at:]`` of each group (ascending numbers) through ``size`` bytes, most significant digit first.

    Returns the places (indices into ``at``) of suffixes with an equal, group by group, and where groups begin.
    """
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    word = np.zeros(len(text) + 8, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    items = np.arange(len(at))
    for depth in range(0, size, 8):
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(head, len(group)))
        keep = np.repeat(sizes > 1, sizes)
        items, group = items[keep], group[keep]
        if not len(items):
            break
        digit = word[at[items] + depth] >> np.uint64(8 * max(0, depth + 8 - size))
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        sizes = np.diff(np.append(head, len(group)))
        mixed_up = np.repeat(np.minimum.reduceat(digit, head) != np.maximum.reduceat(digit, head), sizes)
        some = np.flatnonzero(mixed_up)
        order = some[np.lexsort((items[some], digit[some], group[some]))]
        items[some], digit[some] = items[order], digit[order]
        fresh = np.concatenate([[True], (group[1:] != group[:-1]) | ((digit[1:] != digit[:-1]) & mixed_up[1:])])
        group = np.cumsum(fresh)
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(items) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(head, len(items)))
    keep = np.repeat(sizes > 1, sizes)
    return items[keep], np.concatenate([[0], np.cumsum(sizes[sizes > 1])])


def _later_strings(size: int):
    """Per document the runs of bytes covered by strings that are there earlier, from a partition of contexts."""

    def find(batches):
        held: dict[str, list] = {"k": [], "id": [], "p": []}
        pieces = []
        for batch in batches:
            p = batch.column("p").to_numpy()
            done = p < 0
            if done.any():
                q, ids = ~p[done], batch.column("id").to_numpy()[done]
                far, near = (q >> 7) & 127, q & 127
                yield pa.record_batch({"id": pa.array(ids), "a": pa.array((q >> 14) - far), "b": pa.array((q >> 14) - near + size)})
            kept = batch.filter(pa.array(~done))
            for c, values in held.items():
                values.append(kept.column(c).to_numpy())
            pieces.append(flat(kept.column("bytes")))
        if not pieces or not sum(map(len, held["k"])):
            return
        h, ids, p = (np.concatenate(v) for v in held.values())
        text = np.concatenate([d for d, _ in pieces])
        length = np.concatenate([np.diff(o) for _, o in pieces])
        begin = np.cumsum(length) - length
        order = np.lexsort((p, ids))
        h, ids, p, begin = h[order], ids[order], p[order], begin[order]
        far, near = (p >> 7) & 127, p & 127
        n = far - near + 1
        owner = np.repeat(np.arange(len(h)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        _, part = np.unique(h, return_inverse=True)
        group = part[owner] * 128 + far[owner] - step
        by_group = np.argsort(group, kind="stable")
        items, heads = radix_groups(text, begin[owner[by_group]] + step[by_group], group[by_group], size)
        if not len(items):
            return
        items = by_group[items]  # numbers in the order of (document, start)
        first = np.minimum.reduceat(items, heads[:-1])
        later = items[items != np.repeat(first, np.diff(heads))]
        later.sort()
        fresh = np.concatenate([[True], (later[1:] != later[:-1] + 1) | (owner[later[1:]] != owner[later[:-1]])])
        a = np.flatnonzero(fresh)
        b = np.append(a[1:], len(later)) - 1
        who = owner[later[a]]
        base = (p >> 14)[who] - far[who]
        yield pa.record_batch({"id": pa.array(ids[who]), "a": pa.array(base + step[later[a]]), "b": pa.array(base + step[later[b]] + size)})

    return find


def _kept(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept_sha256": []}
            data, offsets = flat(part.column("text"))
            for r, spans in enumerate(part.column("spans").to_pylist()):
                body, merged = data[offsets[r] : offsets[r + 1]], []
                for a, b in sorted((s["a"], s["b"]) for s in spans or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                digest, done = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(body[done:a].tobytes())
                    done = b
                digest.update(body[done:].tobytes())
                out["n_removed"].append(sum(b - a for a, b in merged))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(digest.hexdigest())
            yield pa.record_batch({"id": part.column("id"), "n_bytes": pa.array(np.diff(offsets))} | {
                "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            })


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_spans(docs: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte goes if a string of ``size`` bytes (33 to 127) over it also starts earlier, in a document of smaller
    key or before it in the same one.  Strings never cross documents and are judged on the input.
    Null texts are empty; equal texts are looked at once, the copies after the first lose all they
    have if they are long enough.  Repeated rows of a key are one document, of different texts that
    of the least SHA-256; documents without a key take no part and stay whole; an empty table gives no rows; other columns are not read.
    """
    if not PART < size < 128:
        raise ValueError("size must be from 33 to 127")
    spark = docs.sparkSession
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    total = base.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    named = base.where("id is not null")
    sha = F.unhex(F.sha2("text", 256))
    hashed = named.select("id", sha.alias("sha"), F.octet_length("text").cast("long").alias("n"))
    hashed = hashed.groupBy("id").agg(F.min(F.struct("sha", "n")).alias("r")).select("id", "r.sha", "r.n")
    firsts = hashed.groupBy("sha").agg(F.min("id").alias("first"))
    # by id alone, so that texts are shuffled once
    whole = named.join(firsts.select(F.col("first").alias("id")), "id", "left_semi").groupBy("id").agg(F.min_by("text", sha).alias("text"))
    values = hot_values(named, size, HOT)
    found = whole.mapInArrow(_anchor_rows(size), "k long, h long, id long, p long").repartition(parts, "k")
    found = found.mapInArrow(_repeated_only, "id long, a struct<h: long, p: long>").groupBy("id").agg(F.collect_list("a").alias("found"))
    pieces = whole.join(found, "id").mapInArrow(_contexts(size, values), "k long, id long, p long, bytes binary").repartition(parts, "k")
    spans = pieces.mapInArrow(_later_strings(size), "id long, a long, b long").groupBy("id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    kept = whole.join(spans, "id", "left").mapInArrow(_kept, RESULT)
    copies = hashed.join(firsts, "sha").where("id != first")
    gone = copies.select(
        "id", "n", F.when(F.col("n") >= size, F.col("n")).otherwise(0).alias("n_removed"), (F.col("n") >= size).cast("long").alias("n_spans"),
        F.when(F.col("n") >= size, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
    unnamed = base.where("id is null").select("id", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.sha2("text", 256))
    return kept.union(gone).union(unnamed).withColumnRenamed("id", key)
