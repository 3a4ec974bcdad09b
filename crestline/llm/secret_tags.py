"""Secrets in texts: three fixed patterns, and a linear-chain conditional random field beside them.

Tokens of a line are tagged begin, inside or outside of a secret from their shape, the shapes and
words around them and features of the whole file, decoded by Viterbi.  The field learns from what
the patterns find in a bounded sample and adds what looks and stands alike but fits no pattern.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crestline.llm.sampling import smallest_hashes
from crestline.llm.texts import LOWER, flat, piece_hashes, pieces_array, slices

# fixed values: the patterns and the least sizes of what counts
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_SIZE = 12, 18
KINDS = ("assign", "access", "hex", "tagged")

#: Sampled documents the field is fitted on, lines taken from them, tokens per line, rounds of fitting.
SAMPLE_DOCUMENTS, SAMPLE_LINES, LINE_TOKENS, ROUNDS = 4000, 600, 32, 50
#: Lines of each sort that one document gives.
LINES_PER_DOCUMENT = 8
BUCKETS, SHAPES, FILES = 4096, 8 * 8 + 128, 8


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret value) of all pattern matches, in code points."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_SIZE]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


_KIND = np.full(256, 1, np.uint8)  # 1: a sign of its own, 0: white space, 2: part of a word
_KIND[9:14] = _KIND[32] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 2


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    line: np.ndarray  # number of the token's line in the slice
    code: np.ndarray
    shape: np.ndarray  # by code
    bucket: np.ndarray  # by code
    file: np.ndarray  # by row


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    kind = _KIND[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    cut = first | (kind == 1)
    cut[1:] |= kind[1:] != kind[:-1]
    cuts = np.append(np.flatnonzero(cut), len(data))
    coded = pieces_array(data, cuts).dictionary_encode()
    letters, bounds = flat(coded.dictionary)
    take = np.flatnonzero(kind[cuts[:-1]] != 0)
    starts, ends = cuts[:-1][take], cuts[1:][take]
    row = np.searchsorted(offsets, starts, "right") - 1
    breaks = np.cumsum(data == 10)[starts] if len(starts) else starts
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    sums = lambda mask: np.add.reduceat(mask.astype(np.int64), bounds[:-1]) if len(bounds) > 1 else np.zeros(0, np.int64)
    size = np.diff(bounds)
    digits, upper, lower = sums((letters >= 48) & (letters < 58)), sums((letters >= 65) & (letters < 91)), sums((letters >= 97) & (letters < 123))
    hexes = sums((letters >= 97) & (letters < 103))
    build = np.select(
        [digits == size, digits + hexes == size, (digits > 0) & (upper > 0) & (lower > 0), (digits > 0) & (upper > 0), digits > 0, lower == size, upper == size],
        [0, 1, 2, 3, 4, 5, 6], 7,
    )
    length = np.searchsorted([2, 4, 8, 12, 16, 24, 40], size, "right")
    sign = (size == 1) & (_KIND[letters[bounds[:-1]]] == 1) if len(size) else np.zeros(0, bool)
    shape = np.where(sign, 64 + (letters[bounds[:-1]] & 127), build * 8 + length) if len(size) else np.zeros(0, np.int64)
    bucket = (piece_hashes(LOWER[letters], bounds) % np.uint64(BUCKETS)).astype(np.int64)
    share = lambda mask: np.add.reduceat(np.append(mask, 0).astype(np.int64), np.minimum(offsets[:-1], len(data))) / np.maximum(np.diff(offsets), 1)
    marks = np.searchsorted([0.005, 0.02, 0.08], share((data >= 48) & (data < 58)), "right") + 4 * (share(kind == 1) > 0.06)
    return Tokens(starts, ends, row, np.cumsum(fresh), coded.indices.to_numpy(zero_copy_only=False)[take], shape, bucket, np.where(np.diff(offsets) > 0, marks, 0))


#: Tables of the field: what a token's neighbourhood gives begin and inside over outside.
TABLES = {"shape": SHAPES, "shape_before": SHAPES + 1, "shape_after": SHAPES + 1, "word_before": BUCKETS + 1, "word_before_2": BUCKETS + 1, "word_after": BUCKETS + 1, "file": FILES}
OUT, BEGIN, IN = 0, 1, 2


def features(t: Tokens, at: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Index into each table for the tokens ``at`` (all by default); beyond the line is the last entry."""
    n = len(t.code)
    at = np.arange(n) if at is None else at
    out = {"shape": t.shape[t.code[at]], "file": t.file[t.row[at]]}
    for step, names in ((-1, ("shape_before", "word_before")), (-2, (None, "word_before_2")), (1, ("shape_after", "word_after"))):
        near = np.clip(at + step, 0, max(n - 1, 0))
        there = (at + step >= 0) & (at + step < n) & (t.line[near] == t.line[at])
        code = t.code[near]
        for name, values, end in ((names[0], t.shape, SHAPES), (names[1], t.bucket, BUCKETS)):
            if name:
                out[name] = np.where(there, values[code], end)
    return out


@dataclass
class Field:
    """``tables[name]``: one row per feature value, columns begin and inside; ``steps[a, b]``: tag a to tag b."""

    tables: dict[str, np.ndarray]
    steps: np.ndarray
    first: np.ndarray

    def emissions(self, indexed: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.tables[name][at] for name, at in indexed.items())


def fit(sequences: list[tuple[dict[str, np.ndarray], np.ndarray]], rounds: int = ROUNDS, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward over padded lines, with Adam steps and a quadratic penalty.

    Each line is there a second time with half of its neighbourhood hidden (a last entry of each
    table that stays zero), so that a token's own shape has to tell something too.
    """
    field = Field({k: np.zeros((n + 1, 2)) for k, n in TABLES.items()}, np.zeros((3, 3)), np.zeros(3))
    if not sequences:
        field.first[:], field.steps[:, 1:] = [0, -50, -50], -50
        return field
    n, longest = len(sequences), max(len(tags) for _, tags in sequences)
    index = {k: np.zeros((n, longest), np.int64) for k in TABLES}
    tags, there = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (f, y) in enumerate(sequences):
        for k in TABLES:
            index[k][i, : len(y)] = f[k]
        tags[i, : len(y)], there[i, : len(y)] = y, True
    hide = np.random.default_rng(11)
    for k, at in index.items():
        index[k] = np.concatenate([at, at if k in ("shape", "file") else np.where(hide.random(at.shape) < 0.5, TABLES[k], at)])
    tags, there, n = np.concatenate([tags, tags]), np.concatenate([there, there]), 2 * n
    gold = np.eye(3)[tags] * there[:, :, None]
    gold_steps = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    moments: dict[str, list[np.ndarray]] = {}
    lse = lambda x: (m := x.max(axis=1)) + np.log(np.exp(x - m[:, None]).sum(axis=1))
    for step in range(1, rounds + 1):
        e = np.zeros((n, longest, 3))
        e[:, :, 1:] = field.emissions(index)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = field.first + e[:, 0]
        for t in range(1, longest):
            new = np.stack([lse(a[:, t - 1] + field.steps[:, y]) for y in range(3)], axis=1) + e[:, t]
            a[:, t] = np.where(there[:, t, None], new, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.stack([lse(b[:, t + 1] + e[:, t + 1] + field.steps[y]) for y in range(3)], axis=1)
            b[:, t] = np.where(there[:, t + 1, None], new, 0)
        total = lse(a[:, -1])
        p = np.exp(a + b - total[:, None, None]) * there[:, :, None]
        pair = np.zeros((3, 3))
        for t in range(1, longest):
            x = a[:, t - 1, :, None] + field.steps + (e[:, t] + b[:, t])[:, None, :] - total[:, None, None]
            pair += np.where(there[:, t, None, None], np.exp(x), 0).sum(axis=0)
        slope = (p - gold)[:, :, 1:] / n
        grads = {k: np.stack([np.bincount(index[k][there], slope[:, :, c][there], minlength=TABLES[k] + 1) for c in range(2)], axis=1) for k in TABLES}
        for k, size in TABLES.items():
            grads[k][size] = 0
        grads |= {"steps": (pair - gold_steps) / n, "first": (p[:, 0] - gold[:, 0]).sum(axis=0) / n}
        for name, g in grads.items():
            value = field.tables[name] if name in field.tables else getattr(field, name)
            g += decay * value
            m = moments.setdefault(name, [np.zeros_like(g), np.zeros_like(g)])
            m[0][:], m[1][:] = 0.9 * m[0] + 0.1 * g, 0.99 * m[1] + 0.01 * g * g
            value -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
    return field


def viterbi(scores: np.ndarray, steps: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    """Best tags of one stretch; ``first`` and ``last`` score its first and last tag."""
    best, back = first + scores[0], []
    for row in scores[1:]:
        paths = best[:, None] + steps
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    tag = int((best + last).argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]


def decode(field: Field, t: Tokens) -> np.ndarray:
    """Viterbi tags of all lines.

    A stretch of tokens that are not outside can only lie on a best path if what it gains over
    tagging it all outside is not negative; tokens in no such stretch are outside for certain,
    and only the stretches between them are decoded.
    """
    n = len(t.code)
    tags = np.zeros(n, np.int64)
    if not n:
        return tags
    indexed = features(t)
    e = field.emissions(indexed)
    rest = field.steps - field.steps[OUT, OUT]
    inner = max(rest[1:, 1:].max(), 0.0)
    edges = max(0.0, (field.first[1:] - field.first[OUT]).max(), rest[OUT, 1:].max()) + max(0.0, rest[1:, OUT].max())
    gain = e.max(axis=1) + inner
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    left = sums[1:] - np.minimum.accumulate(sums[:-1])
    right = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
    open_ = left + right - gain + edges >= -1e-6
    fresh = np.ones(n, bool)
    fresh[1:] = t.line[1:] != t.line[:-1]
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | fresh[at[1:]]]))
    for a, b in zip(at[begins].tolist(), (at[np.append(begins[1:], len(at)) - 1] + 1).tolist(), strict=True):
        first = field.first if fresh[a] else field.steps[OUT]
        last = np.zeros(3) if b == n or fresh[b] else field.steps[:, OUT]
        scores = np.zeros((b - a, 3))
        scores[:, 1:] = e[a:b]
        tags[a:b] = viterbi(scores, field.steps, first, last)
    return tags


def _training(column: pa.Array) -> Iterator[tuple[int, bool, list]]:
    """Per row some lines with labelled tokens and as many without, each clipped to a bounded number of tokens: (row, labelled, line)."""
    data, offsets = flat(column)
    t = tokens_of(data, offsets)
    tags = np.zeros(len(t.code), np.int64)
    for r, value in enumerate(column.to_pylist()):
        for _, _, end, begin in base_spans(value or ""):
            a, b = (offsets[r] + len(value[:x].encode()) for x in (begin, end))
            i, j = np.searchsorted(t.starts, a), np.searchsorted(t.ends, b, "right")
            tags[i:j] = IN
            tags[i : i + (j > i)] = BEGIN
    if not len(tags):
        return
    fresh = np.flatnonzero(np.concatenate([[True], t.line[1:] != t.line[:-1]]))
    taken: dict[tuple[int, bool], int] = {}
    for a, b in zip(fresh.tolist(), [*fresh[1:].tolist(), len(tags)], strict=True):
        hot = np.flatnonzero(tags[a:b])
        key = (int(t.row[a]), bool(len(hot)))
        if taken.setdefault(key, 0) < LINES_PER_DOCUMENT:
            taken[key] += 1
            a = max(a, a + (int(hot[0]) if len(hot) else 0) - LINE_TOKENS // 2)
            at = np.arange(a, min(b, a + LINE_TOKENS))
            yield (*key, (features(t, at), tags[at]))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = SAMPLE_DOCUMENTS, lines: int = SAMPLE_LINES) -> Field:
    """Fit the field in one task on ``lines`` lines of at most ``documents`` documents, those of smallest key hash.

    Documents of any length may be in the sample: their lines are cut where they lie, and only these go
    to the fitting task.  Rows without a key are not in the sample.
    """
    named = docs.where(F.col(key).isNotNull() & (F.octet_length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    sample = F.broadcast(smallest_hashes(named.select("k").distinct(), "k", documents))  # at most so many keys

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                found = list(_training(part.column("t")))
                yield pa.record_batch({
                    "k": part.column("k").take(pa.array([r for r, _, _ in found], pa.int64())), "hot": pa.array([h for _, h, _ in found], pa.bool_()),
                    "line": pa.array([pickle.dumps(line) for *_, line in found], pa.binary()),
                })

    def train(batches):
        held: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for hot, line in zip(batch.column("hot").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if len(held[hot]) < lines // 2:
                    held[hot].append(pickle.loads(line))
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(held[True] + held[False][: max(len(held[True]), 1)]))], pa.binary())})

    kind = docs.schema[key].dataType.simpleString()
    made = named.join(sample, "k", "left_semi").mapInArrow(cut, f"k {kind}, hot boolean, line binary")
    made = made.repartition(1).sortWithinPartitions(F.xxhash64("k"), "k", "line").select("hot", "line").mapInArrow(train, "model binary").first()
    return pickle.loads(made[0]) if made else fit([])


def outside(a: int, b: int, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a to b that no covered span holds; spans are sorted."""
    for s, e in covered:
        if s >= b:
            break
        if e > a:
            if s > a:
                yield a, s
            a = max(a, e)
    if a < b:
        yield a, b


def all_spans(column: pa.Array, field: Field) -> Iterator[list[tuple[int, int, int, int]]]:
    """Per row: (start, kind, end, value start), the patterns' spans and those only the field finds."""
    data, offsets = flat(column)
    t = tokens_of(data, offsets)
    tags = decode(field, t)
    begins = np.flatnonzero((tags == BEGIN) | ((tags == IN) & np.concatenate([[True], (tags[:-1] == OUT) | (t.line[1:] != t.line[:-1])])[: len(tags)]))
    stop = np.ones(len(tags) + 1, bool)
    stop[:-1] = (tags != IN) | np.isin(np.arange(len(tags)), begins)
    stops = np.flatnonzero(stop)
    tagged: dict[int, list[tuple[int, int]]] = {}
    for i in begins.tolist():
        j = int(stops[np.searchsorted(stops, i, "right")])
        tagged.setdefault(int(t.row[i]), []).append((int(t.starts[i] - offsets[t.row[i]]), int(t.ends[j - 1] - offsets[t.row[i]])))
    for r, value in enumerate(column.to_pylist()):
        spans = base_spans(value or "")
        if r in tagged:
            raw = value.encode()
            covered = sorted((a, e) for a, _, e, _ in spans)
            for a, b in tagged[r]:
                a, b = (x if value.isascii() else len(raw[:x].decode()) for x in (a, b))
                spans += [(s, 3, e, s) for s, e in outside(a, b, covered) if any(c.isalnum() for c in value[s:e])]
            spans.sort()
        yield spans


def _written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def find_secrets(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per input row: the key, counts by pattern, ``base_spans`` and ``spans`` as ``kind:start:end`` joined by commas.

    Offsets are code points, ends exclusive; assign spans run from the key word to the end of the
    value.  Of a span of the field that reaches into a pattern's, the parts outside are kept where they hold a letter or digit.  Null texts are empty;
    repeated rows and null keys keep a row each; an empty table gives no rows; other columns are
    not read.
    """
    field = field or learn(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[key].dataType.simpleString()

    def find(batches):
        for batch in batches:
            for part in slices(batch, text):
                rows = list(all_spans(part.column(text), shared.value))
                base = [[s for s in spans if s[1] < 3] for spans in rows]
                out = {key: part.column(key)}
                for k, name in enumerate(KINDS[:3]):
                    out[f"n_{name}"] = pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64())
                yield pa.record_batch(out | {"base_spans": pa.array(map(_written, base), pa.string()), "spans": pa.array(map(_written, rows), pa.string())})

    return docs.select(key, text).mapInArrow(find, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_spans string, spans string")


def redact_secrets(docs: DataFrame, field: Field | None = None, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with ``mark`` in place of every secret value in ``text``; nulls stay null."""
    field = field or learn(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index(text)

    def redact(batches):
        for batch in batches:
            for part in slices(batch, text):
                out = []
                for value, spans in zip(part.column(text).to_pylist(), all_spans(part.column(text), shared.value), strict=True):
                    done, clean = 0, []
                    for begin, end in sorted((v, b) for _, _, b, v in spans):
                        if begin >= done:
                            clean += [value[done:begin], mark]
                        done = max(done, end)
                    out.append(value if not spans else "".join(clean) + value[done:])
                yield part.set_column(place, part.schema.field(place), pa.array(out, part.schema.field(place).type))

    return docs.mapInArrow(redact, docs.schema)
