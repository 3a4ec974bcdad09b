"""Toxicity by a factorization machine over hashed terms.

Terms are words and their leading letters, hashed; each term has a linear weight and a short
vector, and pairs of terms in a text add the product of their vectors, so that two terms can
weigh more together than apart.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crestline.llm.sampling import smallest_hashes
from crestline.llm.texts import Words, flat, mixed, piece_hashes, slices, words

#: Buckets of the hash, terms that may carry weight, length of a term's vector.
BUCKETS, TERMS, RANK = 1 << 20, 2048, 8
#: Labelled documents of each label the model is fitted on, those of smallest key hash, and rounds of fitting.
SAMPLE_PER_LABEL, ROUNDS = 3000, 120
#: Leading letters (bytes) that make a term of their own.
LEADS = (4, 5)
THRESHOLD = 0.3


def term_codes(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every term occurrence: for all words, and for the leads of longer words; with the word's place."""
    n = len(found)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, distinct = found.codes()
    letters, bounds = flat(distinct)
    size = np.diff(bounds)
    tables = [piece_hashes(letters, bounds) % np.uint64(BUCKETS)]
    has = [np.ones(len(size), bool)]
    for lead in LEADS:
        keep = np.minimum(size, lead)
        inner = np.arange(len(letters)) - np.repeat(bounds[:-1], size) < lead
        tables.append(mixed(piece_hashes(letters[inner], np.concatenate([[0], np.cumsum(keep)])) + np.uint64(lead)) % np.uint64(BUCKETS))
        has.append(size > lead)
    out, place = [], []
    for table, ok in zip(tables, has, strict=True):
        at = np.flatnonzero(ok[codes])
        out.append(table[codes[at]].astype(np.int64))
        place.append(at)
    return np.concatenate(out), np.concatenate(place)


def text_terms(column: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) pairs without repeats, ordered by row; with ``among`` terms are its values by bucket and negatives go."""
    found = words(*flat(column))
    bucket, place = term_codes(found)
    row = found.row_of()[place]
    if among is not None:
        bucket = among[bucket]
        row, bucket = row[bucket >= 0], bucket[bucket >= 0]
    pairs = np.unique(row.astype(np.int64) * BUCKETS + bucket)
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Machine:
    """``slot[bucket]``: a term's row in ``linear`` and ``vectors``, or -1."""

    slot: np.ndarray
    bias: float
    linear: np.ndarray
    vectors: np.ndarray

    def logits(self, row: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        line = np.bincount(row, self.linear[term], minlength=n)
        v = self.vectors[term]
        sums = np.stack([np.bincount(row, v[:, k], minlength=n) for k in range(v.shape[1])], axis=1)
        own = np.bincount(row, (v * v).sum(axis=1), minlength=n)
        return self.bias + line + ((sums * sums).sum(axis=1) - own) / 2

    def scores(self, column: pa.Array) -> np.ndarray:
        row, term = text_terms(column, self.slot)
        return 1 / (1 + np.exp(-np.clip(self.logits(row, term, len(column)), -30, 30)))


def fit(texts: list[pa.Array], labels: list[np.ndarray], terms: int = TERMS, rank: int = RANK, rounds: int = ROUNDS, rate: float = 0.05, decay: float = 2e-4) -> Machine:
    """Logistic loss by Adam over the terms whose presence tells most about the label."""
    n = sum(map(len, labels))
    y = np.concatenate(labels).astype(float) if labels else np.zeros(0)
    slot = np.full(BUCKETS, -1, np.int64)
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return Machine(slot, float(np.log(share / (1 - share))), np.zeros(1), np.zeros((1, rank)))
    pairs, base = [], 0
    for part in texts:
        r, t = text_terms(part)
        pairs.append((r + base, t))
        base += len(part)
    row, bucket = np.concatenate([r for r, _ in pairs]), np.concatenate([t for _, t in pairs])
    pos, neg = np.bincount(bucket, y[row], minlength=BUCKETS), np.bincount(bucket, 1 - y[row], minlength=BUCKETS)
    p, q = (pos + 0.5) / (y.sum() + 1), (neg + 0.5) / ((1 - y).sum() + 1)
    tells = np.abs(np.log(p / q)) / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    tells[pos + neg < 4] = 0
    best = np.argsort(-tells, kind="stable")[:terms]
    best = best[tells[best] > 2.5]
    slot[best] = np.arange(len(best))
    keep = slot[bucket] >= 0
    row, term = row[keep], slot[bucket[keep]]
    rng = np.random.default_rng(7)
    m = Machine(slot, float(np.log(y.mean() / (1 - y.mean()))), np.zeros(max(1, len(best))), rng.normal(0, 0.01, (max(1, len(best)), rank)))
    state = [np.zeros_like(x) for x in (np.zeros(1), m.linear, m.vectors) for _ in range(2)]
    for step in range(1, rounds + 1):
        z = m.logits(row, term, n)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        v = m.vectors[term]
        sums = np.stack([np.bincount(row, v[:, k], minlength=n) for k in range(rank)], axis=1)
        gv = g[row, None] * (sums[row] - v)
        grads = [
            np.array([g.sum()]), np.bincount(term, g[row], minlength=len(m.linear)) + decay * m.linear / 10,
            np.stack([np.bincount(term, gv[:, k], minlength=len(m.linear)) for k in range(rank)], axis=1) + decay * m.vectors,
        ]
        for k, (grad, value) in enumerate(zip(grads, (None, m.linear, m.vectors), strict=True)):
            a, b = state[2 * k], state[2 * k + 1]
            a[:], b[:] = 0.9 * a + 0.1 * grad, 0.99 * b + 0.01 * grad * grad
            move = rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
            if value is None:
                m.bias -= float(move[0])
            else:
                value -= move
    return m


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> Machine:
    """Fit in one task on at most ``per_label`` labelled documents of each label, those of smallest key hash.

    Documents outside the sample have no part in it; unlabelled rows and rows of empty text are not used.
    The kept bias is the sample's, put back to the share of the label among all labelled rows.
    """
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    totals = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    sample = F.broadcast(smallest_hashes(marked, "k", per_label, F.col("y")))  # at most two times per_label keys
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(sample, "k").groupBy("k").agg(F.max("t").alias("t"), F.max("y").alias("y"))

    def train(batches):
        texts, ys = [], []
        for batch in batches:
            for part in slices(batch, "t"):
                texts.append(part.column("t"))
                ys.append(part.column("y").to_numpy())
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(texts, ys))], pa.binary())})

    made = rows.repartition(1).sortWithinPartitions("k").select("t", "y").mapInArrow(train, "model binary").first()
    m = pickle.loads(made[0]) if made else fit([], [])
    if totals.get(0) and totals.get(1):
        m.bias += float(np.log(totals[1] / totals[0]) - np.log(min(totals[1], per_label) / min(totals[0], per_label)))
    return m


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for every row; only the text is scored.

    Null and empty texts score as a text without terms; repeated rows and null keys keep a row
    each; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[key].dataType.simpleString()

    def rate(batches):
        for batch in batches:
            for part in slices(batch, text):
                s = shared.value.scores(part.column(text))
                yield pa.record_batch({key: part.column(key), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    return docs.select(key, text).mapInArrow(rate, f"`{key}` {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def clean(batches):
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(shared.value.scores(part.column(text)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
