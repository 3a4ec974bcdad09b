"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from crestline.llm.pretokens import KEPT_BYTES, encoder
from crestline.llm.texts import slices

#: Pieces a task keeps in its summary, and entries of the broadcast table (some 20 bytes each).
SUMMARY_PIECES = 8192
TABLE_PIECES = 32768
#: Summaries merged by one task.
FAN_IN = 32


def _summary(counts: Counter, keep: int) -> pa.RecordBatch:
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]
    body = pa.table({"piece": pa.array([p for p, _ in top], pa.binary()), "n": pa.array([n for _, n in top], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, body.schema) as out:
        out.write_table(body)
    return pa.record_batch({"summary": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _read(blob: bytes) -> dict[bytes, int]:
    body = pa.ipc.open_stream(blob).read_all()
    return dict(zip(body["piece"].to_pylist(), body["n"].to_pylist(), strict=True))


def frequent_pieces(docs: DataFrame, tokenizer: str, text: str = "text", size: int = TABLE_PIECES) -> list[bytes]:
    """The corpus's most frequent pieces, from one summary of bounded size per task, merged in a tree.

    Every text is counted.  A task keeps its own most frequent pieces only, so the list is
    approximate at its end; it decides what is fast, never what is counted.
    """

    def count(batches):
        coder, counts = encoder(tokenizer), Counter()
        for batch in batches:
            for part in slices(batch, text):
                codes, distinct, _, _ = coder.pieces(part.column(text))
                n = np.bincount(codes, minlength=len(distinct))
                often = np.flatnonzero(n > 1)
                for p, k in zip(distinct.take(pa.array(often)).to_pylist(), n[often].tolist(), strict=True):
                    if len(p) <= KEPT_BYTES:
                        counts[p] += k
                if len(counts) > 16 * SUMMARY_PIECES:
                    counts = Counter(dict(counts.most_common(4 * SUMMARY_PIECES)))
        yield _summary(counts, SUMMARY_PIECES)

    def merge(batches):
        counts: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                counts.update(_read(blob))
        yield _summary(counts, size)

    found = docs.select(text).mapInArrow(count, "summary binary")
    parts = docs.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // FAN_IN)
        found = found.repartition(parts).mapInArrow(merge, "summary binary")
    row = found.first()
    return [] if row is None else list(_read(row["summary"]))


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048, size: int = TABLE_PIECES) -> DataFrame:
    """One row per document: ``key``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    A broadcast table holds the token counts of the ``size`` most frequent pieces, so its size
    does not depend on the corpus; what it lacks is encoded by the library once per worker and
    kept in a bounded cache.  A null text counts as empty (0 tokens).  Null or repeated keys and
    equal rows stay separate rows; an empty table gives no rows; other columns are not read, so
    their names cannot clash.
    """
    frequent = frequent_pieces(docs, tokenizer, text, size)
    coder = encoder(tokenizer)
    places = coder.places(frequent)
    shared = docs.sparkSession.sparkContext.broadcast((frequent, coder.size[places].astype(np.uint16)))
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        coder = encoder(tokenizer)
        pieces, lengths = shared.value
        frequent = pa.array(pieces, pa.large_binary())
        for batch in batches:
            for part in slices(batch, text):
                codes, distinct, rows, offsets = coder.pieces(part.column(text))
                at = pc.index_in(distinct, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False)
                size = np.zeros(len(distinct), np.int64)
                size[at >= 0] = lengths[at[at >= 0]]
                misses = np.flatnonzero(at < 0)
                if len(misses):
                    places = coder.places(distinct.take(pa.array(misses)).to_pylist())
                    size[misses] = coder.size[places]
                tokens = np.concatenate([[0], np.cumsum(size[codes])])[rows]
                n = np.diff(tokens)
                yield pa.record_batch({
                    key: part.column(key), "n_bytes": pa.array(np.diff(offsets)), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit),
                })

    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
