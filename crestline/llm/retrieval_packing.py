"""Packing by lexical retrieval: documents that share rare words stand in one training sequence.

Document frequencies and the mean length come from the whole corpus.  A document is dealt by a term
that tells much of it and whose documents fit one task: terms draw lots that are the same everywhere,
weighted by what they tell, so two documents draw the same term about as often as their weights agree,
however many shards there are.  Each shard has a BM25 index over all its terms; a document opens a window, the index returns
unused documents most like it, and they fill the window in that order.  What a full window cuts off
opens the next one, so only a task's last sequence has room left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crestline.llm.pretokens import encoder
from crestline.llm.texts import SLICE_BYTES, flat, mixed, slices, word_values

#: Tokens of a sequence, text bytes of a shard, shards that a task packs one after the other.
WINDOW, SHARD_BYTES, SHARDS_OF_TASK = 2048, 4 << 20, 2
#: Terms are words hashed to so many values; this bounds the table of weights that is broadcast.
TERMS = 1 << 20
#: Terms of a block of counts, and tasks that add the blocks up.
BLOCK, COUNTING = 1 << 14, 16
#: Terms held by fewer documents deal as if so many held them: then repeats in the document decide.
RARE = 64
#: How much more than others the terms that tell most deal.
SHARP = 4
#: BM25: how soon repeats stop counting, and how much long documents are held back.
K1, B = 1.2, 0.75


class Found:
    """Distinct terms of the documents of a slice, by document and term, and how often each occurs."""

    def __init__(self, column: pa.Array):
        values, rows = word_values(*flat(column))
        self.n, self.n_words = len(column), np.diff(rows)
        code = np.repeat(np.arange(self.n) * TERMS, self.n_words) + (values % np.uint64(TERMS)).astype(np.int64)
        pairs, times = np.unique(code, return_counts=True)
        self.doc, self.term, self.times = pairs // TERMS, pairs % TERMS, times


@dataclass
class Corpus:
    """Statistics over all documents: their number, mean words, per term the documents that hold it and whether
    these have too much text to be dealt by it."""

    n: int
    mean: float
    held: np.ndarray
    heavy: np.ndarray

    def rarity(self, least: int = 0) -> np.ndarray:
        held = np.maximum(self.held, least)
        return np.log1p((np.maximum(self.n - held, 0) + 0.5) / (held + 0.5)).astype(np.float32)

    def repeats(self, found: Found) -> np.ndarray:
        """What the occurrences of each pair count, repeats less and less, long documents held back."""
        size = found.n_words / max(self.mean, 1)
        return found.times * (K1 + 1) / (found.times + K1 * (1 - B + B * size[found.doc]))


class Counts:
    """Sums that make a ``Corpus``."""

    def __init__(self):
        self.n = self.words = 0
        self.held, self.bytes = np.zeros(TERMS, np.int64), np.zeros(TERMS, np.int64)

    def add(self, column: pa.Array) -> None:
        found, sizes = Found(column), np.diff(flat(column)[1])
        self.n, self.words = self.n + found.n, self.words + int(found.n_words.sum())
        self.held += np.bincount(found.term, minlength=TERMS)
        self.bytes += np.bincount(found.term, sizes[found.doc], TERMS).astype(np.int64)

    def corpus(self, limit: int) -> Corpus:
        return Corpus(self.n, self.words / max(self.n, 1), self.held, self.bytes > limit)


def corpus_of(docs: DataFrame, text: str, limit: int) -> Corpus:
    """One pass and a combining sum; the driver gets at most ``TERMS`` rows, however large the corpus is.

    A task's sums travel as one row per block of terms; the last block is that of the totals.
    """
    schema = pa.schema({"block": pa.int32(), "at": pa.binary(), "held": pa.binary(), "bytes": pa.binary()})

    def count(batches):
        sums = Counts()
        for batch in batches:
            for part in slices(batch, "t"):
                sums.add(part.column("t"))
        held, sizes = np.append(sums.held, sums.n), np.append(sums.bytes, sums.words)
        at = np.flatnonzero(held)
        for these in np.split(at, np.flatnonzero(np.diff(at // BLOCK)) + 1):
            if len(these):
                yield pa.record_batch([[int(these[0]) // BLOCK], [(these % BLOCK).astype("<i4").tobytes()], [held[these].tobytes()], [sizes[these].tobytes()]], schema=schema)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, held, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(block, np.zeros((2, BLOCK), np.int64))
                total[:, np.frombuffer(at, "<i4")] += np.stack([np.frombuffer(held, np.int64), np.frombuffer(sizes, np.int64)])
        for block, (held, sizes) in sums.items():
            at = np.flatnonzero(held)
            yield pa.record_batch({"term": pa.array((at + block * BLOCK).astype(np.int32)), "held": pa.array(held[at]), "bytes": pa.array(sizes[at])})

    sums = docs.select(F.col(text).alias("t")).mapInArrow(count, "block int, at binary, held binary, bytes binary")
    got = sums.repartition(COUNTING, "block").mapInArrow(add, "term int, held long, bytes long").withColumn("heavy", F.col("bytes") > limit)
    got = got.select("term", "held", F.when(F.col("term") >= TERMS, F.col("bytes")).alias("words"), "heavy").toArrow()
    term, number = got.column("term").to_numpy(), got.column("held").to_numpy()
    every = term >= TERMS
    n, n_words = int(number[every].sum()), sum(x or 0 for x in got.filter(pa.array(every)).column("words").to_pylist())
    held, heavy = np.zeros(TERMS, np.int64), np.zeros(TERMS, bool)
    held[term[~every]] = number[~every]
    heavy[term[~every]] = got.column("heavy").to_numpy(zero_copy_only=False)[~every].astype(bool)
    return Corpus(n, n_words / max(n, 1), held, heavy)


def dealing_terms(column: pa.Array, corpus: Corpus, rarity: np.ndarray | None = None) -> np.ndarray:
    """Per document one of its shared terms that are not heavy, drawn by lot; -1 where it has none.

    A term's lot is an exponential number from its hash over its weight: the least lot wins, so documents
    agree with the chance of consistent weighted sampling.

    ``rarity`` is ``corpus.rarity(RARE)``, which callers with many slices make once.
    """
    found = Found(column)
    rarity = corpus.rarity(RARE) if rarity is None else rarity
    able = (corpus.held[found.term] > 1) & ~corpus.heavy[found.term]
    best = np.full(found.n, -1, np.int64)
    doc, term = found.doc[able], found.term[able]
    if len(doc):
        lot = -np.log(((mixed(term.astype(np.uint64) + np.uint64(TERMS)) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
        worth = (corpus.repeats(found)[able] * rarity[term]) ** SHARP / lot
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        top = np.flatnonzero(worth == np.repeat(np.maximum.reduceat(worth, first), np.diff(first, append=len(doc))))
        order = top[np.lexsort((term[top], corpus.held[term[top]], doc[top]))][::-1]
        best[doc[order]] = term[order]  # the last one written stays: the rarest, then the smallest
    return best


class Bm25:
    """Inverted index of one shard: per term the documents that hold it and what it is worth there.

    Terms held by an eighth of the shard or more are rows of a matrix; a list of theirs would be as long.
    """

    def __init__(self, column: pa.Array, corpus: Corpus | None = None, rarity: np.ndarray | None = None):
        if corpus is None:
            counts = Counts()
            counts.add(column)
            corpus = counts.corpus(SHARD_BYTES)
        rarity = corpus.rarity() if rarity is None else rarity
        found = Found(column)
        self.n = found.n
        held = np.bincount(found.term, minlength=TERMS)
        word = (np.cumsum(held > 0) - 1)[found.term]
        held = held[held > 0]
        worth = (corpus.repeats(found) * rarity[found.term]).astype(np.float32)
        common, shared = held * 8 >= max(self.n, 16), held > 1
        row = np.cumsum(common) - 1
        self.common = np.zeros((int(common.sum()), self.n), np.float32)
        often = common[word]
        self.common[row[word[often]], found.doc[often]] = worth[often]
        self.rows, self.row_first = row[word[often]], np.searchsorted(found.doc[often], np.arange(self.n + 1))
        seldom = shared[word] & ~often
        doc, word, worth = found.doc[seldom], word[seldom], worth[seldom]
        self.words, self.word_first = word, np.searchsorted(doc, np.arange(self.n + 1))
        by_word = np.argsort(word, kind="stable")
        self.docs, self.worth = doc[by_word], worth[by_word]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(held)))])

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for all terms of ``doc``."""
        asked = np.zeros(len(self.common), np.float32)
        asked[self.rows[self.row_first[doc] : self.row_first[doc + 1]]] = 1
        words = self.words[self.word_first[doc] : self.word_first[doc + 1]]
        begin, size = self.first[words], self.first[words + 1] - self.first[words]
        place = np.arange(size.sum()) + np.repeat(begin - np.cumsum(size) + size, size)
        return np.bincount(self.docs[place], self.worth[place], self.n) + asked @ self.common

    def neighbours(self, doc: int, free: np.ndarray):
        """Free documents that share a term, best first, ties by place."""
        score = self.scores(doc)
        near = np.flatnonzero((score > 0) & free)
        if len(near) > 64:  # the window is nearly always full after a few
            limit = np.partition(score[near], len(near) - 32)[len(near) - 32]
            best, near = near[score[near] >= limit], near[score[near] < limit]
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
        yield from near[np.argsort(-score[near], kind="stable")].tolist()


def pack(sizes: list[int], neighbours: Callable, window: int = WINDOW, offset: int = 0) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that hold every token once, sequences full but for the last.

    The first sequence goes on at ``offset``.
    """
    free = np.ones(len(sizes), bool)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def place(doc: int) -> None:
        nonlocal sequence, offset
        free[doc] = False
        start = 0
        while start < sizes[doc]:
            length = min(window - offset, sizes[doc] - start)
            pieces.append((doc, start, length, sequence, offset))
            start, offset = start + length, offset + length
            if offset == window:
                sequence, offset = sequence + 1, 0

    for seed in range(len(sizes)):
        if not free[seed]:
            continue
        place(seed)
        opener = seed
        while offset:
            opened = sequence
            for doc in neighbours(opener, free):
                place(doc)
                if sequence != opened:
                    break
            if sequence == opened:  # no neighbour is left: the next seed goes on in this window
                break
            opener = doc
    return pieces


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per piece: ``key``, ``start`` (the document's tokens before it), ``length``, ``ids_crc32`` (of its ids
    as little-endian unsigned 32-bit integers), ``doc_tokens`` (with ``end_id``), ``sequence_id`` and ``offset``.

    A task packs its documents shard by shard, in the order of their dealing terms, and numbers its sequences from its own
    multiple of 2^32.  Documents without a term to deal by are spread by their hash.  Null and empty texts are the end id
    alone; repeated rows and null keys are documents of their own; an empty table gives no
    rows; other columns are not read.
    """
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    tasks = max(1, -(-total // (shard_bytes * SHARDS_OF_TASK)))
    kind = docs.schema[key].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast(corpus_of(docs, text, shard_bytes * SHARDS_OF_TASK))

    def deal(batches):
        rarity = known.value.rarity(RARE)
        for batch in batches:
            for part in slices(batch, "t"):
                yield part.append_column("term", pa.array(dealing_terms(part.column("t"), known.value, rarity)))

    def fill(batches):
        from pyspark import TaskContext

        coder, rarity = encoder(tokenizer), known.value.rarity()
        sequence, offset = TaskContext.get().partitionId() << 32, 0
        for shard in shards_of(batches, shard_bytes):
            keys, texts = pa.concat_arrays([p.column("k") for p in shard]), pa.concat_arrays([p.column("t").cast(pa.large_binary()) for p in shard])
            ids, sizes = [], []
            for part in shard:
                some, at = coder.encode(part.column("t"))
                ids.append(np.insert(some, at[1:], end_id).astype("<u4"))
                sizes += (np.diff(at) + 1).tolist()
            pieces = np.array(pack(sizes, Bm25(texts, known.value, rarity).neighbours, window, offset), np.int64).reshape(-1, 5)
            stream, first = np.concatenate(ids), np.cumsum(sizes) - sizes
            doc, start, length = pieces[:, 0], pieces[:, 1], pieces[:, 2]
            begin = first[doc] + start
            crc = [zlib.crc32(stream[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield pa.record_batch({
                key: keys.take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(np.array(sizes, np.int64)[doc]), "sequence_id": pa.array(sequence + pieces[:, 3]), "offset": pa.array(pieces[:, 4]),
            })
            sequence, offset = sequence + int(pieces[-1, 3]), int(pieces[-1, 4] + pieces[-1, 2])
            if offset == window:
                sequence, offset = sequence + 1, 0

    dealt = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(deal, f"k {kind}, t string, term long")
    spread = F.when(F.col("term") < 0, F.xxhash64("k", F.xxhash64("t"))).otherwise(F.xxhash64("term"))
    dealt = dealt.withColumn("place", spread).repartition(tasks, "place").sortWithinPartitions("place", "k", "t").select("k", "t")
    return dealt.mapInArrow(fill, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def shards_of(batches, limit: int):
    """Consecutive parts of batches with at most ``limit`` bytes of text together; one longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "t", min(limit, SLICE_BYTES)):
            more = int(flat(part.column("t"))[1][-1])
            if held and size + more > limit:
                yield held
                held, size = [], 0
            held.append(part)
            size += more
    if held:
        yield held
