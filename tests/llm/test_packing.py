"""Packing: every token once, gapless sequences, neighbours first."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from crestline.llm.queries import tokenizer
from crestline.llm.retrieval_packing import K1, TERMS, B, Bm25, Counts, corpus_of, dealing_terms, pack, pack_documents, shards_of
from crestline.llm.texts import flat, word_values, words


def test_pack_is_gapless_and_complete():
    rnd = random.Random(4)
    for _ in range(200):
        sizes = [rnd.randint(1, 40) for _ in range(rnd.randint(0, 30))]
        near = lambda doc, free: iter([d for d in sorted(np.flatnonzero(free).tolist(), key=lambda d: (d % 3 != doc % 3, d)) if d % 3 == doc % 3])
        pieces = pack(sizes, near, 16)
        by_doc, by_sequence = {}, {}
        for doc, start, length, sequence, offset in pieces:
            assert start == by_doc.get(doc, 0) and offset == by_sequence.get(sequence, 0) and length > 0
            by_doc[doc], by_sequence[sequence] = start + length, offset + length
        assert [by_doc.get(d, 0) for d in range(len(sizes))] == sizes
        assert all(by_sequence[s] == 16 for s in list(by_sequence)[:-1])


def test_neighbours_by_bm25():
    texts = ["apple pear", "stone sand", "pear apple apple", "sand dune", "plum", "apple fig"]
    index = Bm25(pa.array(texts))
    free = np.array([False, True, True, True, True, True])
    assert list(index.neighbours(0, free)) == [2, 5]
    assert list(index.neighbours(4, free)) == []


def test_pieces_hold_the_documents(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["sun", "moon", "star", "Ünï", "x1"]) for _ in range(rnd.choice([0, 5, 300, 3000]))), 0) for i in range(60)]
    rows += [(100, None, 0), (3, rows[3][1], 0), (None, "lone", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(4)
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    pieces = pack_documents(docs, tokenizer("byte_bpe_50k.json"), shard_bytes=100000).collect()
    want = {}
    for key, text, _ in rows:
        want.setdefault(key, library.encode(text or "", add_special_tokens=False).ids + [1])
    for r in pieces:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(want[r["doc_id"]])
    assert sum(r["length"] for r in pieces) == sum(len(want[k]) for k, _, _ in rows)
    assert pack_documents(docs.limit(0), tokenizer("byte_bpe_50k.json")).collect() == []


def test_word_values_are_those_of_the_words():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAbB01 .-é") for _ in range(rnd.randint(0, 40))) for _ in range(400)] + [None, "", "x" * 600000, "end"]
    data, offsets = flat(pa.array(texts))
    values, rows = word_values(data, offsets)
    found = words(data, offsets)
    assert rows.tolist() == found.rows.tolist()
    seen = {}
    for value, word in zip(values.tolist(), [bytes(found.letters[a:b]) for a, b in zip(found.bounds[:-1], found.bounds[1:])], strict=True):
        assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def brute_bm25(texts):
    """Scores of all pairs over hashed terms, from plain counts."""
    bags = []
    for t in texts:
        values, _ = word_values(*flat(pa.array([t])))
        bags.append(Counter((values % np.uint64(TERMS)).tolist()))
    n, mean = len(bags), max(sum(sum(b.values()) for b in bags) / len(bags), 1)
    held = Counter(w for b in bags for w in b)

    def score(asked, bag):
        size = sum(bag.values()) / mean
        return sum(math.log1p((n - held[w] + 0.5) / (held[w] + 0.5)) * bag[w] * (K1 + 1) / (bag[w] + K1 * (1 - B + B * size)) for w in asked if w in bag)

    return [[score(a, b) for b in bags] for a in bags], held


def topics(rnd, n, copies=0):
    """Texts of 40 topics, with common words and words of their own."""
    out = [" ".join(rnd.choices([f"topic{i % 40}w{j}" for j in range(12)], k=30) + rnd.choices(["the", "of", "and", "to", "in"], k=60) + [f"own{rnd.randint(0, 10**6)}" for _ in range(40)]) for i in range(n)]
    return out + out[:1] * copies


def test_scores_are_those_of_plain_bm25():
    rnd = random.Random(5)
    texts = topics(rnd, 150, 20) + [None, "", "the", "lone", "Ünï of"]
    want, _ = brute_bm25(texts)
    index = Bm25(pa.array(texts))
    for d in range(len(texts)):
        got = index.scores(d)
        # a term that no other document of the shard holds adds to the document itself only
        np.testing.assert_allclose(np.delete(got, d), np.delete(np.array(want[d]), d), rtol=1e-5, atol=1e-5)
        free = np.array([rnd.random() < 0.7 for _ in texts])
        free[d] = False
        order = list(index.neighbours(d, free))
        assert sorted(order) == [i for i in range(len(texts)) if free[i] and got[i] > 0]
        assert all(got[a] > got[b] or (got[a] == got[b] and a < b) for a, b in zip(order, order[1:]))


def test_statistics_are_those_of_all_documents(spark):
    rnd = random.Random(6)
    texts = topics(rnd, 80) + [None, "", "the the"]
    docs = spark.createDataFrame([(t,) for t in texts], "body string").repartition(7)
    corpus, counts = corpus_of(docs, "body", 2000), Counts()
    counts.add(pa.array(texts))
    plain = counts.corpus(2000)
    assert corpus.n == len(texts) and corpus.mean == plain.mean
    assert (corpus.held == plain.held).all() and (corpus.heavy == plain.heavy).all()
    assert corpus.heavy.any() and dict(Counter(corpus.held[corpus.held > 0].tolist())) == dict(Counter(brute_bm25(texts)[1].values()))
    nothing = corpus_of(docs.limit(0), "body", 2000)
    assert nothing.n == 0 and nothing.mean == 0 and not nothing.held.any()


def test_dealing_terms_are_shared_and_light():
    texts = ["red red blue", "red blue", "green", None, "", "blue x", "heavy red"]
    counts = Counts()
    counts.add(pa.array(texts))
    corpus = counts.corpus(1 << 20)
    term = lambda word: int(word_values(*flat(pa.array([word])))[0][0] % np.uint64(TERMS))
    got = dealing_terms(pa.array(texts), corpus)
    assert got[0] in (term("red"), term("blue")) and got[5] == term("blue") and got[6] == term("red") and got[2:5].tolist() == [-1, -1, -1]
    assert (dealing_terms(pa.array(texts[::-1]), corpus)[::-1] == got).all()
    corpus.heavy[term("red")] = True
    assert dealing_terms(pa.array(texts), corpus)[[0, 6]].tolist() == [term("blue"), -1]


def test_shards_are_bounded_and_whole():
    texts = ["a" * n for n in (10, 50, 500, 1, 0, 30, 60, 90)] + [None]
    batch = pa.record_batch({"t": pa.array(texts)})
    got = [[x for p in shard for x in p.column("t").to_pylist()] for shard in shards_of([batch.slice(0, 4), batch.slice(4)], 100)]
    assert [x for s in got for x in s] == texts
    assert all(sum(len(x or "") for x in s) <= 100 or len(s) == 1 for s in got)


def test_related_documents_share_sequences_however_many_shards(spark):
    """Eight documents about each of 30 things, among others: nearly as many stand beside one of their own as with one shard."""
    rnd = random.Random(9)
    other = lambda n: [f"w{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(n)]
    rows = []
    for doc in range(240):
        said = rnd.choices([f"thing{doc % 30}x{j}" for j in range(10)], k=40) + other(160)
        rnd.shuffle(said)
        rows.append((doc, " ".join(said)))
    rows += [(5000 + i, " ".join(other(200))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    total = sum(len(t) for _, t in rows)
    share = []
    for shards in (1, 8, 32):
        held, things = {}, {}
        for r in pack_documents(docs, tokenizer("byte_bpe_50k.json"), shard_bytes=-(-total // shards)).collect():
            if r["doc_id"] < 240:
                held.setdefault(r["doc_id"], set()).add(r["sequence_id"])
                things.setdefault((r["sequence_id"], r["doc_id"] % 30), set()).add(r["doc_id"])
        beside = sum(any(len(things[s, d % 30]) > 1 for s in held[d]) for d in range(240)) / 240
        share.append(beside)
    # one shard is retrieval over all documents; what it leaves alone was picked to fill a window of another thing
    assert share[0] >= 0.7 and min(share) >= 0.8 * share[0], share
