"""Repeated byte strings against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from crestline.llm import repeated_spans as rs


def brute(docs, size):
    seen, out = set(), []
    for key, text in sorted(docs):
        body, gone = (text or "").encode(), set()
        for s in range(len(body) - size + 1):
            w = body[s : s + size]
            if w in seen:
                gone.update(range(s, s + size))
            seen.add(w)
        kept = bytes(b for i, b in enumerate(body) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        out.append((key, len(body), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(n) for n in (8, 12, 20, 40, 60)]
    docs = []
    for i in range(150):
        bits = [text(rnd.randint(0, 30)) if rnd.random() < 0.5 else rnd.choice(passages)[rnd.randint(0, 9) :] for _ in range(rnd.randint(0, 6))]
        docs.append((i * 2 - 50, " ".join(bits)))
    docs += [(1001, docs[7][1]), (1003, docs[7][1]), (1005, "a" * 500), (1007, "ab" * 200 + "a" * 150), (1009, None), (1011, ""), (1013, "x" * 99), (1015, "x" * 99)]
    near = docs[20][1] + passages[4]
    docs += [(2000 + i, near[:i] + "Z" + near[i + 1 :]) for i in range(0, 120, 7)]
    return docs


@pytest.mark.parametrize("seed, size", [(1, 100), (2, 40), (3, 127)])
def test_against_brute_force(spark, seed, size):
    docs = corpus(seed)
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_bytes int").repartition(6)
    assert sorted(map(tuple, rs.repeated_spans(frame, size).collect())) == brute(docs, size)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rs.repeated_spans(none).collect() == []
    long = "q7" * 60
    frame = spark.createDataFrame([(1, long), (1, long), (None, long), (2, long)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_removed"]) for r in rs.repeated_spans(frame).collect()), key=str)
    assert got == [(1, 118), (2, 120), (None, 0)]


def test_radix_groups_are_the_equal_suffixes():
    rng = np.random.default_rng(5)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    at = np.arange(3900)
    items, heads = rs.radix_groups(text, at, np.zeros(len(at), np.int64), 13)
    found = sorted(tuple(sorted(items[a:b].tolist())) for a, b in zip(heads[:-1], heads[1:], strict=True))
    want = {}
    for i in at.tolist():
        want.setdefault(text[i : i + 13].tobytes(), []).append(i)
    assert found == sorted(tuple(v) for v in want.values() if len(v) > 1)


def common_line(n):
    """A line too short to repeat by itself, in many documents between different texts, some of them shared."""
    rnd = random.Random(11)
    text = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    line, ends = text(80), [text(60) for _ in range(5)]
    docs = [(i, text(rnd.randint(60, 200)) + line + (rnd.choice(ends) if i % 3 == 0 else text(90))) for i in range(n)]
    return docs + [(n + 1, (line + text(40)) * 6), (n + 2, docs[5][1] + docs[9][1]), (n + 3, line * 4)]


def test_no_task_holds_all_places_of_a_common_line(spark, monkeypatch):
    docs, real = common_line(400), rs._later_strings

    def watched(size):
        find = real(size)

        def run(batches):
            held = list(batches)
            k = np.concatenate([b.column("k").to_numpy()[b.column("p").to_numpy() >= 0] for b in held] or [np.zeros(0, np.int64)])
            if len(k) and np.unique(k, return_counts=True)[1].max() > 40:
                raise AssertionError("one group of many pieces")
            yield from find(iter(held))

        return run

    monkeypatch.setattr(rs, "HOT", 40, raising=False)
    monkeypatch.setattr(rs, "_later_strings", watched)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, rs.repeated_spans(frame, 100).collect())) == brute(docs, 100)


@pytest.mark.parametrize("seed, size", [(4, 100), (5, 33), (6, 127)])
def test_strings_dealt_one_by_one_against_brute_force(spark, monkeypatch, seed, size):
    monkeypatch.setattr(rs, "HOT", 2, raising=False)
    monkeypatch.setattr(rs, "CHUNK_BYTES", 3000)
    docs = corpus(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert sorted(map(tuple, rs.repeated_spans(frame, size).collect())) == brute(docs, size)


def test_copies_make_no_anchor_hot(spark):
    rnd = random.Random(21)
    text = lambda k: "".join(rnd.choice("abcdefgh ") for _ in range(k))
    copy, line = text(2000), text(80)
    texts = [copy] * 400 + [text(150) + line + text(150) for _ in range(300)]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "text binary").repartition(4)
    levels = rs.hot_values(frame, 100, 100)
    anchors_of = lambda t: set(rs.anchors(*rs.flat(pa.array([t.encode()])), 100)[4].tolist())
    assert levels and not set(levels[0].tolist()) & anchors_of(copy)
    assert set(levels[0].tolist()) & anchors_of(texts[-1])
    assert rs.hot_values(frame.limit(0), 100, 100) == []


def test_rows_of_one_key_and_different_texts(spark):
    rnd = random.Random(22)
    a, b = ("".join(rnd.choice("abcdefgh ") for _ in range(300)) for _ in range(2))
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b)]
    kept = min((a, b), key=lambda t: hashlib.sha256(t.encode()).digest())
    other = b if kept == a else a
    got = sorted(map(tuple, rs.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    assert got == brute([(1, kept), (2, a), (3, b)], 100) and got[0][2] == 0
    assert {r[0]: r[2] for r in got}[2 if kept == a else 3] == 300 and {r[0]: r[2] for r in got}[3 if kept == a else 2] == 0 and other


def test_very_long_text(spark):
    rnd = random.Random(23)
    body = "".join(rnd.choice("abcdefgh ") for _ in range(3_000_000))
    docs = [(1, body), (2, "x" + body[1_500_000:1_500_400] + "y" * 50), (3, body[-250:] + body[:250])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in rs.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (400, 1), 3: (500, 1)}
