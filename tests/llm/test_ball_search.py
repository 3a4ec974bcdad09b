"""Ranked search against brute force, and what the trees' bounds leave out."""

import math
import random
import re

import numpy as np
import pytest

from crestline.llm import ball_search as bs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, limit):
    held = [(k, t) for k, text in docs if (t := terms(text))]
    n, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for k, t in held:
            m = 100 - 50 + (50 * len(t) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * t.count(w)) // (1000 * t.count(w) + 20 * m)) for w in set(terms(text)) if w in t)
            if s > 0:
                scores.append((-s, k is None, k or 0))
        out += [(item, r, None if null else k, -s) for r, (s, null, k) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "Of", "Ünï", "x9"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n)) + "."
    docs = [(i, text(rnd.choice([1, 4, 30]))) for i in range(200)]
    docs += [(200 + i, docs[3][1]) for i in range(30)]  # ties
    docs += [(5, docs[5][1]), (None, "the w1 w2"), (300, None), (301, ""), (302, "?! ."), (303, text(20_000))]
    items = [(i, text(n)) for i, n in enumerate([0, 1, 3, 12, 40])] + [(9, docs[3][1]), (10, None), (11, "nowhere else"), (12, "")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(k, t, 1, "en") for k, t in docs], "doc_id long, text string, rank int, item_id string"),
            spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, score string"))  # clashing names


@pytest.mark.parametrize("sizes", [{}, {"leaf": 2, "tree": 16}, {"block_bytes": 100, "limit": 3}])
def test_ranked_like_brute_force(spark, corpus, sizes):
    docs, items = corpus
    got = bs.ranked_documents(*frames(spark, docs, items), **sizes).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, items, sizes.get("limit", 50))


def test_empty_tables(spark, corpus):
    docs, items = corpus
    assert bs.ranked_documents(*frames(spark, [], items)).count() == 0
    assert bs.ranked_documents(*frames(spark, docs, [])).count() == 0
    assert bs.ranked_documents(*frames(spark, [], [])).count() == 0


def random_tree(rnd, topics, n, leaf):
    """Documents of a few topics, each with words of its own."""
    first, term, value = [0], [], []
    for r in range(n):
        topic = r % topics
        mine = rnd.choice(20, 8, replace=False) + 20 * topic
        term.append(np.sort(mine))
        value.append(rnd.integers(1, 1_000_000, 8))
        first.append(first[-1] + 8)
    return bs.BallTree(np.array(first), np.concatenate(term), np.concatenate(value), 20 * topics, leaf)


def test_bounds_hold_for_every_node():
    rnd = np.random.default_rng(3)
    tree = random_tree(rnd, 6, 500, 8)
    terms_, weight = np.sort(rnd.choice(120, 30, replace=False)), rnd.integers(1, 20_000, 30)
    full = np.zeros(120, np.int64)
    full[terms_] = weight
    scores = np.add.reduceat(full[tree.term] * tree.value, tree.first[:-1])
    for cuts, bound in zip(tree.cuts, tree.bounds(terms_, weight), strict=True):
        assert cuts[-1] == 500
        assert (np.maximum.reduceat(scores, cuts[:-1]) <= bound).all()


def test_other_topics_are_not_scored():
    rnd = np.random.default_rng(4)
    tree = random_tree(rnd, 16, 4096, 16)
    rows, _, seen = tree.search(np.arange(40, 60), np.full(20, 1000), np.arange(4096), 10, 1)
    assert len(rows) == 10 and seen < 4096 / 4
    assert (rows % 16 == 2).all()
