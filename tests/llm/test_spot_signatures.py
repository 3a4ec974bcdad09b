"""Spot signatures against a plain version of the rule."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from crestline.llm import spot_signatures as ss


def spots(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [(w, words[i - 1] if i else "") for i, w in enumerate(words) if w not in ss.ANCHORS]
    out = set()
    for j, (w, before) in enumerate(content):
        if before == "" or before in ss.ANCHORS:
            nxt = content[j + 1][0] if j + 1 < len(content) else ""
            out.add(hashlib.md5(f"{before}|{w}|{nxt}".encode()).hexdigest()[:15])
    return out


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute(docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    out = []
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + nxt[:m]
        a, e, n = spots(t), spots(edited), spots(nxt)
        out.append((k, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(a)), "".join(sorted(e)), like(a, e), like(a, n)))
    return sorted(out, key=str)


def table(spark, docs):
    return spark.createDataFrame([(k, t, "x", 0) for k, t in docs], "doc_id long, text string, n_chars string, k int")


@pytest.mark.parametrize("n", [1, 2, 40])
def test_like_plain_version(spark, n):
    texts = ["The cat sat on the mat and the dog of a neighbour barked.", "", None, "...", "the of and", "Ünï über die Straße 𝒳 of 💡 light the end", "x", "la casa de la abuela es grande " * 50]
    docs = [(7 * i % 41, texts[i % len(texts)]) for i in range(n)]
    got = ss.fingerprints(table(spark, docs).repartition(5))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs)


def test_repeated_rows_null_keys_and_empty_table(spark):
    docs = [(1, "of the same row"), (1, "of the same row"), (None, "a house"), (2, "a tree in the wood"), (1, "an other text")]
    got = [tuple(r) for r in ss.fingerprints(table(spark, docs)).select("doc_id", "n_chars", "fingerprint").collect()]
    assert sorted((k is None, k or 0, n) for k, n, _ in got) == [(False, 1, 13), (False, 1, 15), (False, 1, 15), (False, 2, 18), (True, 0, 7)]
    assert len({f for k, n, f in got if n == 15}) == 1
    assert ss.fingerprints(table(spark, [])).count() == 0


def test_very_long_text(spark):
    long = "the river runs to " + " ".join(f"word{i} of stone{i}" for i in range(60_000))
    rows = ss.fingerprints(table(spark, [(1, long), (2, "short of breath")])).orderBy("doc_id").collect()
    assert rows[0]["n_chars"] == len(long) and rows[0]["fingerprint"] == "".join(sorted(spots(long)))


def test_pruning_loses_nothing_that_is_near(spark):
    sets = [list(range(a, b)) for a, b in [(0, 0), (0, 10), (1, 10), (0, 11), (5, 30), (0, 100), (3, 100), (200, 210)]]
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets], "a array<long>, b array<long>")
    got = pairs.select("a", "b", ss.pruned_jaccard(F.col("a"), F.col("b")).alias("whole"), ss.pruned_jaccard(F.col("a"), F.col("b"), 0.8).alias("near")).collect()
    for a, b, whole, near in got:
        assert whole == like(set(a), set(b))
        assert near == (whole if whole >= 0.8 else None)


def test_python_takes_no_part(spark):
    plan = ss.fingerprints(table(spark, [(1, "of a kind")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
