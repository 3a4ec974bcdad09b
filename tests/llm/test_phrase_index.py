"""Phrase search against brute force over the words of each text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from crestline.llm import phrase_index as px

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(lowered)


def brute(docs, items, size=10):
    out = []
    for key, text in docs:
        mine, hit, found = words(text), set(), set()
        for item, t in items:
            theirs = words(t)
            for a in range(max(1, len(theirs) - size + 1) if theirs else 0):
                w = theirs[a : a + size]
                for p in range(len(mine) - len(w) + 1):
                    if mine[p : p + len(w)] == w:
                        found.add(item)
                        hit.update(range(p, p + len(w)))
        ids = ",".join(sorted(map(str, found)))
        out.append((key, len(mine), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(2)
    text = lambda n: " ".join(rnd.choice(["a", "B", "the", "Ünï", "x9", "cat-dog"]) for _ in range(n))
    items = [(i, text(rnd.choice([0, 3, 9, 10, 14, 30]))) for i in range(40)] + [(100, None), (101, "the"), (7, "a B")]
    docs = [(i, text(rnd.randint(0, 60)) + " " + (items[i % 40][1] or "")[rnd.randint(0, 9) :]) for i in range(120)]
    docs += [(500, None), (501, ""), (3, docs[3][1]), (None, "the"), (502, "the " * 20000)]
    return docs, items


def test_against_brute_force(spark, tables):
    docs, items = tables
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, n_hit int").repartition(3)
    i = spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(tuple, px.contamination(d, i).collect()), key=str) == brute(docs, items)
    index = px.build_index(d)
    whole = px.find_phrases(index, i).collect()
    assert sorted(px.find_phrases(index, i, block_bytes=200).collect()) == sorted(whole)


def test_many_distinct_words(spark):
    own = [f"w{i}" for i in range(70000)]
    docs = [(1, " ".join(own)), (2, " ".join(own[65000:65030]))]
    items = [(k, " ".join(own[a : a + 12])) for k, a in enumerate((0, 30000, 65010, 69980))] + [(9, " ".join(own[65020:65010:-1]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(1)
    got = sorted(map(tuple, px.contamination(d, spark.createDataFrame(items, "item_id int, text string")).collect()))
    ids = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == [(1, 70000, 48, 4, ids("0,1,2,3"), True), (2, 30, 12, 1, ids("2"), True)]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    i = spark.createDataFrame([], "item_id int, text string")
    assert px.contamination(d, i).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r["contaminated"] for r in px.contamination(one, i).collect()] == [False]


def test_proximity(spark):
    docs = [(1, "red x blue y green"), (2, "red x x x x x blue green"), (3, "green blue red"), (4, "blue red")]
    index = px.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(1))
    found = px.find_phrases(index, spark.createDataFrame([(0, "green blue red")], "item_id int, text string"), slop=4)
    keys = {r["row"]: r["doc_id"] for r in px.documents_of(index).collect()}
    assert {keys[r["row"]] for r in found.collect()} == {1, 3}


def test_row_groups_hold_few_segments(spark):
    import pyarrow.parquet as pq

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.repeat(F.lit(text + " "), 40_000).alias("text")).repartition(1)  # a segment each
    index = px.build_index(docs)
    files = [f.removeprefix("file:") for f in index.inputFiles()]
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 20
    for f in files:
        m = pq.ParquetFile(f).metadata
        assert max(m.row_group(i).num_rows for i in range(m.num_row_groups)) <= 4
    assert px.documents_of(index).agg({"n_words": "sum"}).first()[0] == 20 * 30 * 40_000
