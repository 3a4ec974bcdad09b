"""Near duplicates against all pairs of labelled shingles."""

import random
import re

import numpy as np
import pyarrow as pa

from crestline.llm import order_minhash as om
from crestline.llm.texts import flat, words


def labelled(text):
    w, seen, out = [x.lower() for x in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)], {}, []
    grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    for g in grams:
        out.append((g, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    return out


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def classes(docs, limit=0.8):
    rows = [(k, t, labelled(t)) if t is not None else (k, None, []) for k, t in docs]
    link = {k: {k} for k, _, _ in rows if k is not None}
    for k, t, a in rows:
        for m, u, b in rows:
            if None not in (k, m, t, u) and k < m:
                c = common(a, b) if a and b else 0
                if t == u or (c and c / (len(a) + len(b) - c) >= limit):
                    link[k].add(m)
                    link[m].add(k)
    out = {}
    for k in link:
        seen, queue = {k}, [k]
        while queue:
            for m in link[queue.pop()] - seen:
                seen.add(m)
                queue.append(m)
        out[k] = min(seen)
    return out


def corpus():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    docs = []
    for family in range(14):
        base = [word() for _ in range(rnd.choice([3, 8, 40, 90, 120]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4])):
                if rnd.random() < 0.5:
                    w[rnd.randrange(len(w))] = word()
                else:
                    w.insert(rnd.randrange(len(w)), word())
            docs.append((" ".join(w), family))
    docs.append((" ".join((docs[30][0] + " ").split()[::-1]), 99))
    docs.append(("again and again and " * 40, 99))
    docs.append(("again and again and " * 39, 99))
    rows = [(i * 3, t) for i, (t, _) in enumerate(docs)]
    rows += [(900, rows[5][1].upper().replace(" ", ", ")), (901, None), (902, ""), (903, "!!"), (904, "!!"), (905, "")]
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in rows] + [(None, rows[0][1], "x"), (*rows[8], "x")], "doc_id long, text string, class_id string").repartition(4)
    want = classes(rows)
    for tile in (1 << 23, 300):
        found = om.near_duplicates(frame, tile_bytes=tile).collect()
        assert {r["doc_id"]: r["class_id"] for r in found if r["doc_id"] is not None} == want
        assert len(found) == len(rows) + 2
        assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in found)
    stay = om.keep_one(frame).collect()
    assert sorted(r["doc_id"] for r in stay if r["doc_id"] is not None) == sorted({*want.values()})
    assert sum(r["doc_id"] is None for r in stay) == 1 and stay[0].asDict().keys() == {"doc_id", "text", "class_id"}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert om.near_duplicates(none).collect() == [] and om.keep_one(none).collect() == []


def test_labelled_shingles_and_alignment():
    texts = ["a b c d e a b c d e a b c d e a", "x", "", "p q r s t u"]
    code, ends = om.shingles(words(*flat(pa.array(texts))))
    assert np.diff(ends).tolist() == [12, 1, 0, 2] and len(set(code[:12].tolist())) == 12
    rng = np.random.default_rng(3)
    for _ in range(100):
        a, b = rng.permutation(30)[:20].tolist(), rng.permutation(30)[:20].tolist()
        at = np.array([b.index(x) if x in b else -1 for x in a])
        assert om.aligned(at, 100) == common(a, b)


def test_pairs_at_the_limit_share_a_sketch():
    """Chance of a shared sketch at a similarity of 0.8, over many texts."""
    rnd = random.Random(11)
    missed = 0
    for _ in range(300):
        w = [str(rnd.random()) for _ in range(120)]
        v = w[:60] + ["new"] + w[60:115] + ["end"] * 5
        code, ends = om.shingles(words(*flat(pa.array([" ".join(w), " ".join(v)]))))
        a, b = om.sketches(code, ends)
        missed += not (a == b).any()
    assert missed == 0
