"""Linked vectors and components against all pairs."""

import math

import numpy as np
import pytest

from crestline.llm import vector_links as vl
from crestline.llm.components import components


def brute(rows, threshold):
    def sound(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    linked = {i: set() for i in range(len(rows))}
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and label is not None and label == other and sound(v) and sound(w) and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= threshold:
                    linked[i].add(j)
    out = []
    for i, (key, _, _) in enumerate(rows):
        seen, queue = {i}, [i]
        while queue:
            for j in linked[queue.pop()] - seen:
                seen.add(j)
                queue.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((key, len(linked[i]), least, key == least))
    return sorted(out)


@pytest.mark.parametrize("dims, tile", [(64, 2048), (20, 16)])
def test_against_all_pairs(spark, dims, tile):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    spread = 0.28 if dims == 64 else 0.25
    data = [(centres[i % 12] + rng.normal(size=dims) * spread).astype(np.float32).tolist() for i in range(400)]
    rows = [(i * 7, v, i % 3 if i % 50 else None) for i, v in enumerate(data)]
    rows += [(5000 + i, data[24], 0) for i in range(30)] + [(6000, [x * 2 for x in data[24]], 0), (6001, data[24][:-1], 0)]
    rows += [(7000, None, 0), (7001, [], 0), (7002, [0.0] * dims, 0), (7003, [float("nan")] + data[0][1:], 0), (7004, [None] + data[0][1:], 0), (7005, [float("inf")] + data[0][1:], 0)]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<float>, label int, kept int").repartition(5)
    got = sorted(map(tuple, vl.near_vectors(frame, 0.93, tile=tile).collect()))
    want = brute(rows, 0.93)
    assert got == want
    assert sum(r[1] for r in want) > 500


def test_empty(spark):
    assert vl.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (300, 400), (7, 7)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 200, 300, 400)}, **{1000 + i: 1000 for i in range(50)}}


def group_of_near_vectors():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    near = [(i, (centre + rng.normal(size=64) * 0.15).astype(np.float32).tolist(), 1) for i in range(200)]
    return near + [(200 + i, rng.normal(size=64).astype(np.float32).tolist(), i % 2) for i in range(40)] + [(300, near[7][1], 1), (301, [1e-200] * 64, 1), (302, [-1e-200] * 64, 1)]


@pytest.mark.parametrize("sizes", [{}, {"tile": 30}, {"whole": 0}, {"whole": 60, "tile": 30}])
def test_whole_labels_and_cells(spark, sizes):
    rows = group_of_near_vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows[:-2], 0.93) + [(i, 0, i, True) for i in (301, 302)]  # their squares are zero as doubles
    assert sorted(map(tuple, vl.near_vectors(frame, 0.93, **sizes).collect())) == want


def test_pairs_stay_in_their_tasks(spark, monkeypatch):
    sizes, staged = [], vl.staged
    monkeypatch.setattr(vl, "staged", lambda df, purpose="stage": sizes.append((purpose, df.count())) or staged(df, purpose))
    frame = spark.createDataFrame(group_of_near_vectors(), "vec_id long, embedding array<double>, label int")
    out = vl.near_vectors(frame, 0.93)
    assert out.agg({"n_links": "sum"}).first()[0] > 30_000
    assert dict(sizes)["links"] <= 201  # before, a row for each of the pairs


def test_component_joins_are_not_broadcast(spark, monkeypatch):
    from crestline.llm import components as module

    plans, staged = [], module.staged
    monkeypatch.setattr(module, "staged", lambda df, purpose="stage": plans.append(df._jdf.queryExecution().sparkPlan().toString()) or staged(df, purpose))
    links = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    assert components(links).count() == 51
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
