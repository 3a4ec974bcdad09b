"""Name matching and nearest controls against brute force."""

import datetime as dt
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from crestline.operators import matching


def names(seed, n):
    rng = random.Random(seed)
    words = ["mary", "saint", "county", "general", "hosp", "med", "center", "north", "lake", "mercy", "univ"]
    out = []
    for _ in range(n):
        w = rng.sample(words, rng.randint(2, 4))
        i = rng.randrange(len(w))
        if rng.random() < 0.5:
            w[i] = w[i][:-1] + rng.choice("aeioux")
        out.append(" ".join(w))
    return out


def best_ratio(a, b):
    """The whole names, and each against the tokens both have."""
    a, b, both = (" ".join(sorted(t)) for t in (set(a.split()), set(b.split()), set(a.split()) & set(b.split())))
    ratio = lambda x, y: 100 * SequenceMatcher(None, x, y, autojunk=False).ratio()
    return max([ratio(a, b)] + [ratio(both, x) for x in (a, b) if both])


def test_blocks_of_many_pairs_equal_the_standard_library():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abc de") for _ in range(rng.choice([0, 1, 3, 12, 40])))
    pairs = [(text(), text()) for _ in range(1500)] + [("abxcd", "abcd"), ("", ""), ("a", "a"), ("aaaa", "aa")]
    pairs += [(x, y) for x in names(4, 15) for y in names(5, 15)] + [("é nord 💡", "nord 💡 é")]
    got = matching.common_letters(*zip(*pairs, strict=True))
    assert got.tolist() == [sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]
    assert matching.common_letters([], []).tolist() == []


@pytest.mark.parametrize("thresholds", [(80.0, 60.0, 40.0), (95.0,), ()])
def test_name_match_equals_brute_force(spark, thresholds):
    left = pd.DataFrame({"id": range(60), "state": [i % 2 for i in range(60)], "name": names(1, 60), "city": [("Saint X", "y.")[i % 2 ^ (i % 3 == 0)] for i in range(60)]})
    left.loc[5, "name"] = "zzz"
    right = pd.DataFrame({"rid": range(90), "state": [i % 2 for i in range(90)], "name": names(2, 90), "city": [("st x", "Y")[i % 2] for i in range(90)]})
    out = matching.match_names(
        spark.createDataFrame(left), spark.createDataFrame(right), "state", "id", "rid", "name", "city", thresholds=thresholds).toPandas().set_index("id")
    for r in left.itertuples():
        pool = right[right.state == r.state]
        scores = sorted(
            ((min(100.0, best_ratio(r.name, p.name) + (2.0 if (p.city == "Y") == (r.city == "y.") else 0.0)), -p.rid, p.city) for p in pool.itertuples()), reverse=True)
        got = out.loc[r.id]
        best, second = scores[0][0], scores[1][0]
        assert bool(got.match_ok) == (best >= 85 and best - second >= 3)
        assert got.score == pytest.approx(best) and got.matched_id == -scores[0][1] and got.matched_city == scores[0][2]
        assert got.second_score == pytest.approx(second) and got.score_gap == pytest.approx(best - second)


def test_equal_names_tie(spark):
    left = spark.createDataFrame([(1, "s", "lake hosp"), (2, "t", "lake hosp")], "id int, state string, name string")
    right = spark.createDataFrame([(1, "s", "lake hosp"), (2, "s", "lake hosp")], "rid int, state string, name string")
    got = {r["id"]: (r["score_gap"], r["match_ok"], r["reason"]) for r in matching.match_names(left, right, "state", "id", "rid", "name").collect()}
    assert got == {1: (0.0, False, "manual review required"), 2: (None, False, "no names in block")}


def test_nearest_controls_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    start = dt.date(2021, 1, 3)
    n = 220
    feats = pd.DataFrame({
        "state": "s", "start": start, "h": range(n), "pre_weeks": rng.choice([2, 3, 4], n, p=[0.1, 0.3, 0.6]),
        "a": rng.normal(size=n) ** 3, "b": rng.normal(size=n) * 50, "c": rng.exponential(size=n), "m": rng.normal(size=n)})
    treated = [3, 50, 117, 200]
    feats.loc[treated, "pre_weeks"] = 4
    cohorts = spark.createDataFrame([(h, "s", start, h) for h in treated], "cohort long, state string, start date, h long")
    out = matching.nearest_controls(
        cohorts, spark.createDataFrame(feats), cohorts, "state", "h", "start", "cohort", ["a", "b", "c"], ["m"], needed=["a", "c"]).toPandas()
    pool = feats[(feats.pre_weeks >= 3) & ~feats.h.isin(treated)]
    for t in treated:
        own = feats[feats.h == t]
        sd = pd.concat([own, pool])[["a", "b", "c", "m"]].std(ddof=1)
        d = np.sqrt((((pool[["a", "b", "c", "m"]] - own[["a", "b", "c", "m"]].iloc[0]) / sd) ** 2).sum(axis=1))
        want = pool.assign(d=d).sort_values(["d", "h"]).head(3)
        got = out[out.cohort == t].sort_values(["distance", "control"])
        assert got["control"].tolist() == want["h"].tolist()
        assert np.allclose(got["distance"], want["d"])


def test_leaves_of_candidates_are_bounded_and_ties_go_to_the_first(spark):
    """Many candidates alike on the first axis, repeated points and missing values: leaves stay small, controls equal brute force."""
    rng = np.random.default_rng(8)
    start, n, axes = dt.date(2021, 1, 3), 1500, ["a", "b", "c", "m"]
    feats = pd.DataFrame({"state": "s", "start": start, "h": rng.permutation(n), "pre_weeks": 4, "a": 1.0, "b": rng.normal(size=n), "c": rng.normal(size=n), "m": rng.normal(size=n)})
    feats.loc[300:599, axes] = feats.loc[300, axes].tolist()
    feats.loc[600:699, ["b", "m"]] = np.nan
    feats.loc[:9, "a"] += rng.normal(size=10)
    table = spark.createDataFrame(feats.astype(object).where(feats.notna(), None), "state string, start date, h long, pre_weeks long, a double, b double, c double, m double")
    leaves = matching.candidate_leaves(table, ["state", "start"], "h", axes, 3, 16).toPandas()
    assert leaves["_size"].max() <= 16 and leaves["_size"].sum() == n - 300 + 3 and len(leaves) < 2 * n / 16
    alike = [p for points in leaves["_points"] for p in points if p["b"] == feats.b[300]]
    assert sorted(p["h"] for p in alike) == sorted(feats.h[300:600])[:3]

    treated = feats.h[[0, 5, 20, 299, 301, 700, 1400]].tolist()
    cohorts = spark.createDataFrame([(h, "s", start, h) for h in treated], "cohort long, state string, start date, h long")
    out = matching.nearest_controls(cohorts, table, cohorts, "state", "h", "start", "cohort", ["a", "b", "c"], ["m"], needed=["a", "c"], leaf=16).toPandas()
    pool = feats[~feats.h.isin(treated)]
    for t in treated:
        own = feats[feats.h == t]
        both = pd.concat([own, pool])[axes]
        both = both.fillna(both.median())
        d = np.sqrt((((both.iloc[1:] - both.iloc[0]) / both.std(ddof=1)) ** 2).sum(axis=1))
        want = pool.assign(d=d).sort_values(["d", "h"]).head(3)
        got = out[out.cohort == t].sort_values(["distance", "control"])
        assert got["control"].tolist() == want["h"].tolist()
        assert np.allclose(got["distance"], want["d"])
