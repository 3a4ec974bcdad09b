"""Toxicity and language: held-out accuracy, interactions and edge cases."""

import random

import numpy as np
import pyarrow as pa

from crestline.llm import language_id, toxicity


def mixed_texts(n, seed):
    """Toxic only where an insult stands with a group's name; each alone is harmless."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(25)]
        insult, group = rnd.random() < 0.5, rnd.random() < 0.5
        words += [rnd.choice(["zonko", "zonki"])] * insult + ["vlorp"] * group
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_interactions_are_learned():
    rows, later = mixed_texts(1200, 1), mixed_texts(400, 2)
    machine = toxicity.fit([pa.array([t for _, t, _ in rows])], [np.array([y for *_, y in rows])], rounds=400)
    right = (machine.scores(pa.array([t for _, t, _ in later])) >= 0.5) == np.array([y for *_, y in later])
    assert right.mean() > 0.97


def test_toxicity_on_tables(spark):
    rows = mixed_texts(600, 3)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(9000, None, "s"), (9001, "", "s"), (5, rows[5][1], "s"), (None, "zonko vlorp", "s")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(77777, 1), (8, None), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.learn(docs, labels)
    got = toxicity.score(docs, machine).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 4 == 0 and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.9
    stay = toxicity.keep_clean(docs, machine)
    assert stay.columns == docs.columns and stay.count() == sum(r["predicted"] == 0 for r in got)
    assert toxicity.score(docs.limit(0), toxicity.learn(docs.limit(0), labels.limit(0))).collect() == []


ALPHABETS = {"de": "ßaeiunrst", "en": "thewaoing", "fr": "éauxtions", "es": "ñociadólr", "xx": "кириллц"}


def test_languages(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(500):
        lang = rnd.choice(list(ALPHABETS))
        rows.append((i, " ".join("".join(rnd.choice(ALPHABETS[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(30)), lang if i % 5 else None, lang))
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 !! 34", "en"), (903, "½ ²", None), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([r[:3] for r in rows] + extra, "doc_id long, text string, lang string").repartition(3)
    machines = language_id.learn(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, machines).collect()}
    assert np.mean([got[i]["lang_pred"] == truth for i, _, lang, truth in rows if lang is None]) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und"] * 4
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict(docs.limit(0), language_id.learn(docs.limit(0))).collect() == []
    one = docs.where("lang = 'en'")
    assert {r["lang_pred"] for r in language_id.predict(one, language_id.learn(one)).collect()} <= {"en", "und"}
