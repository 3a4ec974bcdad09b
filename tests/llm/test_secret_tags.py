"""Secrets: fixed patterns, decoding against the plain recursion, redaction."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from crestline.llm import secret_tags as st
from crestline.llm.texts import flat


def filler(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 8))) for _ in range(n))


def secret(rnd, n=20):
    return "".join(rnd.choice("ABCDEFGHJKmnpqrstuv0123456789") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    out = []
    for i in range(300):
        text = filler(rnd, 30)
        if i % 3 == 0:
            text += f"\n{rnd.choice(['password', 'API_KEY', 'token', 'Secret'])}{rnd.choice([': ', '=', ' = '])}{secret(rnd)}\n" + filler(rnd, 5)
        if i % 7 == 0:
            text += " AKIA" + secret(rnd, 16).upper() + " é " + "".join(rnd.choice("0123456789abcdef") for _ in range(32)) + "."
        out.append((i, text))
    return out + [(900, None), (901, ""), (902, "passwd=short AKIA12 deadbeef"), (903, "x" * 100000), (4, out[4][1])]


def brute(text):
    """Counts and spans straight from the patterns' wording."""
    found, t = [], text or ""
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(found)


def test_spans(spark, rows):
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int").repartition(3)
    field = st.learn(frame)
    got = sorted(st.find_secrets(frame, field).collect(), key=lambda r: r["doc_id"])
    for r, (key, text) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True):
        base = brute(text)
        assert r["doc_id"] == key and r["base_spans"] == ",".join(f"{st.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert set(filter(None, r["base_spans"].split(","))) <= set(r["spans"].split(","))
    clean = {r["doc_id"]: r for r in st.redact_secrets(frame, field).collect()}
    for key, text in rows:
        for a, k, b in brute(text):
            assert k == 0 or text[a:b] not in clean[key]["text"]
        if not brute(text):
            assert clean[key]["text"] == text
    assert clean[900]["text"] is None


def test_field_finds_what_no_pattern_fits(spark, rows):
    field = st.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    rnd = random.Random(3)
    texts = [f"{filler(rnd, 12)}\ntoken -> {secret(rnd)}\n{filler(rnd, 9)}" for _ in range(20)]
    found = [[s for s in spans if s[1] == 3] for spans in st.all_spans(pa.array(texts), field)]
    assert not any(map(brute, texts)) and sum(map(bool, found)) >= 15
    assert not any(s for spans in st.all_spans(pa.array([filler(rnd, 200) for _ in range(50)]), field) for s in spans)


def test_decoding_is_viterbi_over_whole_lines():
    rng = np.random.default_rng(2)
    rnd = random.Random(5)
    texts = [filler(rnd, 20) + f" x = {secret(rnd, 9)}\n" * rnd.randint(0, 3) + filler(rnd, 4) for _ in range(40)]
    t = st.tokens_of(*flat(pa.array(texts)))
    for scale in (0.3, 1.0, 2.0):
        field = st.Field({k: rng.normal(-0.6, scale, (n, 2)) for k, n in st.TABLES.items()}, rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3))
        tags, e = st.decode(field, t), np.zeros((len(t.code), 3))
        e[:, 1:] = field.emissions(st.features(t))
        for line in np.unique(t.line):
            at = np.flatnonzero(t.line == line)
            assert tags[at].tolist() == st.viterbi(e[at], field.steps, field.first, np.zeros(3))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert st.find_secrets(none).collect() == [] and st.redact_secrets(none).collect() == []
