"""The pipeline's rows against brute force, stage by stage."""

import random

import pytest
from test_order_minhash import classes
from test_phrase_index import brute as contaminated
from test_secret_tags import brute as secret_spans
from tokenizers import Tokenizer

import corpus_pipeline
from crestline.llm.queries import tokenizer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rnd.randint(20, 80))) for _ in range(260)]
    items = [(i, " ".join(word() for _ in range(15))) for i in range(5)]
    docs, toxic = [], {}
    for i, t in enumerate(texts):
        bad = i % 4 == 0
        if bad:
            w = t.split()
            w[3:3] = [rnd.choice(["zzqarg", "zzqirk"])] * 2 + ["zzvlop"]
            t = " ".join(w)
        elif i % 17 == 1:
            t += " " + items[i % 5][1] + " end"
        elif i % 11 == 2:
            t += "\npassword = " + "".join(rnd.choice("ABCdef0123456789") for _ in range(20)) + "\nmore text here"
        toxic[i] = int(bad)
        docs.append((i, t))
    for i in range(1, 40, 3):
        w = docs[i][1].split(" ")
        docs += [(1000 + i, docs[i][1]), (2000 + i, " ".join(w[:-1]))]
    docs += [(3000, None), (3001, ""), docs[6], (None, "a row without an id")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in toxic.items() if k % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items, toxic


def test_stages_and_run(spark, tables):
    folder, docs, items, toxic = tables
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns = now.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == columns, name
        out.write.parquet(f"{folder}/stage-{name}.parquet")
        now = spark.read.parquet(f"{folder}/stage-{name}.parquet")
        seen.append(sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in now.collect()), key=str))
    clean = [d for d in docs if not (d[0] in toxic and toxic[d[0]])]
    # copies of toxic documents have no label but the same words
    clean = [(k, t) for k, t in clean if "zzv" not in (t or "")]
    assert [(k, t) for k, t, _ in seen[0]] == sorted(clean, key=str)
    least = classes([d for d in clean if d[0] is not None])
    kept = sorted({(k, t) for k, t in clean if k is None or least[k] == k}, key=str)
    assert [(k, t) for k, t, _ in seen[1]] == kept
    marks = {(r[0]): r[-1] for r in contaminated(kept, items)}
    kept = [d for d in kept if not marks[d[0]]]
    assert [(k, t) for k, t, _ in seen[2]] == kept
    for (k, t), (key, text, n) in zip(kept, seen[3], strict=True):
        assert k == key and n == (None if text is None else len(text))
        assert (text == t) == (not secret_spans(t)) and not secret_spans(text)
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    want = sorted(((k, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for k, t, _ in seen[3]), key=str)
    total = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert sorted(total.items(), key=str) == want


def test_empty(spark, tables, tmp_path):
    spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
