"""Token counts and token files against the library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from crestline.llm import token_files
from crestline.llm.pretokens import Encoder
from crestline.llm.queries import tokenizer
from crestline.llm.token_counts import count_tokens

BITS = [" ", "  ", "\n", "'", "'s", "'re", "'ll", "a", "Be", "é", "É", "ß", "×", "1", "23", ".", "!?", "<|endoftext|>", "中", "\t", "don't", "İ", "ª", "\x00"]


def texts(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 12))) for _ in range(n)] + ["", "same text", "same text", "word " * 30000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_librarys_ids(name):
    mine, library, rows = Encoder(tokenizer(name)), Tokenizer.from_file(tokenizer(name)), texts(3000)
    ids, at = mine.encode(pa.array(rows + [None]))
    for i, row in enumerate(rows):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(row, add_special_tokens=False).ids, row
    assert at[-1] == at[-2]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "x") for i, t in enumerate(texts(200))] + [(-5, None, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(5)


def test_counts(docs):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in count_tokens(docs, tokenizer("word_bpe_49k.json"), size=50).collect()}
    assert len(got) == docs.count()
    for row in docs.collect():
        n = len(library.encode(row["text"] or "", add_special_tokens=False).ids)
        r = got[row["doc_id"]]
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((row["text"] or "").encode()), n > 2048)


def test_files(docs, tmp_path):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    made = token_files.write_tokens(docs, tokenizer("byte_bpe_50k.json"), str(tmp_path / "set"), end_id=2)
    assert token_files.open_tokens(str(tmp_path / "set")) == made
    got = sorted(token_files.read_tokens(docs.sparkSession, made, with_ids=True).collect())
    start = 0
    for r, row in zip(got, sorted(docs.collect(), key=lambda r: r["doc_id"]), strict=True):
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["ids"]) == (row["doc_id"], start, ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty_and_null_keys(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert count_tokens(none, tokenizer("word_bpe_49k.json")).collect() == []
    assert token_files.token_round_trip(none, tokenizer("byte_bpe_50k.json"), 2).collect() == []
    with pytest.raises(ValueError):
        token_files.write_tokens(spark.createDataFrame([(None, "a")], "doc_id long, text string"), tokenizer("byte_bpe_50k.json"), str(tmp_path / "x"))


def test_null_keys_are_written_and_read_back(spark, tmp_path):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    rows = [(i * 3 - 9, t) for i, t in enumerate(texts(60, 7))] + [(None, t) for t in texts(60, 8)] + [(None, None), (0, "x"), (None, "x"), (None, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(((k, library.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in rows), key=str)
    back = token_files.token_round_trip(frame, tokenizer("byte_bpe_50k.json"), 2).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in back), key=str) == sorted(((k, len(ids), crc(ids)) for k, ids in want), key=str)
    made = token_files.write_tokens(frame, tokenizer("byte_bpe_50k.json"), str(tmp_path / "set"), end_id=2, file_bytes=100, null_keys=True)
    got = sorted(token_files.read_tokens(spark, made, with_ids=True).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=str) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got]).tolist()[:-1]]
    keys = [r["doc_id"] for r in got]
    nulls = keys.count(None)
    assert keys[:nulls] == [None] * nulls and keys[nulls:] == sorted(keys[nulls:])


def test_library_gets_few_pieces_at_once():
    """Its answer for all pieces of a slice took hundreds of MB of a worker."""
    import public_tokenizers
    import pyarrow as pa

    from crestline.llm import pretokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, lots = pretokens.Encoder(path), []
    add = coder._add
    coder._add = lambda pieces: lots.append(len(pieces)) or add(pieces)
    text = " ".join(f"w{'abcdefghij'[i % 10]}x{i}" for i in range(20_000))
    ids, at = coder.encode(pa.array([text, None, "end"]))
    assert max(lots) <= 4096 and len(lots) > 3
    assert ids[at[0] : at[1]].tolist() == coder.library.encode(text, add_special_tokens=False).ids and at[1] == at[2]


def test_pieces_met_again_outlast_a_full_table(monkeypatch):
    """Rare pieces fill the table over and over; frequent ones go to the library once, joined pieces give its ids."""
    from crestline.llm import pretokens

    monkeypatch.setattr(pretokens, "CACHE_PIECES", 400)
    coder, given = pretokens.Encoder(tokenizer("byte_bpe_50k.json")), []
    add = coder._add
    coder._add = lambda pieces: given.extend(pieces) or add(pieces)
    often = " ".join(f"often{'abcdefghij'[i]}" for i in range(10)) + " it's 12 'x' end"
    for r in range(12):
        rare = " ".join("rare" + "".join("abcdefghij"[int(d)] for d in str(r * 100 + i)) for i in range(100))
        rows = [f"a {often} {rare}", " \u4e2d b", "end\u00a0", " c<|endoftext|>", " d"]
        ids, at = coder.encode(pa.array(rows))
        for i, row in enumerate(rows):
            assert ids[at[i] : at[i + 1]].tolist() == coder.library.encode(row, add_special_tokens=False).ids
    assert len(given) > 1200 and given.count(b" oftenb") == 1
