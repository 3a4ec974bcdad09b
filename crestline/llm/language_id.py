"""Language identification in two steps: family first, then the family's languages one against one.

Texts are read as counts of hashed byte trigrams of their words.  Linear support vector machines
separate the families, and, within a family, every pair of its languages; the pairs vote.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crestline.llm.sampling import smallest_hashes
from crestline.llm.texts import Words, flat, slices, words

# fixed values: families by ISO 639-1 code; a code that is not here is a family of its own
FAMILIES = {code: family for family, codes in {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la oc pt rm ro sc wa",
    "slavic": "be bg bs cs cu hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "indo-aryan": "as bh bn dv gu hi ks mr ne or pa pi sa sd si ur",
    "iranian": "ae fa ku os ps tg",
    "turkic": "az ba cv kk ky tk tr tt ug uz",
    "uralic": "et fi hu kv se",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "austronesian": "ch fj haw id jv mg mh mi ms na sm su tl to ty",
    "bantu": "hz kg ki kj lg ln lu nd ng nr ny rn rw sn ss st sw tn ts ve xh zu",
    "tai": "lo th za",
    "sinitic": "zh yue wuu",
    "tibeto-burman": "bo dz ii my",
    "inuit": "ik iu kl",
}.items() for code in codes.split()}
UNDETERMINED = "und"

#: Buckets of the trigrams; documents of each language the machines are fitted on, those of smallest key hash.
BUCKETS, SAMPLE_PER_LANGUAGE = 1 << 14, 500
#: Steps of fitting.
STEPS = 200


def trigram_codes(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every trigram of words between blanks, and the word it is in."""
    n = len(found)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(found.bounds)
    spaced = np.full(len(found.letters) + 2 * n, 32, np.uint32)
    at = np.arange(len(found.letters)) + np.repeat(2 * np.arange(n) + 1, size)
    spaced[at] = found.letters
    code = spaced[:-2] * np.uint32(0x9E3779B1) + spaced[1:-1] * np.uint32(0x85EBCA6B) + spaced[2:] * np.uint32(0xC2B2AE35)
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
    word = np.repeat(np.arange(n), size)
    return code[at - 1].astype(np.int64), word


@dataclass
class Machines:
    """One-against-one machines: ``pairs[i]`` are the classes of column i of ``weights``; positive votes for the first."""

    families: list[str]
    members: list[list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray

    def margins(self, found: Words) -> np.ndarray:
        n = len(found.rows) - 1
        code, word = trigram_codes(found)
        row = found.row_of()[word]
        count = np.bincount(row, minlength=n)
        out = np.stack([np.bincount(row, self.weights[code, k], minlength=n) for k in range(self.weights.shape[1])], axis=1) if len(self.pairs) else np.zeros((n, 0))
        return out / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, found: Words, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row: votes of the pairs, ties by the sum of their chances."""
        chance = 1 / (1 + np.exp(-np.clip(self.margins(found) * self.scale, -30, 30)))
        n = len(letters)

        def among(classes: list[str]) -> tuple[np.ndarray, np.ndarray]:
            votes, odds = np.zeros((n, len(classes))), np.zeros((n, len(classes)))
            for k, (a, b) in enumerate(self.pairs):
                if a in classes and b in classes:
                    i, j = classes.index(a), classes.index(b)
                    votes[:, i] += chance[:, k] >= 0.5
                    votes[:, j] += chance[:, k] < 0.5
                    odds[:, i] += chance[:, k]
                    odds[:, j] += 1 - chance[:, k]
            best = (votes + odds / (len(classes) + 1)).argmax(axis=1) if classes else np.zeros(n, np.int64)
            sure = odds[np.arange(n), best] / (len(classes) - 1) if len(classes) > 1 else np.ones(n)
            return best, sure

        family, sure = among(self.families)
        out, score = np.full(n, UNDETERMINED, object), np.zeros(n)
        for f, members in enumerate(self.members):
            best, within = among(members)
            mine = (family == f) & letters
            out[mine] = np.array(members, object)[best[mine]]
            score[mine] = (sure * within)[mine]
        return out.tolist(), score


def _machine(x: np.ndarray, y: np.ndarray, steps: int, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge loss) by full-batch accelerated descent."""
    n = len(y)
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    look_w, look_b = w.copy(), b
    rate = 0.25 / (float((x * x).sum(axis=1).max()) + 1)
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look_w + look_b))
        g = (-2 * share * y * slack).astype(np.float32)
        new_w, new_b = look_w - rate * (x.T @ g + reg * look_w), look_b - rate * float(g.sum())
        push = step / (step + 3)
        look_w, look_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b = new_w, new_b
    return w, b


def shares(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the buckets it has, ascending, and their shares of its trigrams; row r has ``first[r]:first[r + 1]``."""
    found = words(*flat(column))
    code, word = trigram_codes(found)
    row = found.row_of()[word]
    pair, times = np.unique(row.astype(np.int64) * BUCKETS + code, return_counts=True)
    first = np.searchsorted(pair // BUCKETS, np.arange(len(column) + 1))
    whole = np.maximum(np.bincount(row, minlength=len(column)), 1)
    return first, pair % BUCKETS, (times / whole[pair // BUCKETS]).astype(np.float32)


def fit(first: np.ndarray, bucket: np.ndarray, share: np.ndarray, langs: list[str], steps: int = STEPS) -> Machines:
    """Machines from the shares of all sampled rows; only the rows of one pair of classes are laid out in full at a time."""
    known = sorted(set(langs))
    family_of = {c: FAMILIES.get(c.lower().replace("_", "-").split("-")[0], c) for c in known}
    families = sorted(set(family_of.values()))
    members = [[c for c in known if family_of[c] == f] for f in families]
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS) >= 3)
    column = np.full(BUCKETS, -1, np.int64)
    column[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(langs)), np.diff(first))

    def laid_out(mine: np.ndarray) -> np.ndarray:
        place = np.full(len(langs), -1)
        place[mine] = np.arange(mine.sum())
        keep = mine[row] & (column[bucket] >= 0)
        x = np.zeros((int(mine.sum()), len(used)), np.float32)
        x[place[row[keep]], column[bucket[keep]]] = share[keep] * 30
        return x

    lang, fam = np.array(langs, object), np.array([family_of[c] for c in langs], object)
    pairs, weights, bias, scale = [], [], [], []
    for classes, owner in [(families, fam)] + [(m, lang) for m in members]:
        for i, a in enumerate(classes):
            for b in classes[i + 1 :]:
                mine = (owner == a) | (owner == b)
                y = np.where(owner[mine] == a, 1.0, -1.0).astype(np.float32)
                w, c = _machine(laid_out(mine), y, steps)
                pairs.append((a, b))
                full = np.zeros(BUCKETS)
                full[used] = w * 30
                weights.append(full)
                bias.append(c)
                scale.append(3.0)
    return Machines(families, members, pairs, np.stack(weights, axis=1) if weights else np.zeros((BUCKETS, 0)), np.array(bias), np.array(scale))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Machines:
    """Fit in one task on at most ``per_language`` documents of each language, those of smallest key hash.

    Texts of any length may be in the sample: their trigrams are counted where they lie, and only the
    counts go to the fitting task.  Rows without a key, a language or text are not used; of rows of
    one key and language one is.
    """
    marked = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & (F.octet_length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sample = F.broadcast(smallest_hashes(marked.select("k", "l").distinct(), "k", per_language, F.col("l")))  # at most so many keys of each language

    def count(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                first, bucket, share = shares(part.column("t"))
                at = pa.array(first, pa.int32())
                yield pa.record_batch({
                    "k": part.column("k"), "l": part.column("l"),
                    "bucket": pa.ListArray.from_arrays(at, pa.array(bucket, pa.int32())), "share": pa.ListArray.from_arrays(at, pa.array(share, pa.float32())),
                })

    def train(batches):
        parts, langs = [], []
        for batch in batches:
            parts.append((np.diff(batch.column("bucket").offsets.to_numpy()), batch.column("bucket").flatten().to_numpy(), batch.column("share").flatten().to_numpy()))
            langs += batch.column("l").to_pylist()
        size, bucket, share = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), bucket.astype(np.int64), share, langs))], pa.binary())})

    kind = docs.schema[key].dataType.simpleString()
    rows = marked.join(sample, ["k", "l"], "left_semi").mapInArrow(count, f"k {kind}, l string, bucket array<int>, share array<float>")
    one = rows.groupBy("k", "l").agg(F.min(F.struct("bucket", "share")).alias("r")).select("k", "l", "r.*")
    made = one.repartition(1).sortWithinPartitions("k", "l").select("l", "bucket", "share").mapInArrow(train, "model binary").first()
    return pickle.loads(made[0]) if made else fit(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), [])


def predict(docs: DataFrame, machines: Machines, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` for every row, from the whole text alone.

    ``und`` with score 0 where the text is null or has no letter.  Repeated rows and null keys keep
    a row each; an empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machines)
    kind = docs.schema[key].dataType.simpleString()

    def rate(batches):
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                data, offsets = flat(column)
                latin = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
                has = np.add.reduceat(np.append(latin, False).astype(np.int64), np.minimum(offsets[:-1], len(data))) > 0
                has &= np.diff(offsets) > 0
                for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
                    has[i] = any(c.isalpha() for c in column[i].as_py())
                codes, score = shared.value.predict(words(data, offsets), has)
                yield pa.record_batch({key: part.column(key), "lang_pred": pa.array(codes, pa.string()), "score": pa.array(score)})

    return docs.select(key, text).mapInArrow(rate, f"`{key}` {kind}, lang_pred string, score double")
