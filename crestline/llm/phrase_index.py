"""Decontamination with a positional inverted index over the corpus.

The index is a written table of segments: a segment covers some MB of consecutive documents and
holds, for each distinct word, the ascending positions where it stands.  A search never reads the
texts again; phrases are found by intersecting offset-adjusted position lists, rarest word first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from crestline.llm.staging import new_folder
from crestline.llm.texts import flat, slices, words

INDEX = "segment long, keys array<{key}>, firsts array<long>, terms array<binary>, counts binary, positions binary"
MATCHES = "segment long, row int, item_id {item}, start long, end long"
#: Text bytes of the test items that one pass over the index looks for.
BLOCK_BYTES = 8 << 20
#: Segments of a row group: a writer looks at sizes after a hundred rows only, and a reader takes a row group's rows at once.
GROUP_SEGMENTS = 4


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the positional index of all words of ``text`` and return it.

    A segment row: the documents' keys, the first word position of each document (and the end),
    the distinct words, how often each stands in the segment, and all positions ordered by
    (word, position) as differences.  A null text has no words but keeps its place.
    """
    spark = docs.sparkSession
    schema = INDEX.format(key=docs.schema[key].dataType.simpleString())

    def build(batches):
        from pyspark import TaskContext

        n = 0
        for batch in batches:
            for part in slices(batch, text):
                found = words(*flat(part.column(text)))
                codes, distinct = found.codes()
                places = np.argsort(codes, kind="stable").astype("<i4")
                yield pa.record_batch({
                    "segment": pa.array([(TaskContext.get().partitionId() << 32) + n], pa.int64()),
                    "keys": _one(part.column(key)),
                    "firsts": _one(pa.array(found.rows.astype(np.int64))),
                    "terms": _one(distinct.cast(pa.binary())),
                    "counts": pa.array([np.bincount(codes, minlength=len(distinct)).astype("<i4").tobytes()], pa.binary()),
                    "positions": pa.array([np.diff(places, prepend=np.int32(0)).astype("<i4").tobytes()], pa.binary()),
                })
                n += 1

    path = new_folder(spark, "phrase-index")
    made = docs.select(key, text).mapInArrow(build, schema)
    made.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.block.row.count.limit", GROUP_SEGMENTS).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


class Phrases:
    """The distinct windows of a block of items: their words, the items they come from, rarest word first."""

    def __init__(self, items: list[tuple], size: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        found = words(*flat(texts))
        codes, self.terms = found.codes()
        self.items = [i for i, _ in items]
        windows: dict[tuple, set[int]] = {}
        for k in range(len(items)):
            mine = codes[found.rows[k] : found.rows[k + 1]].tolist()
            for a in range(max(1, len(mine) - size + 1) if mine else 0):
                windows.setdefault(tuple(mine[a : a + size]), set()).add(k)
        self.size = np.array([len(w) for w in windows], np.int64)
        self.words = np.full((len(windows), max(self.size, default=1)), -1, np.int64)
        for row, w in enumerate(windows):
            self.words[row, : len(w)] = w
        owners = list(windows.values())
        self.owners = np.array([i for o in owners for i in sorted(o)], np.int64)
        self.owner_first = np.cumsum([0] + [len(o) for o in owners])
        self.order = np.zeros_like(self.words)

    def rarest_first(self, frequency: np.ndarray) -> None:
        often = np.where(self.words >= 0, frequency[self.words], np.iinfo(np.int64).max)
        self.order = np.argsort(often, axis=1, kind="stable")


def _frequencies(index: DataFrame, shared, n: int) -> np.ndarray:
    """How often each of the block's words stands in the whole corpus."""

    def count(batches):
        total = np.zeros(n, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                terms = batch.column("terms")[k].values
                at = pc.index_in(shared.value.terms.cast(pa.binary()), value_set=terms)
                there = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                counts = np.frombuffer(batch.column("counts")[k].as_py(), "<i4")
                total[there] += counts[at.drop_null().to_numpy()]
        some = np.flatnonzero(total)
        yield pa.record_batch({"term": pa.array(some), "n": pa.array(total[some])})

    summed = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(n, np.int64)
    for row in summed.collect():  # at most one row per word of the block
        out[row["term"]] = row["n"]
    return out


def _lists(batch: pa.RecordBatch, k: int, terms: pa.Array):
    """For a segment: code of each wanted word (-1: absent), first and count of its list, and the lists."""
    at = pc.index_in(terms.cast(pa.binary()), value_set=batch.column("terms")[k].values).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.frombuffer(batch.column("counts")[k].as_py(), "<i4")
    positions = np.cumsum(np.frombuffer(batch.column("positions")[k].as_py(), "<i4"), dtype=np.int64)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    return at, firsts, counts, positions


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices first[i] .. first[i] + count[i] for all i, and the i of each."""
    who = np.repeat(np.arange(len(first)), count)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(who)), who


def _search(index: DataFrame, shared, item_type: str, slop: int | None) -> DataFrame:
    def search(batches):
        phrases: Phrases = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                at, firsts, counts, positions = _lists(batch, k, phrases.terms)
                local = np.where(phrases.words >= 0, at[phrases.words], 0)
                live = np.flatnonzero((local >= 0).all(axis=1))
                rows = np.array(batch.column("firsts")[k].values)
                total = int(rows[-1])
                if not len(live) or not total:
                    continue
                wanted = np.unique(local[live][phrases.words[live] >= 0])
                take, owner = _spread(firsts[wanted], counts[wanted])
                keys = wanted[owner] * total + positions[take]  # ascending: all lists of wanted words
                lead = phrases.order[live, 0]
                lead_word = local[live, lead]
                take, which = _spread(firsts[lead_word], counts[lead_word])
                window, at_lead = live[which], positions[take]
                begin = at_lead - lead[which]
                if slop is None:
                    ok = (begin >= 0) & (begin + phrases.size[window] <= total)
                    window, begin = window[ok], begin[ok]
                    for r in range(1, phrases.words.shape[1]):
                        place = phrases.order[window, r]
                        used = r < phrases.size[window]
                        need = local[window, place] * total + begin + place
                        hit = np.searchsorted(keys, need)
                        ok = ~used | (keys[np.minimum(hit, len(keys) - 1)] == need)
                        window, begin = window[ok], begin[ok]
                    end = begin + phrases.size[window]
                    row = np.searchsorted(rows, begin, "right") - 1
                    ok = end <= rows[row + 1]
                else:
                    row = np.searchsorted(rows, at_lead, "right") - 1
                    low, high = np.maximum(rows[row], at_lead - slop), np.minimum(rows[row + 1] - 1, at_lead + slop)
                    ok = np.ones(len(window), bool)
                    for r in range(1, phrases.words.shape[1]):
                        base = local[window, phrases.order[window, r]] * total
                        near = np.searchsorted(keys, base + low) < np.searchsorted(keys, base + high, "right")
                        ok &= near | (r >= phrases.size[window])
                    begin, end = at_lead, at_lead + 1
                window, begin, end, row = window[ok], begin[ok], end[ok], row[ok]
                if not len(window):
                    continue
                take, who = _spread(phrases.owner_first[window], np.diff(phrases.owner_first)[window])
                item, begin, end, row = phrases.owners[take], begin[who], end[who], row[who]
                order = np.lexsort((begin, item, row))
                item, begin, end, row = item[order], begin[order], end[order], row[order]
                fresh = np.ones(len(item), bool)  # runs of touching windows of one item become one match
                if slop is None:
                    fresh[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (begin[1:] > end[:-1])
                head = np.flatnonzero(fresh)
                tail = np.append(head[1:], len(item)) - 1
                base = rows[row[head]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(head), batch.column("segment")[k].as_py())), pa.array(row[head].astype(np.int32)),
                    pa.array([phrases.items[i] for i in item[head].tolist()], batch_type), pa.array(begin[head] - base), pa.array(end[tail] - base),
                ], names=["segment", "row", "item_id", "start", "end"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    batch_type = to_arrow_type(_parse_datatype_string(item_type))
    return index.mapInArrow(search, MATCHES.format(item=item_type))


def find_phrases(index: DataFrame, items: DataFrame, size: int = 10, item: str = "item_id", text: str = "text", slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where windows of ``size`` consecutive item words stand in the corpus.

    An item of fewer words is one window, one without words has none.  Returns ``segment``,
    ``row`` (the document's place in its segment), ``item_id`` and the word positions ``start``
    to ``end`` (exclusive) in the document; touching windows of an item make one row.

    With ``slop``, words may stand in any order: a match is a place of the window's rarest word
    with each of its other words at most ``slop`` words away in the same document.

    Items are looked for in blocks of about ``block_bytes``, so what a pass broadcasts is bounded.
    """
    spark = index.sparkSession
    kind = items.schema[item].dataType.simpleString()
    some = items.where(F.octet_length(text) > 0).select(F.col(item).alias("i"), F.col(text).alias("t"))
    total = some.select(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = None
    for b in range(blocks):
        mine = some.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b) if blocks > 1 else some
        phrases = Phrases([(r["i"], r["t"]) for r in mine.collect()], size)
        n = len(phrases.terms)
        phrases.rarest_first(_frequencies(index, spark.sparkContext.broadcast(phrases), n) if n else np.zeros(0, np.int64))
        found = _search(index, spark.sparkContext.broadcast(phrases), kind, slop)
        out = found if out is None else out.unionByName(found)
    return out


def documents_of(index: DataFrame, key: str = "doc_id") -> DataFrame:
    """``segment``, ``row``, the key and ``n_words`` of every indexed document."""
    places = F.transform(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.struct(i.alias("row"), F.element_at("keys", i + 1).alias(key), (F.element_at("firsts", i + 2) - F.element_at("firsts", i + 1)).alias("n_words")))
    return index.where(F.size("keys") > 0).select("segment", F.explode(places).alias("d")).select("segment", "d.*")


def contamination(docs: DataFrame, items: DataFrame, size: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Which documents hold windows of benchmark items, one row per input row.

    ``n_words``; ``n_hit``, the words inside any found window; ``n_items``, items with a window
    found; ``items_sha256`` of their ids, sorted as strings and comma-joined; ``contaminated``.
    Null and empty texts have no words; repeated rows and null keys keep a row each; an empty
    corpus gives no rows, empty items give no hits; other columns of both tables are not read.
    """
    index = build_index(docs, key, text)
    found = find_phrases(index, items, size, item, item_text).withColumnRenamed("segment", "s").withColumnRenamed("row", "r")
    hits = found.select("s", "r", F.explode(F.sequence("start", F.col("end") - 1)).alias("w")).groupBy("s", "r").agg(F.countDistinct("w").alias("n_hit"))
    owners = found.groupBy("s", "r").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    marks = hits.join(owners, ["s", "r"])
    all_docs = documents_of(index, key)
    return all_docs.join(marks, (all_docs["segment"] == marks["s"]) & (all_docs["row"] == marks["r"]), "left").select(
        key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "ids"), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows whose text holds no window of an item, with all their columns; null texts stay."""
    sha = F.sha2(F.col(text), 256)
    index = build_index(docs.where(F.col(text).isNotNull()).select(sha.alias("sha"), F.col(text).alias("text")), "sha")
    found = find_phrases(index, items, size, item, item_text).select("segment", "row").distinct()
    bad = documents_of(index, "sha").join(found, ["segment", "row"]).select("sha").distinct()
    return docs.join(bad, sha == bad["sha"], "left_anti")
