"""Token ids in flat binary files: unsigned integers, 64-bit document offsets, bases by prefix sums."""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from crestline.llm.pretokens import encoder
from crestline.llm.staging import new_folder
from crestline.llm.texts import slices

#: Encoded bytes (UTF-8 text) aimed at per file.
FILE_BYTES = 64 << 20


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _put(store: fs.FileSystem, path: str, write) -> None:
    """Write under a name of this attempt's own, then rename: a lost or repeated task leaves whole files only."""
    own = f"{path}.{os.urandom(8).hex()}.tmp"
    with store.open_output_stream(own) as out:
        write(out)
    store.move(own, path)


def _array(store: fs.FileSystem, path: str, dtype) -> np.ndarray:
    """A file as an array, memory-mapped where the store is a file system of the machine."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


@dataclass(frozen=True)
class TokenFiles:
    """A written set: per part ``NNNNNN.ids``, ``.offsets`` (ids before each document of the part, and the
    total), ``.docs`` (keys, 0 where null) and ``.valid`` (a byte per document, 0 where its key is null), and
    ``bases.json`` with the parts' first global offsets."""

    folder: str
    width: int
    parts: list[int]
    bases: list[int]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES, null_keys: bool = False) -> TokenFiles:
    """Encode documents in ascending key order and write them; each part is one range of keys.

    Ids take 2 bytes where the vocabulary allows it, else 4, little-endian.  ``end_id`` follows
    each document.  Null texts are empty; documents of equal keys keep their own entries, ordered
    by text.  With ``null_keys`` rows with a null key are written as well: before all others, ordered by a
    hash of the text and then the text, so that many of them are dealt over files too; without it they
    raise an error before anything is written.  An empty table writes a set of no parts.
    """
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length(text)).alias("b"), F.sum(F.col(key).isNull().cast("int")).alias("nulls")).first()
    if size["nulls"] and not null_keys:
        raise ValueError(f"{size['nulls']} rows have no {key}")
    top = max(encoder(tokenizer).vocabulary - 1, end_id or 0)
    width = 2 if top < 1 << 16 else 4
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["b"] or 0) // file_bytes))
    keyed = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    if size["nulls"]:
        keyed = keyed.withColumn("u", F.when(F.col("k").isNull(), F.xxhash64("t")))
        ranged = keyed.repartitionByRange(n, "k", "u").sortWithinPartitions("k", "u", "t").drop("u")
    else:
        ranged = keyed.repartitionByRange(n, "k").sortWithinPartitions("k", "t")

    def write(batches):
        from pyspark import TaskContext

        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        counts, keys, valid, totals = [], [], [], [0]

        def ids_of(out):
            for batch in batches:
                for piece in slices(batch, "t"):
                    ids, at = coder.encode(piece.column("t"))
                    if end_id is not None:
                        ids = np.insert(ids, at[1:], end_id)
                        at = at + np.arange(len(at))
                    out.write(ids.astype(f"<u{width}").tobytes())
                    counts.append(np.diff(at))
                    keys.append(pc.fill_null(piece.column("k"), 0).to_numpy())
                    valid.append(pc.is_valid(piece.column("k")).to_numpy(zero_copy_only=False))
                    totals[0] += len(ids)

        _put(store, f"{place}/{part:06d}.ids", ids_of)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype("<i8")
        _put(store, f"{place}/{part:06d}.offsets", lambda out: out.write(offsets.tobytes()))
        _put(store, f"{place}/{part:06d}.docs", lambda out: out.write((np.concatenate(keys) if keys else n).astype("<i8").tobytes()))
        _put(store, f"{place}/{part:06d}.valid", lambda out: out.write((np.concatenate(valid) if valid else n).astype("u1").tobytes()))
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "n_ids": pa.array([totals[0]], pa.int64())})

    totals = sorted((r["part"], r["n_ids"]) for r in ranged.mapInArrow(write, "part int, n_ids long").collect())
    bases = np.cumsum([0] + [n for _, n in totals])
    made = TokenFiles(folder, width, [p for p, _ in totals], bases.tolist()[:-1])
    store, place = _store(folder)
    store.create_dir(place, recursive=True)
    _put(store, f"{place}/bases.json", lambda out: out.write(json.dumps({"width": width, "parts": made.parts, "bases": made.bases}).encode()))
    return made


def open_tokens(folder: str) -> TokenFiles:
    store, place = _store(folder)
    with store.open_input_stream(f"{place}/bases.json") as file:
        found = json.loads(file.read())
    return TokenFiles(folder, found["width"], found["parts"], found["bases"])


def read_tokens(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id`` (null where the key was), ``start`` (ids before it in the whole set),
    ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ``ids``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not files.parts:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame(list(zip(files.parts, files.bases, strict=True)), T.StructType([T.StructField("part", T.IntegerType()), T.StructField("base", T.LongType())]))
    folder, width = files.folder, files.width

    def read(batches):
        store, place = _store(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                kinds = (("ids", f"<u{width}"), ("offsets", "<i8"), ("docs", "<i8"), ("valid", "u1"))
                ids, offsets, docs, valid = (_array(store, f"{place}/{part:06d}.{kind}", dtype) for kind, dtype in kinds)
                for first in range(0, len(docs), 4096):
                    at = offsets[first : first + 4097]
                    crc = [zlib.crc32(np.ascontiguousarray(ids[a:b], "<u4")) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    out = {
                        "doc_id": pa.array(docs[first : first + 4096], mask=valid[first : first + 4096] == 0), "start": pa.array(base + at[:-1]), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        out["ids"] = pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(ids[at[0] : at[-1]].astype(np.int64)))
                    yield pa.record_batch(out)

    return parts.repartition(len(files.parts)).mapInArrow(read, schema)


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to the shared folder and read every document back, those of null keys too."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer, new_folder(spark, "tokens"), end_id, key, text, null_keys=True))
