"""Tokenizing with a library tokenizer, each distinct pre-token encoded once per worker.

Texts are cut where the tokenizer itself always cuts, on whole slices of bytes; distinct pieces are
encoded by the library and the rest is looked up.  A text with characters whose class is not plain
(outside ASCII and the Latin letters U+00C0 to U+00FF) or with a possible special string is one piece
and goes to the library as it is, so results are always the library's.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from crestline.llm.texts import flat, pieces_array

SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
CLASS = np.full(256, OTHER, np.uint8)
CLASS[9:14] = CLASS[32] = SPACE
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = LETTER

#: Pieces longer than this are not kept in a worker's cache.
KEPT_BYTES = 64
#: Distinct pieces a worker keeps before it drops those not met again; pieces given to the library at once (its answer
#: holds far more than the ids).
CACHE_PIECES, ADDED_PIECES = 500_000, 4096


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with characters other than ASCII and U+00C0..U+00FF letters, or with '<|'."""
    high = data >= 128
    prior = np.zeros_like(data)
    prior[1:] = data[:-1]
    plain = (data == 0xC3) | ((prior == 0xC3) & (data < 0xC0) & (data != 0x97) & (data != 0xB7))
    odd = (high & ~plain) | ((data == ord("|")) & (prior == ord("<")))
    return np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)


def _edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of rows and, per byte, whether it is the last of its row."""
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.zeros(len(data), bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    return first, last


def byte_level_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pre-tokens of the byte-level pattern: one blank leads a run of letters, digits or signs."""
    kind = CLASS[data]
    first, last = _edges(data, offsets)
    blank, space = data == 32, kind == SPACE
    prior_kind, prior_blank = np.full_like(kind, 255), np.zeros_like(blank)
    prior_kind[1:], prior_blank[1:] = kind[:-1], blank[:-1]
    cut = first | (kind != prior_kind)
    cut &= first | ~(prior_blank & ~space)
    # the last of several white characters before something else stands alone or leads the next piece
    ends_run = np.zeros_like(space)
    ends_run[:-1] = space[:-1] & ~space[1:]
    ends_run &= ~last
    cut |= ends_run
    quotes = np.flatnonzero((data == 39) & cut & ~last)
    if len(quotes):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = padded[quotes + 1], padded[quotes + 2]
        near = ~last[quotes + 1]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = near & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for hit, size in ((quotes[one], 2), (quotes[two], 3)):
            cut[hit + 1] = False
            after = hit + size
            cut[after[after < len(data)]] = True
    return np.flatnonzero(cut)


_PLAIN = bytes(i for i in range(128) if CLASS[i] in (LETTER, DIGIT))
_LED, _ENDS = frozenset(_PLAIN + b"\xc3"), frozenset(bytes([i]) for i in _PLAIN)


def _joins(before: bytes, piece: bytes) -> bool:
    """Whether the byte-level pattern surely cuts between two pieces: after a letter or digit, before a blank that leads one."""
    return len(piece) > 1 and piece[0] == 32 and piece[1] in _LED and before[-1:] in _ENDS


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of letter runs, digits and sign runs; stretches with an apostrophe stay whole between white space."""
    kind = CLASS[data]
    first, _ = _edges(data, offsets)
    prior = np.full_like(kind, 255)
    prior[1:] = kind[:-1]
    space_edge = first | ((kind == SPACE) != (prior == SPACE))
    cut = space_edge | (kind != prior)
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        runs = np.flatnonzero(space_edge)
        held = np.unique(np.searchsorted(runs, quotes, "right") - 1)
        ends = np.append(runs, len(data))
        for r in held.tolist():
            cut[ends[r] + 1 : ends[r + 1]] = False
    return np.flatnonzero(cut)


def cut_rule(path: str):
    """How texts may be cut for a tokenizer file, None where only whole texts are safe."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return byte_level_cuts
    parts = [p.get("type") for p in pre.get("pretokenizers", [])]
    steps = [p.get("type") for p in (norm or {}).get("normalizers", [])]
    pattern = json.dumps(pre)
    if parts == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"] and "[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in pattern:
        return word_cuts
    return None


class Encoder:
    """One library tokenizer with a bounded table of the pieces it has encoded."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.rule = cut_rule(path)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.widths = self._byte_widths() if self.rule is byte_level_cuts else None
        self._clear()

    def _byte_widths(self) -> np.ndarray:
        """Bytes of text that each id stands for; a byte-level token has one character per byte."""
        widths = np.zeros(self.vocabulary, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            if i < len(widths):
                widths[i] = len(token)
        for i, token in self.library.get_added_tokens_decoder().items():
            if i < len(widths):
                widths[i] = len(token.content.encode())
        return widths

    def _clear(self) -> None:
        #: Pieces kept, their places and whether they were met again.
        self.table, self.at, self.again = pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.n_ids = self.n_pieces = 0

    def _drop(self) -> None:
        """Keep the pieces that were met again, none if these are too many."""
        rows = np.flatnonzero(self.again)
        table, at, ids, start, size = self.table, self.at[rows], self.ids, self.start, self.size
        self._clear()
        if 0 < len(rows) <= CACHE_PIECES // 2:
            kept, sizes = table.take(pa.array(rows)), size[at]
            self._keep(ids[spread(start[at], sizes)], sizes)
            self.table, self.at, self.again = kept, np.arange(len(rows)), np.zeros(len(rows), bool)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of new pieces, given their ids one after the other."""
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n_pieces + len(sizes) > len(self.size):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
        places = np.arange(self.n_pieces, self.n_pieces + len(sizes))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.size[places] = sizes
        self.start[places] = self.n_ids + np.cumsum(sizes) - sizes
        self.n_ids += len(ids)
        self.n_pieces += len(sizes)
        return places

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces; their places in the table."""
        texts = [p.decode("utf-8") for p in pieces]
        if self.widths is not None:  # ids end where their bytes do, so the library need not follow the pieces
            begin = [i for i, p in enumerate(pieces) if not i or not _joins(pieces[i - 1], p)] + [len(pieces)]
            texts_joined = ["".join(texts[a:b]) for a, b in zip(begin, begin[1:])]
            ids = np.array(self.library.encode_batch_fast([texts_joined], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            ends, wanted = np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in pieces])
            upto = np.searchsorted(ends, wanted, "right")
            if np.array_equal(np.concatenate([[0], ends])[upto], wanted) and upto[-1] == len(ids):
                return self._keep(ids, np.diff(upto, prepend=0))
        coded = self.library.encode(texts, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, np.uint32)
        sizes = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(pieces)) if len(ids) else np.zeros(len(pieces), np.int64)
        return self._keep(ids, sizes)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start."""
        if not len(data):
            return np.zeros(0, np.int64)
        if self.rule is None:
            return np.unique(offsets[:-1][offsets[:-1] < len(data)])
        cut = self.rule(data, offsets)
        odd = _odd_rows(data, offsets)
        if len(odd):
            row = np.searchsorted(offsets, cut, "right") - 1
            cut = cut[~np.isin(row, odd) | np.isin(cut, offsets[odd])]
        return cut

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        """Code of each piece, the distinct pieces, pieces before each row, and the rows' byte offsets."""
        data, offsets = flat(column)
        cut = self.cuts(data, offsets)
        coded = pieces_array(data, np.append(cut, len(data))).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        return codes, coded.dictionary, np.searchsorted(cut, offsets), offsets

    def places(self, distinct: pa.Array | list[bytes]) -> np.ndarray:
        """Where the ids of each of some distinct pieces are, until the next call."""
        if not isinstance(distinct, pa.Array):
            distinct = pa.array(distinct, pa.large_binary())
        if max(len(self.table), self.n_pieces // 2, self.n_ids // 16) > CACHE_PIECES:
            self._drop()
        row = pc.fill_null(pc.index_in(distinct, value_set=self.table), -1).to_numpy(zero_copy_only=False)
        met = row[row >= 0]
        self.again[met] = True
        found = np.full(len(row), -1, np.int64)
        found[row >= 0] = self.at[met]
        missing = np.flatnonzero(row < 0)
        if len(missing):
            new = distinct.take(pa.array(missing))
            for first in range(0, len(missing), ADDED_PIECES):
                found[missing[first : first + ADDED_PIECES]] = self._add(new.slice(first, ADDED_PIECES).to_pylist())
            short = pc.less_equal(pc.binary_length(new), KEPT_BYTES)
            self.table = pa.concat_arrays([self.table, new.filter(short)])
            self.at = np.concatenate([self.at, found[missing[short.to_numpy(zero_copy_only=False)]]])
            self.again = np.concatenate([self.again, np.zeros(len(self.at) - len(self.again), bool)])
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows in one array, and the rows' n + 1 offsets in it."""
        codes, distinct, rows, _ = self.pieces(column)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
        places = self.places(distinct)
        each = self.size[places]
        ids = self.ids[spread(self.start[places], each)]  # of the distinct pieces side by side, small enough to be read at random
        sizes = each.astype(np.int32)[codes]
        return ids[spread((np.cumsum(each) - each)[codes], sizes)], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[rows]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(start) or int(start.max()) < 1 << 31) else np.int64
    return np.repeat((start - (ends - size)).astype(kind), size) + np.arange(total, dtype=kind)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
