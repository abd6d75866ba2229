"""Token ids for Arrow batches, by a tokenizer of the ``tokenizers`` library whose file is a parameter.

Texts are cut into pieces at places no token can span, each distinct piece is encoded once while it
stays in a bounded per-worker store, and ids are gathered back in order. A piece is found by its hash and
counts as found only if its bytes are those stored. The cut places rest on the split patterns of the public byte-level and word-end
vocabularies: a new run of ASCII white space after a letter or an ASCII mark, and an ASCII mark other
than an apostrophe after a letter. A tokenizer of another kind (``cuts`` tells by its pre-tokenizer)
encodes whole texts, and so are texts encoded that hold the string of an added token, A-Z in either case: the
library gives such a string one id, unless ``ordinary`` is asked for. The ids equal those of encoding the whole
text at once, which the tests check.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from editloom.llm.text import FOLD, IS_SPACE, buffers, same_spans, slices, span_hashes

STORE_PIECES, STORE_BYTES, SLOTS, RUN_PIECES = 1 << 20, 1 << 26, 1 << 21, 1 << 17
_encoders: dict[tuple[str, bool], PieceEncoder] = {}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True


def tokenizer(path: str, ordinary: bool = False):
    """The tokenizer of a file; with ``ordinary``, strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    if ordinary:
        found.encode_special_tokens = True
    return found


def encoder(path: str, ordinary: bool = False) -> PieceEncoder:
    """One encoder a worker, file and way."""
    if (path, ordinary) not in _encoders:
        _encoders[path, ordinary] = PieceEncoder(path, ordinary)
    return _encoders[path, ordinary]


def cuts(told: dict) -> bool:
    """Whether the tokenizer splits words as the two public vocabularies do, so that texts may be cut."""
    split = json.dumps(told["pre_tokenizer"] or {})
    return "'s|'t|'re|'ve|'m|'ll|'d" in split or ('"ByteLevel"' in split and '"use_regex": true' in split and '"add_prefix_space": false' in split)


def _piece_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pieces begin. White space leads the piece that follows it."""
    n = len(raw)
    begin = np.zeros(n, bool)
    space = IS_SPACE[raw]
    letter = _LETTER[raw]
    # é and its like: lead byte C3, but not the signs U+00D7 and U+00F7
    letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    solid = letter | ((raw < 0x80) & ~space)
    begin[1:] = (space[1:] & solid[:-1]) | (_MARK[raw[1:]] & letter[:-1])
    begin[off[:-1][off[:-1] < n]] = True
    return np.flatnonzero(begin)


def _places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64), (hashes >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)


class PieceEncoder:
    """A table from piece hashes, at two places each, to rows of a ragged store of pieces and ids, of bounded size.

    For a vocabulary that lowers case and drops white space, ASCII pieces that differ in A-Z and pieces that differ
    in the white space before them share a row. Other pieces keep their case: normal forms may compose a capital
    and a mark otherwise than the small letter and that mark."""

    def __init__(self, path: str, ordinary: bool = False) -> None:
        self.tokenizer = tokenizer(path, ordinary)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        told = json.loads(self.tokenizer.to_str())
        self.cuts = cuts(told)
        self.fold = "Lowercase" in json.dumps(told["normalizer"]) and "Removed" in json.dumps(told["pre_tokenizer"])
        self.added = [] if ordinary else [t["content"].encode().lower() for t in told["added_tokens"]]
        self._clear()

    def _lists(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]

    def _starts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        return _piece_starts(raw, off)

    def _clear(self) -> None:
        self.keys, self.rows = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.at, self.sizes = np.zeros(STORE_PIECES, np.int64), np.zeros(STORE_PIECES, np.int32)
        self.flat, self.used = np.zeros(1 << 20, self.dtype), 0
        self.begin, self.end = np.zeros(STORE_PIECES, np.int64), np.zeros(STORE_PIECES, np.int64)
        self.text, self.pieces, self.filled = np.zeros(1 << 20, np.uint8), 0, 0

    def _add(self, pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces into the store; their rows."""
        lists = self._lists(pieces)
        sizes, lengths = np.array([len(x) for x in lists], np.int64), np.array([len(p) for p in pieces], np.int64)
        flat, text = np.array([i for x in lists for i in x], self.dtype), np.frombuffer(b"".join(pieces), np.uint8)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), self.dtype)])
        while self.filled + len(text) + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(len(self.text), np.uint8)])
        rows = np.arange(self.pieces, self.pieces + len(pieces))
        self.flat[self.used : self.used + len(flat)] = flat
        self.text[self.filled : self.filled + len(text)] = text
        self.at[rows], self.sizes[rows] = self.used + np.cumsum(sizes) - sizes, sizes
        self.end[rows] = self.filled + np.cumsum(lengths)
        self.begin[rows] = self.end[rows] - lengths
        self.pieces, self.used, self.filled = self.pieces + len(pieces), self.used + len(flat), self.filled + len(text)
        return rows

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        if not self.cuts:
            return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast([t or "" for t in column.to_pylist()], add_special_tokens=False)]
        raw, off = buffers(column)
        out: list[np.ndarray] = []
        for a, b in slices(off):
            part, rel = raw[off[a] : off[b]], off[a : b + 1] - off[a]
            found = self._slice(part, rel)
            for i in self._marked(part, rel):
                found[i] = np.array(self._lists([part[rel[i] : rel[i + 1]].tobytes()])[0], self.dtype)
            out += found
        return out

    def _marked(self, raw: np.ndarray, off: np.ndarray) -> list[int]:
        """Texts that hold the string of an added token."""
        low, found = raw.tobytes().lower() if self.added else b"", set()
        for mark in self.added:
            at = low.find(mark)
            while at >= 0:
                i = int(np.searchsorted(off, at, "right")) - 1
                found.add(i)
                at = low.find(mark, int(off[i + 1]))
        return sorted(found)

    def _slice(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        starts = self._starts(raw, off)
        if not len(starts):
            return [np.zeros(0, self.dtype)] * (len(off) - 1)
        ids, sizes = [], []
        for at in range(0, len(starts), RUN_PIECES):  # more than one run in a very long text
            run = starts[at : at + RUN_PIECES]
            lo, hi = run[0], starts[at + RUN_PIECES] if at + RUN_PIECES < len(starts) else len(raw)
            got = self._ids(raw[lo:hi], run - lo)
            ids.append(got[0])
            sizes.append(got[1])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        flat, at = np.concatenate(ids), ends[np.searchsorted(starts, off)]
        return [flat[x:y] for x, y in zip(at[:-1], at[1:])]

    def _ids(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.append(starts[1:], len(raw))
        if self.fold:
            solid, wide = np.append(np.flatnonzero(~IS_SPACE[raw]), len(raw)), np.concatenate([[0], np.cumsum(raw >= 0x80)])
            kept = np.repeat(wide[ends] > wide[starts], ends - starts)
            starts, raw = np.minimum(solid[np.searchsorted(solid, starts)], ends), np.where(kept, raw, FOLD[raw])
        if self.pieces + 2 * len(starts) > STORE_PIECES or self.filled > STORE_BYTES:
            self._clear()
        hashes = span_hashes(raw, starts, ends)
        one, two = _places(hashes)
        rows = np.where(self.keys[one] == hashes, self.rows[one], np.where(self.keys[two] == hashes, self.rows[two], -1)).astype(np.int64)
        cut = lambda where: [raw[s:e].tobytes() for s, e in zip(starts[where].tolist(), ends[where].tolist())]
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            added = self._add(cut(missing[first]))
            rows[missing] = added[back]
            one, two = _places(new)
            slots = np.where((self.rows[one] >= 0) & (self.rows[two] < 0), two, one)
            self.keys[slots], self.rows[slots] = new, added
        # Pieces whose bytes are not those of the row with their hash get rows of their own.
        other = np.flatnonzero(~same_spans(raw, starts, ends, self.text, self.begin[rows], self.end[rows]))
        if len(other):
            rows[other] = self._add(cut(other))
        sizes = self.sizes[rows].astype(np.int64)
        total = np.cumsum(sizes)
        if not len(total) or not total[-1]:
            return np.zeros(0, self.dtype), sizes
        index = np.repeat(self.at[rows] - (total - sizes), sizes) + np.arange(total[-1])
        return self.flat[index], sizes
