"""Vectorised text kernels for Arrow batches: words, shingles and hashes straight from UTF-8 bytes.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), so byte
positions never split a code point. A word's 64-bit hash mixes its bytes in blocks of eight, each
step a bijection of the state, and is BLAKE2b for very long words; it stands for the word in
signatures and features. Where a decision rests on equal shingles, ``exact_sets`` numbers them by
their words, without any hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES, LONG_WORD = 1 << 21, 1 << 12
_U = np.uint64


#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.random.default_rng(7).integers(1, 1 << 63, 16, dtype=np.uint64) | _U(1)


def steps(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what is made of a batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together; a longer text is a run of its own."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def segments(raw: np.ndarray, most: int = SLICE_BYTES, *, gap: np.ndarray = IS_SPACE) -> Iterator[tuple[int, int]]:
    """Cuts of one text, each at a byte of ``gap``, so that what is made of a part stays small whatever the
    text's length; a word longer than ``most`` is not cut."""
    at = 0
    while at < len(raw):
        to, step = at + most, 1 << 16
        while to < len(raw):
            found = np.flatnonzero(gap[raw[to : to + step]])
            if len(found):
                to += int(found[0])
                break
            to += step
        to = min(to, len(raw))
        yield at, to
        at = to


def spans(raw: np.ndarray, off: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the range of its words; ``gap`` marks the bytes in no word."""
    n = len(raw)
    space = gap[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    solid = ~space
    begin, end = edge[:-1].copy(), edge[1:].copy()
    begin[1:] |= space[:-1]
    end[:-1] |= space[1:]
    starts = np.flatnonzero(begin & solid)
    ends = np.flatnonzero(end & solid) + 1
    return starts, ends, np.searchsorted(starts, off)


def gathered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of ascending spans that don't overlap, one after another."""
    sizes = ends - starts
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    if off[-1] != len(raw):
        mark = np.zeros(len(raw) + 1, np.int8)
        full = sizes > 0
        mark[starts[full]] += 1
        mark[ends[full]] -= 1
        raw = raw[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw))])


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def eights(raw: np.ndarray, padded: bool = False) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros past the end; ``padded``: seven bytes more are there."""
    held = raw if padded else np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(held) - 7,), "<u8", held.data, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes have equal hashes."""
    sizes, view = ends - starts, eights(raw)
    out = mix(sizes.astype(np.uint64) * _STEP[0] + _STEP[1])
    long = sizes > LONG_WORD
    for i in np.flatnonzero(long).tolist():
        out[i] = int.from_bytes(blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    live, at = np.flatnonzero(~long & (sizes > 0)), 0
    while len(live):
        left = sizes[live] - at
        block = view[starts[live] + at] & _MASK[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ block) * _STEP[2] + _STEP[3])
        live, at = live[left > 8], at + 8
    return out


def same_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether spans of ``raw`` have the bytes of those of ``other``, which end eight bytes before it does, one by one."""
    sizes = ends - starts
    same = sizes == to - from_
    long = sizes > LONG_WORD
    for i in np.flatnonzero(same & long).tolist():
        same[i] = np.array_equal(raw[starts[i] : ends[i]], other[from_[i] : to[i]])
    mine, its = eights(raw), eights(other, True)
    live, at = np.flatnonzero(same & ~long & (sizes > 0)), 0
    while len(live):
        left = sizes[live] - at
        equal = ((mine[starts[live] + at] ^ its[from_[live] + at]) & _MASK[np.minimum(left, 8)]) == 0
        same[live[~equal]] = False
        live, at = live[equal & (left > 8)], at + 8
    return same


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and sizes of all words, A-Z lowered, and for each text the range of its words."""
    if len(off) == 2 and len(raw) > SLICE_BYTES:
        parts = [_words(raw[a:b], np.array([0, b - a])) for a, b in segments(raw)]
        hashes, sizes = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return hashes, sizes, np.array([0, len(hashes)])
    return _words(raw, off)


def _words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, bounds = spans(raw, off)
    return span_hashes(FOLD[raw], starts, ends), (ends - starts).astype(np.int32), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words per text; a text of fewer words is one run, an empty one none."""
    n = np.diff(bounds)
    short = n < k
    sizes = np.where(short, n > 0, n - k + 1)
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(out_bounds[-1], np.uint64)
    whole = len(words) - k + 1
    if whole > 0:
        runs = words[:whole] * _STEP[0]
        for j in range(1, k):
            runs += words[j : whole + j] * _STEP[j]
        inside = np.ones(len(words), bool)
        for j in range(1, k):
            at = bounds[1:] - j
            inside[at[at >= 0]] = False
        out[np.repeat(~short, sizes)] = runs[inside[:whole]]
    few = np.flatnonzero(short & (n > 0))
    if len(few):
        part = n[few].astype(np.uint64) * _STEP[15]
        for j in range(k - 1):
            more = n[few] > j
            part[more] += words[bounds[few][more] + j] * _STEP[j]
        out[out_bounds[few]] = part
    return mix(out), out_bounds


def text_shingles(column: pa.Array, k: int = 5) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first, last, shingle hashes and their bounds."""
    raw, off = buffers(column)
    for a, b in slices(off):
        words, _, bounds = word_hashes(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        yield (a, b, *shingles(words, bounds, k))


def sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(h[bounds[i] : bounds[i + 1]]) for a, b, h, bounds in text_shingles(column, k) for i in range(b - a)]


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word of all texts, A-Z lowered, equal for equal words only, and the texts' ranges of words."""
    raw, off = buffers(column)
    parts, words, counts = [], [], []
    for a, b in slices(off):
        rel = off[a : b + 1] - off[a]
        cuts = segments(raw[off[a] : off[b]]) if b == a + 1 else [(0, rel[-1])]
        found = np.zeros(b - a, np.int64)
        for x, y in cuts:
            part = raw[off[a] + x : off[a] + y]
            starts, ends, bounds = spans(part, rel if b > a + 1 else np.array([0, y - x]))
            told = gathered(FOLD[part], starts, ends).dictionary_encode()
            parts.append(told.indices.to_numpy(zero_copy_only=False))
            words.append(told.dictionary)
            found += np.diff(bounds)
        counts.append(found)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    whole = pa.concat_arrays(words).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum([0, *(len(w) for w in words)])
    numbers = np.concatenate([whole[at[i] : at[i + 1]][p] for i, p in enumerate(parts)])
    return numbers, np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def exact_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Sorted numbers of each text's distinct shingles; within one call, equal numbers mean equal words."""
    words, bounds = word_numbers(column)
    runs, top = words, int(words.max()) + 1 if len(words) else 1
    for j in range(1, k):
        runs = runs[: max(len(words) - j, 0)] * top + words[j:]
        runs = np.unique(runs, return_inverse=True)[1].astype(np.int64) if len(runs) else runs
    few: dict[tuple, int] = {}
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(np.array([few.setdefault(tuple(words[a:b].tolist()), len(words) + len(few))][: b - a], np.int64))
    return out


class Permutations:
    """Universal hashes x -> (a*x + b mod 2**64) >> 32; a signature holds the least value under each."""

    def __init__(self, count: int, seed: int = 1) -> None:
        draw = np.random.default_rng(seed).integers(1, 1 << 63, (2, count), dtype=np.uint64)
        self.a, self.b = draw[0] * _U(2) + _U(1), draw[1] * _U(2)
        self.count = count

    def signatures(self, values: np.ndarray, bounds: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """uint32 (texts, count); texts without shingles get all ones."""
        n = len(bounds) - 1
        out = np.full((n, self.count), 0xFFFFFFFF, np.uint32)
        full = np.flatnonzero(np.diff(bounds) > 0)
        at = 0
        while at < len(full):
            to = max(at + 1, int(np.searchsorted(bounds[full], bounds[full[at]] + block, "right")) - 1)
            to = min(to, len(full))
            rows = full[at:to]
            lo, hi = bounds[rows[0]], bounds[rows[-1] + 1]
            x, starts = values[lo:hi], bounds[rows] - lo
            buf = np.empty_like(x)
            for k in range(self.count):
                np.multiply(x, self.a[k], out=buf)
                np.add(buf, self.b[k], out=buf)
                np.right_shift(buf, _U(32), out=buf)
                out[rows, k] = np.minimum.reduceat(buf, starts)
            at = to
        return out
