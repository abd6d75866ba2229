"""Text features for the classifiers, from bytes of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from editloom.llm.text import FOLD, buffers, mix, shingles, slices, span_hashes, spans

#: Marks whose share of words is a feature of its own.
MARKS = "#$%&*|!?.,;:@=_/<>{}[]()\"'-"
DENSE = [*(f"mark {m}" for m in MARKS), "upper", "digit", "high", "word length", "words", "same word", "pairs", "triples", "runs", "short lines", "lines"]
_CLASS = np.full(256, 0, np.uint8)
for _i, _m in enumerate(MARKS, 1):
    _CLASS[ord(_m)] = _i
_UPPER, _DIGIT, _HIGH = len(MARKS) + 1, len(MARKS) + 2, len(MARKS) + 3
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[0x80:] = _HIGH
_LETTERS = np.zeros(256, bool)
_LETTERS[ord("a") : ord("z") + 1] = _LETTERS[ord("A") : ord("Z") + 1] = True
_LETTERS[0x80:] = True
PREFIXES = (4, 5, 6)


def _distinct_share(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """1 - distinct / all, per text."""
    out = np.zeros(len(bounds) - 1)
    for i in range(len(out)):
        part = values[bounds[i] : bounds[i + 1]]
        if len(part):
            out[i] = 1 - len(np.unique(part)) / len(part)
    return out


def dense(column: pa.Array) -> np.ndarray:
    """float64 (texts, len(DENSE)): shares of marks and letters, sizes, and repetition; zeros for an empty text."""
    raw, off = buffers(column)
    rows = []
    for a, b in slices(off):
        part, rel = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        n = b - a
        starts, ends, bounds = spans(part, rel)
        count = np.diff(bounds)
        words = np.maximum(count, 1)
        hashes = span_hashes(FOLD[part], starts, ends)
        doc = np.repeat(np.arange(n), np.diff(rel))
        kinds = np.bincount(doc * 64 + _CLASS[part], minlength=n * 64).reshape(n, 64).astype(float)
        size = np.maximum(np.diff(rel), 1)
        owner = np.repeat(np.arange(n), count)
        same = np.zeros(len(hashes), bool)
        if len(hashes) > 1:
            same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        lines = np.bincount(doc[part == 10], minlength=n) + 1
        out = np.zeros((n, len(DENSE)))
        out[:, : len(MARKS)] = kinds[:, 1 : len(MARKS) + 1] / words[:, None]
        at = len(MARKS)
        out[:, at] = kinds[:, _UPPER] / size
        out[:, at + 1] = kinds[:, _DIGIT] / size
        out[:, at + 2] = kinds[:, _HIGH] / size
        out[:, at + 3] = (np.bincount(owner, weights=ends - starts, minlength=n) if len(owner) else 0) / words
        out[:, at + 4] = np.log1p(count)
        out[:, at + 5] = (np.bincount(owner[same], minlength=n)) / words
        for j, k in ((6, 2), (7, 3)):
            out[:, at + j] = _distinct_share(*shingles(hashes, bounds, k))
        run = np.zeros(len(hashes), bool)
        if len(hashes) > 2:
            run[2:] = same[2:] & same[1:-1]
        out[:, at + 8] = np.bincount(owner[run], minlength=n) / words
        out[:, at + 9] = lines / words
        out[:, at + 10] = np.log1p(lines)
        out[count == 0] = 0
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, len(DENSE)))


def word_marks(column: pa.Array) -> list[np.ndarray]:
    """Per text, the sorted distinct marks of its words of letters (A-Z lowered) and of their first bytes."""
    raw, off = buffers(column)
    out: list[np.ndarray] = []
    for a, b in slices(off):
        part, rel = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        if not len(part):
            out += [np.zeros(0, np.uint64)] * (b - a)
            continue
        solid = _LETTERS[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[rel] = True
        begin, end = edge[:-1].copy(), edge[1:].copy()
        begin[1:] |= ~solid[:-1]
        end[:-1] |= ~solid[1:]
        starts, ends = np.flatnonzero(begin & solid), np.flatnonzero(end & solid) + 1
        folded, owner = FOLD[part], np.searchsorted(rel, starts, "right") - 1
        marks, owners = [span_hashes(folded, starts, ends)], [owner]
        for k in PREFIXES:
            long = ends - starts > k
            marks.append(mix(span_hashes(folded, starts[long], starts[long] + k) + np.uint64(k)))
            owners.append(owner[long])
        mark, who = np.concatenate(marks), np.concatenate(owners)
        order = np.argsort(who, kind="stable")
        mark, bounds = mark[order], np.searchsorted(who[order], np.arange(b - a + 1))
        out += [np.unique(mark[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
    return out
