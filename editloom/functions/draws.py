"""Draws by md5 for many short texts at once: what ``special.hash_int`` gives a row at a time, in numpy inside tasks."""

from __future__ import annotations

import hashlib
from math import floor, sin

import numpy as np

#: Fixed values of md5: shifts by round, sines, start.
SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
SINES = [floor(abs(sin(i + 1)) * 2**32) for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts held in a processor's cache, and the longest text that fits one block of md5.
CHUNK, LONGEST = 1 << 14, 55


def first_word(words: list, size: int) -> np.ndarray:
    """The first eight hexadecimal digits of md5, as numbers, from the 16 words of each of ``size`` texts; words are arrays or one number for all."""
    a, b, c, d = (np.full(size, x, np.uint32) for x in START)
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    for i in range(61):  # the last three steps leave the first word
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(b, f, out=f), np.bitwise_xor(d, f, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(d, f, out=f), np.bitwise_xor(c, f, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(b, f, out=f), np.bitwise_xor(c, f, out=f)
        np.add(f, a, out=f)
        if isinstance(words[g], np.ndarray):
            np.add(f, words[g], out=f), np.add(f, np.uint32(SINES[i]), out=f)
        else:
            np.add(f, np.uint32((SINES[i] + words[g]) % 2**32), out=f)
        shift = SHIFTS[i // 16][i % 4]
        np.left_shift(f, np.uint32(shift), out=t), np.right_shift(f, np.uint32(32 - shift), out=f)
        np.bitwise_or(f, t, out=f), np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(START[0])).byteswap()


class Draws:
    """Draws of texts that share a changing beginning: ``Draws(ends)(begin)`` are those of ``begin + end`` for each end."""

    def __init__(self, ends: list[bytes]) -> None:
        sizes = np.array([len(e) for e in ends])
        self.ends, self.kinds, self.held = ends, [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)], {}

    def _words(self, size: int, at: np.ndarray, offset: int) -> list[np.ndarray]:
        """The words that hold the ends, which begin ``offset`` bytes into the first, and md5's mark of the end."""
        if (size, offset) not in self.held:
            text = np.zeros((len(at), (offset + size + 4) // 4 * 4), np.uint8)
            text[:, offset : offset + size] = np.frombuffer(b"".join(self.ends[i] for i in at.tolist()), np.uint8).reshape(len(at), size)
            text[:, offset + size] = 0x80
            self.held[size, offset] = list(np.ascontiguousarray(text.view("<u4").T))
        return self.held[size, offset]

    def __call__(self, begin: bytes) -> np.ndarray:
        out = np.empty(len(self.ends), np.uint32)
        whole, offset = divmod(len(begin), 4)
        front = np.frombuffer(begin + b"\0" * (-len(begin) % 4), "<u4").tolist()
        for size, at in self.kinds:
            if len(begin) + size > LONGEST:
                out[at] = [int.from_bytes(hashlib.md5(begin + self.ends[i], usedforsecurity=False).digest()[:4], "big") for i in at.tolist()]
                continue
            words = self._words(size, at, offset)
            for i in range(0, len(at), CHUNK):
                block = [*front[:whole], *(w[i : i + CHUNK] for w in words)] + [0] * (16 - whole - len(words))
                if offset:
                    block[whole] = block[whole] | np.uint32(front[whole])
                block[14] = 8 * (len(begin) + size)
                out[at[i : i + CHUNK]] = first_word(block, len(at[i : i + CHUNK]))
        return out
