"""What is learned in one worker: gradient boosting of a group's cells on 0/1 features, and the steps of the covariate model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


#: Cells whose features are held as doubles at once, and numbers to which the letters of some places are put together.
BLOCK, NUMBERS = 1 << 14, 1 << 12


def letters_of(texts) -> np.ndarray:
    """Bytes by text and place of an Arrow column of texts of one length."""
    import pyarrow as pa

    column = texts.cast(pa.large_binary()).combine_chunks()
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return flat.reshape(len(column), -1 if len(flat) else 0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def boosted(x: np.ndarray, n: np.ndarray, y: np.ndarray, classify: bool, count: int = 100, depth: int = 3, step: float = 0.1) -> np.ndarray:
    """``grown`` on features ``x``, 0/1, which may be bytes."""

    def sums(node: np.ndarray, nodes: int, weights: tuple) -> list:
        member, out = node[:, None] == np.arange(nodes), [0.0] * len(weights)
        for i in range(0, len(x), BLOCK):
            part, some = x[i : i + BLOCK].T.astype(float), slice(i, i + BLOCK)
            out = [s + part @ (member[some] * w[some, None]) for s, w in zip(out, weights)]
        return out

    return grown(n, y, classify, sums, lambda f: x[:, f].astype(bool), count, depth, step)


def boosted_texts(texts: np.ndarray, letters: str, n: np.ndarray, y: np.ndarray, classify: bool, count: int = 100, depth: int = 3, step: float = 0.1) -> np.ndarray:
    """``grown`` on the letters of texts of one length, bytes by cell and place. Places are counted some at a time, by one number for all their
    letters, and a feature's sum is that of the numbers with its letter: a few passes a level instead of one a feature."""
    base, many = len(letters) + 1, 1
    while base ** (many + 1) <= NUMBERS:
        many += 1
    place = np.ascontiguousarray(texts.T)
    digit = np.full(256, len(letters), np.uint16)
    digit[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    numbers = []
    for i in range(0, len(place), many):
        number = np.zeros(len(texts), np.uint16)
        for one in place[i : i + many]:
            number = number * np.uint16(base) + digit[one]
        numbers.append((number, len(place[i : i + many])))

    def sums(node: np.ndarray, nodes: int, weights: tuple) -> list:
        out = [[] for _ in weights]
        for number, places in numbers:
            at = node * np.intp(base**places) + number
            for found, w in zip(out, weights):
                whole = np.bincount(at, w, nodes * base**places).reshape(nodes, *[base] * places)
                found += [whole.sum(tuple(a for a in range(1, places + 1) if a != i + 1))[:, :-1].T for i in range(places)]
        return [np.concatenate([*found, np.zeros((0, nodes))]) for found in out]

    return grown(n, y, classify, sums, lambda f: place[f // len(letters)] == ord(letters[f % len(letters)]), count, depth, step)


def grown(n: np.ndarray, y: np.ndarray, classify: bool, sums: Callable, has: Callable, count: int = 100, depth: int = 3, step: float = 0.1) -> np.ndarray:
    """Scores of all cells, fitted on the ``n`` training rows and their sum ``y`` of targets of each: squared error or log
    loss, splits by Friedman's gain, the first feature among those within a billionth of the best, leaves the mean
    residual or one Newton step. ``sums`` adds up weights by feature and node, ``has`` tells the cells with a feature."""
    mean = y.sum() / n.sum()
    if classify and mean in (0, 1):
        return np.full(len(n), mean)
    score = np.full(len(n), np.log(mean / (1 - mean)) if classify else mean)
    for _ in range(count):
        p = sigmoid(score) if classify else score
        residual = y - n * p
        node = np.zeros(len(n), np.int8)
        for level in range(depth):
            all_n, all_s = (np.bincount(node, w, 2**level) for w in (n, residual))
            n1, s1 = sums(node, 2**level, (n, residual))
            n0, s0 = all_n - n1, all_s - s1
            split = (n1 > 0) & (n0 > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(split, n1 * n0 / all_n * (s1 / n1 - s0 / n0) ** 2, 0.0)
            most = gain.max(0, initial=0.0)
            side = np.zeros(len(n), bool)
            for j in np.flatnonzero(most > 1e-15):
                side |= (node == j) & has((gain[:, j] >= most[j] * (1 - 1e-9)).argmax())
            node = 2 * node + side
        top = np.bincount(node, residual, 2**depth)
        base = np.bincount(node, n * p * (1 - p) if classify else n, 2**depth)
        score = score + step * np.divide(top, base, out=np.zeros_like(top), where=base > 1e-150)[node]
    return sigmoid(score) if classify else score


def added(sums) -> np.ndarray:
    """The sum of arrays in an order of their own, so that it doesn't depend on how the rows were partitioned."""
    return np.sum(sorted((np.asarray(s) for s in sums), key=lambda s: tuple(s[:3])), axis=0)


def system(sums: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, slopes and matrix out of one array of f * f + f + 1 numbers."""
    f = int((np.sqrt(4 * len(sums) - 3) - 1) / 2)
    return sums[0], sums[1 : f + 1], sums[f + 1 :].reshape(f, f)


def encoded(texts, letters: str = "ACGT", kind: type = float) -> np.ndarray:
    """0/1 for each place and letter of texts of one length, as doubles or, an eighth as large, as bytes."""
    codes = np.frombuffer("".join(texts).encode(), dtype=np.uint8).reshape(len(texts), -1)
    return (codes[:, :, None] == np.frombuffer(letters.encode(), dtype=np.uint8)).reshape(len(codes), -1).astype(kind, copy=kind is float)


def cell_steps(cells, state, kinds: list[str], before: int, sizes: list[float]):
    """The state (seed, kind, key, p, m, v) after Adam steps over cells (keys, n and value), ``before`` of which were taken earlier."""
    import pandas as pd

    # In an order of their own: sums, and so rows out, do not depend on how the cells were partitioned.
    cells = cells.sort_values([f"key_{k}" for k in kinds], ignore_index=True)
    at, names, p, m, v = {}, {}, {}, {}, {}
    for k in kinds:
        own = state[state["kind"] == k].set_index("key").sort_index()
        names[k] = own.index
        at[k] = own.index.get_indexer(cells[f"key_{k}"])
        p[k], m[k], v[k] = (own[c].to_numpy() for c in ("p", "m", "v"))
    value, n = cells["value"].to_numpy(), cells["n"].to_numpy(dtype=float)
    for step, size in enumerate(sizes, before + 1):
        a, e, b, g = (p[k][at[k]] for k in kinds)
        error = 2.0 * n * (a**2 * e**2 + b**2 + g**2 - value) / n.sum()
        for k, s in zip(kinds, (2 * a * e**2, 2 * e * a**2, 2 * b, 2 * g)):
            slope = np.bincount(at[k], error * s, len(p[k]))
            m[k] = 0.9 * m[k] + 0.1 * slope
            v[k] = 0.999 * v[k] + 0.001 * slope**2
            p[k] = p[k] - size * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    seed = state["seed"].iloc[0]
    return pd.concat([pd.DataFrame({"seed": seed, "kind": k, "key": names[k], "p": p[k], "m": m[k], "v": v[k]}) for k in kinds])
