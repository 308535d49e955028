"""Word shingles as 64-bit hashes, and min-max signatures of their sets."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A to Z in lower case."""
    return text.encode().translate(_LOWER).split() if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def hashed(own: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), dtype=np.uint64, count=len(own))


def sets_of(h: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of ``size`` words of each range [first, last) of hashed words.

    The sets lie one after another; returns their items and their starts. No range is empty;
    one of fewer words than ``size`` is one shingle, the whole sequence.
    """
    n = len(first)
    many = np.maximum(last - first - size + 1, 1)
    ends = np.cumsum(many)
    items = np.empty(int(ends[-1]) if n else 0, dtype=np.uint64)
    whole = last - first >= size
    total = np.empty(0, dtype=np.uint64)
    if whole.any():
        total = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            total = _mixed(total * _A + h[i : len(h) - size + 1 + i])
    owner = np.repeat(np.arange(n), many)
    for a, b, w, to, m in zip(first.tolist(), last.tolist(), whole.tolist(), ends.tolist(), many.tolist(), strict=True):
        if w:
            part = items[to - m : to]
            part[:] = total[a : a + m]
            part.sort()
        else:
            x = np.array([b - a], dtype=np.uint64)
            for y in h[a:b]:
                x = _mixed(x * _A + y)
            items[to - 1] = x[0]
    keep = np.ones(len(items), dtype=bool)
    keep[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[keep], minlength=n)
    return items[keep], np.cumsum(counts) - counts


def set_keys(items: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128 bits that stand for each set."""
    view, to = memoryview(items.tobytes()), np.append(starts, len(items)) * 8
    return [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def parts(items: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The bytes of each set."""
    raw, to = items.tobytes(), np.append(starts, len(items)) * 8
    return [raw[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


class MinMax:
    """Both ends of a set under random permutations: two values from one evaluation.

    A band joins ``rows`` of the values, least and greatest hash of a permutation by turns,
    so two sets of similarity J agree in a band with a chance of about J to that power.
    """

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        n = -(-bands * rows // 2)
        self.a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, n, dtype=np.uint64)

    def signed(self, items: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket keys (one signed 64-bit number a band) and signatures (one byte a value) of sets.

        The sets lie one after another in ``items``, none is empty; ``starts`` has their places.
        """
        n, used = len(starts), self.bands * self.rows
        values = np.empty((len(self.a) * 2, n), dtype=np.uint64)
        if n:
            for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
                v = items * a
                v += b
                values[2 * i] = np.minimum.reduceat(v, starts)
                values[2 * i + 1] = np.maximum.reduceat(v, starts)
        keys = np.empty((n, self.bands), dtype=np.int64)
        for band in range(self.bands):
            k = np.full(n, band + 1, dtype=np.uint64) * _C
            for r in range(self.rows):
                k = _mixed(k * _A + values[band * self.rows + r])
            keys[:, band] = k.view(np.int64)
        return keys, np.ascontiguousarray((_mixed(values[:used]) & np.uint64(255)).astype(np.uint8).T)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
