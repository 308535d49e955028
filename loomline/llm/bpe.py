"""Byte-pair merging of many words at a time.

:class:`Merger` reads a ``tokenizer.json`` of the tokenizers library whose model is
a byte-level BPE and merges whole lists of pre-tokens with numpy. Words of one
present length form a matrix; a round merges, in every row, the leftmost pair of the
lowest rank, so that each row moves to the matrix of the next smaller length. That
is the library's own order of merges.
"""

from __future__ import annotations

import functools
import json

import numpy as np
from tokenizers import Tokenizer

_NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class PairTable:
    """64-bit keys to their index in numpy, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        for i, (k, s) in enumerate(zip(keys.tolist(), self._slots(keys).tolist(), strict=True)):
            while self.values[s] != _NONE and self.keys[s] != k:
                s = (s + 1) & self.mask
            if self.values[s] == _NONE:
                self.keys[s], self.values[s] = k, i

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or the largest 32-bit number."""
        slots = self._slots(keys)
        found, out = self.keys[slots] == keys, self.values[slots]
        open_ = np.flatnonzero(~found & (out != _NONE))
        out = np.where(found, out, _NONE)
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & self.mask
            hit = self.keys[slots] == keys[open_]
            out[open_[hit]] = self.values[slots[hit]]
            more = ~hit & (self.values[slots] != _NONE)
            open_, slots = open_[more], slots[more]
        return out


class Merger:
    """The merges of one vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.first = np.array([vocab[c] for c in byte_letters()], dtype=np.int32)
        self.last = np.array([vocab[c + end] for c in byte_letters()], dtype=np.int32)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.uint64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        self.table = PairTable((left << np.uint64(32)) | right)
        self.size = max(vocab.values()) + 1
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        return self.table.find(keys.ravel()).reshape(keys.shape)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's begin (one more than words).

        An empty word has no ids.
        """
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.first[blob]
        full = np.flatnonzero(lengths)
        symbols[ends[full] - 1] = self.last[blob[ends[full] - 1]]
        starts = ends - lengths
        order = np.argsort(lengths, kind="stable")
        at = np.searchsorted(lengths[order], np.arange(int(lengths.max(initial=0)) + 2))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rows = np.empty(0, dtype=np.int64)
        held = ranks = None
        for n in range(int(lengths.max(initial=0)), 0, -1):
            fresh = order[at[n] : at[n + 1]]
            grid = symbols[starts[fresh][:, None] + np.arange(n)]
            if n == 1:
                done.append((fresh, grid))
                if len(rows):
                    done.append((rows, held))
                break
            new = self._ranks(grid[:, :-1], grid[:, 1:])
            if len(rows):
                rows, held, ranks = np.concatenate([rows, fresh]), np.concatenate([held, grid]), np.concatenate([ranks, new])
            else:
                rows, held, ranks = fresh, grid, new
            if not len(rows):
                continue
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            over = rank == _NONE
            if over.any():
                done.append((rows[over], held[over]))
                keep = ~over
                rows, held, ranks, best, rank = rows[keep], held[keep], ranks[keep], best[keep], rank[keep]
            k = len(rows)
            if not k:
                continue
            line = np.arange(k)
            held[line, best] = self.made[rank]
            stay = np.ones((k, n), dtype=bool)
            stay[line, best + 1] = False
            held = held[stay].reshape(k, n - 1)
            stay = np.ones((k, n - 1), dtype=bool)
            stay[line, best] = False
            ranks = ranks[stay].reshape(k, n - 2)
            if n > 2:
                before = np.flatnonzero(best > 0)
                j = best[before]
                ranks[before, j - 1] = self._ranks(held[before, j - 1], held[before, j])
                after = np.flatnonzero(best < n - 2)
                j = best[after]
                ranks[after, j] = self._ranks(held[after, j], held[after, j + 1])
        sizes = np.zeros(len(words), dtype=np.int64)
        for r, grid in done:
            sizes[r] = grid.shape[1]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.empty(int(offsets[-1]), dtype=np.int32)
        for r, grid in done:
            flat[offsets[r][:, None] + np.arange(grid.shape[1])] = grid
        return flat, offsets


@functools.lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    """The merges of a vocabulary file, once for each process."""
    return Merger(path)


@functools.lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    """The library's tokenizer, without truncation and padding, once for each process."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def plain(piece: str) -> bool:
    """Whether all libraries agree on the letters, digits and lower case of ``piece``.

    True below U+0250 but for the dotted capital I, whose lower case is two characters.
    """
    return piece.isascii() or (max(piece) < "ɐ" and "İ" not in piece)


def all_plain(pieces: list[str]) -> bool:
    """Whether :func:`plain` surely holds for all pieces: none has a character above U+00FF."""
    try:
        "".join(pieces).encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
