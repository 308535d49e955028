"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the whole corpus are compiled, with their ids, into an automaton
that shares prefixes and suffixes: adding the numbers along a word's path gives its
place among the sorted words, and so its ids. The file is handed to all executors,
which map it into memory and follow many words at a time. Every other word is merged
exactly. The result never depends on which words the lexicon holds.

A *word* is a run of bytes without ASCII white space: the tokenizer drops white space
before it merges, so words are encoded apart from each other. Texts are cut at ASCII
white space only; whatever else a word holds is left to the tokenizer's own rules.

Defined results: a null text counts as empty; an empty text has no ids and decodes to
an empty text; repeated rows are encoded each; an empty table gives an empty table;
columns besides the key and the text are ignored.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bpe
from loomline.llm.shared import gathered, put_file, ship

#: Words that the lexicon holds at most, distinct words that a task keeps while it counts.
LEXICON_WORDS, COUNTED_WORDS = 60_000, 150_000
#: Bytes of text that are worked on at a time; the longest word that the numpy merger takes.
TEXT_BYTES, LONGEST = 6 << 20, 200
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORDS = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")




def compile_lexicon(words: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> bytes:
    """The minimal automaton of distinct non-empty ``words`` with their ids, as a file.

    ``ids[offsets[i]:offsets[i + 1]]`` are the ids of ``words[i]``. States are merged
    while sorted words are added, so memory is that of the result.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict[tuple, int] = {}
    kept: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    counts: list[int] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(kept)
            kept.append(key)
            counts.append(int(key[0]) + sum(counts[t] for _, t in key[1]))
        return state

    path: list[list] = [[False, []]]  # final, edges that are frozen; the last edge of each is open
    last = b""
    for i in order:
        word = words[i]
        same = 0
        for a, b in zip(last, word, strict=False):
            if a != b:
                break
            same += 1
        for depth in range(len(last), same, -1):
            state = freeze(path.pop())
            path[-1][1].append((last[depth - 1], state))
        path.extend([False, []] for _ in range(len(word) - same))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        state = freeze(path.pop())
        path[-1][1].append((last[depth - 1], state))
    root = freeze(path[0])

    source, byte, target, output = [], [], [], []
    for state, (final, edges) in enumerate(kept):
        passed = int(final)
        for b, t in edges:
            source.append(state)
            byte.append(b)
            target.append(t)
            output.append(passed)
            passed += counts[t]
    keys = (np.array(source, dtype=np.uint64) << np.uint64(8)) | np.array(byte, dtype=np.uint64)
    bits = max(4, int(len(keys) * 3).bit_length())
    table = np.zeros(1 << bits, dtype=np.uint64)  # key + 1, 0 where free
    where = np.zeros(1 << bits, dtype=np.uint32)
    slots = ((keys * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
    for e, (k, s) in enumerate(zip(keys.tolist(), slots.tolist(), strict=True)):
        while table[s]:
            s = (s + 1) & ((1 << bits) - 1)
        table[s], where[s] = k + 1, e
    sizes = offsets[1:] - offsets[:-1]
    sizes = sizes[order] if len(order) else sizes
    flat = np.concatenate([ids[offsets[i] : offsets[i + 1]] for i in order]) if order else ids[:0]
    parts = [
        table, where, np.array(target, dtype=np.uint32), np.array(output, dtype=np.uint32),
        np.array([f for f, _ in kept], dtype=np.uint8),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32), flat.astype(np.uint32),
    ]
    head = struct.pack("<8sQQQ7Q", b"lexicon1", bits, root, max(map(len, words), default=0), *(p.nbytes for p in parts))
    out = head + b"\0" * (-len(head) % 8)
    for p in parts:
        out += p.tobytes() + b"\0" * (-p.nbytes % 8)
    return out


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        magic, self.bits, self.root, self.longest, *sizes = struct.unpack("<8sQQQ7Q", raw[: 8 * 11].tobytes())
        if magic != b"lexicon1":
            raise ValueError(f"{path} is no lexicon")
        at, parts = 88, []
        for n, kind in zip(sizes, ("u8", "u4", "u4", "u4", "u1", "u4", "u4"), strict=True):
            parts.append(raw[at : at + n].view(np.dtype(kind)))
            at += n + -n % 8
        self.table, self.where, self.target, self.output, self.final, self.offsets, self.ids = parts

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Place of each word among the sorted words of the lexicon, -1 where it has none."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.cumsum(lengths) - lengths
        out = np.full(len(words), -1, dtype=np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= self.longest))
        state = np.full(len(live), self.root, dtype=np.uint64)
        rank = np.zeros(len(live), dtype=np.int64)
        mask = (1 << self.bits) - 1
        depth = 0
        while len(live):
            keys = (state << np.uint64(8)) | blob[starts[live] + depth]
            slots = ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)
            keys = keys + np.uint64(1)
            edge = np.full(len(live), -1, dtype=np.int64)
            open_ = np.arange(len(live))
            while len(open_):
                there = self.table[slots[open_]]
                hit = there == keys[open_]
                edge[open_[hit]] = self.where[slots[open_[hit]]]
                open_ = open_[~hit & (there != 0)]
                slots[open_] = (slots[open_] + 1) & mask
            known = edge >= 0
            live, edge, rank = live[known], edge[known], rank[known]
            rank = rank + self.output[edge]
            state = self.target[edge].astype(np.uint64)
            depth += 1
            end = lengths[live] == depth
            ended = end & (self.final[state.astype(np.int64)] != 0)
            out[live[ended]] = rank[ended]
            live, state, rank = live[~end], state[~end], rank[~end]
        return out


@lru_cache(maxsize=2)
def _lexicon(file: str) -> Lexicon:
    return Lexicon(file if os.path.isabs(file) else SparkFiles.get(file))




def merge_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact ids of words without ASCII white space, and where each word's begin.

    Words of common letters are cut and merged here; those with other scripts, special
    tokens or more than :data:`LONGEST` bytes are left to the tokenizers library.
    """
    merges = bpe.merger(path)
    parts: list[bytes] = []
    owners: list[int] = []
    texts: list[str] = []
    usual: list[int] = []
    other: list[int] = []
    decoded = [w.decode("utf-8") for w in words]
    easy = bpe.all_plain(decoded)
    for i, (w, s) in enumerate(zip(words, decoded, strict=True)):
        if len(w) <= LONGEST and (easy or bpe.plain(s)) and not any(t in s for t in merges.specials):
            usual.append(i)
            texts.append(s)
        else:
            other.append(i)
    at = 0
    for p in _WORDS.findall(unicodedata.normalize("NFC", "\n".join(texts)).lower()) if texts else ():
        if p == "\n":
            at += 1
        else:
            parts.append(p.encode())
            owners.append(usual[at])
    flat, offsets = merges.merge(parts)
    sizes = np.zeros(len(words), dtype=np.int64)
    np.add.at(sizes, np.array(owners, dtype=np.int64), np.diff(offsets))
    extra = [e.ids for e in bpe.library(path).encode_batch([words[i].decode("utf-8") for i in other], add_special_tokens=False)] if other else []
    sizes[other] = [len(x) for x in extra]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(starts[-1]), dtype=np.int32)
    owned = np.ones(len(words), dtype=bool)
    owned[other] = False
    out[np.repeat(owned, sizes)] = flat
    for i, x in zip(other, extra, strict=True):
        out[starts[i] : starts[i + 1]] = x
    return out, starts


def encode_words(words: list[bytes], path: str, lexicon: Lexicon | None) -> list[bytes]:
    """Ids of each word, as little-endian unsigned 32-bit numbers."""
    out: list[bytes] = [b""] * len(words)
    rest = range(len(words))
    if lexicon is not None:
        ranks = lexicon.ranks(words)
        known = np.flatnonzero(ranks >= 0)
        raw = lexicon.ids.tobytes()
        r = ranks[known]
        for i, a, b in zip(known.tolist(), (4 * lexicon.offsets[r]).tolist(), (4 * lexicon.offsets[r + 1]).tolist(), strict=True):
            out[i] = raw[a:b]
        rest = np.flatnonzero(ranks < 0).tolist()
    ids, starts = merge_words([words[i] for i in rest], path)
    raw = ids.astype("<u4").tobytes()
    for k, (a, b) in zip(rest, zip((4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist(), strict=True), strict=True):
        out[k] = raw[a:b]
    return out


def _rows(key: pa.ChunkedArray, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
    rows = pa.RecordBatch.from_arrays([key.combine_chunks(), *columns.values()], ["key", *columns])
    for at in range(0, rows.num_rows, 1000):
        yield rows.slice(at, 1000)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, file: str | None, back: bool = False) -> Iterator[pa.RecordBatch]:
    lexicon = _lexicon(file) if file else None
    for table in gathered(batches, "text", TEXT_BYTES):
        texts = [(t or "").encode().split() for t in table.column("text").to_pylist()]
        distinct = list(set().union(*texts)) if texts else []
        code = dict(zip(distinct, encode_words(distinct, path, lexicon), strict=True)).__getitem__
        ids = [b"".join(map(code, words)) for words in texts]
        del texts, distinct, code
        columns = {"ids": pa.array(ids, type=pa.binary())}
        if back:
            columns["decoded"] = pa.array(decode_ids(ids, path), type=pa.string())
        yield from _rows(table.column("key"), **columns)


@lru_cache(maxsize=2)
def _names(path: str) -> list[str]:
    tokenizer = bpe.library(path)
    return [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]


def decode_ids(ids: list[bytes | None], path: str) -> list[str]:
    """The text of each list of ids: its tokens with a space between, as the library decodes."""
    name = _names(path).__getitem__
    return [" ".join(map(name, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in ids]


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, "ids", TEXT_BYTES):
        ids = table.column("ids")
        yield from _rows(table.column("key"), ids=ids.combine_chunks(), decoded=pa.array(decode_ids(ids.to_pylist(), path), type=pa.string()))




def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[bytes] = Counter()
    for table in gathered(batches, "text", TEXT_BYTES // 4):
        part = Counter(b" ".join([t.encode() for t in table.column("text").to_pylist() if t]).split())
        for w, n in part.items():
            if n > 1 and len(w) <= LONGEST:
                total[w] += n
        if len(total) > 2 * COUNTED_WORDS:
            total = Counter(dict(total.most_common(COUNTED_WORDS)))
    if total:
        top = total.most_common(COUNTED_WORDS)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], type=pa.binary()), pa.array([n for _, n in top], type=pa.int64())], ["word", "n"])


def frequent_words(docs: DataFrame, text: str = "text", limit: int = LEXICON_WORDS) -> list[bytes]:
    """The ``limit`` most frequent words of all texts, by lossy counting.

    Every text is counted. Words that occur once in a stretch of text, and all but the
    most frequent :data:`COUNTED_WORDS` of a task, are not carried on: this bounds a
    task's memory and the shuffle, and can only cost rare words their place.
    """
    ship(docs.sparkSession)
    counts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(_counted, "word binary, n long")
    rows = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(limit).collect()
    return [bytes(r.word) for r in rows]


def build_lexicon(docs: DataFrame, path: str, text: str = "text", limit: int = LEXICON_WORDS) -> str:
    """Compile the corpus's frequent words and hand the file to all executors; returns its name."""
    words = frequent_words(docs, text, limit)
    return put_file(docs.sparkSession, "words.lexicon", compile_lexicon(words, *merge_words(words, path)))




def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lexicon: str | None = None) -> DataFrame:
    """Each row's key and ``ids``: little-endian unsigned 32-bit numbers, one after another."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lambda it: _encoded(it, path, lexicon), f"key {kind}, ids binary")
        .withColumnRenamed("key", key)
    )


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Each row's key, ``ids`` and ``decoded``."""
    ship(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()
    return (
        encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
        .mapInArrow(lambda it: _decoded(it, path), f"key {kind}, ids binary, decoded string")
        .withColumnRenamed("key", key)
    )


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lexicon: str | None = None) -> DataFrame:
    """As :func:`encode`, then :func:`decode` of those ids in the same worker."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lambda it: _encoded(it, path, lexicon, True), f"key {kind}, ids binary, decoded string")
        .withColumnRenamed("key", key)
    )


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The round trip's digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = round_trip(docs, path, lexicon=build_lexicon(docs, path))
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
