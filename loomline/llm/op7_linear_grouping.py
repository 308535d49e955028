"""Packing documents into sequences by linear grouping, then best fit.

A document's ids, closed by the end token, become pieces: all but the first are full
sequences, the first holds what is left over. Only how many pieces there are of each
length reaches the driver: a histogram with one bin a length, however large the
corpus. The plan is made on it:

1. lengths above ``capacity / SMALL`` are put in order and cut into groups of equal
   numbers of pieces; a group's lengths are rounded up to its largest;
2. column generation over the few rounded lengths finds how often each way of filling
   a sequence is used;
3. the slots of a group are given to its real pieces in order of length, so a run of
   sequences of one filling is split only where a real length changes;
4. the small pieces go, longest first, each into the fullest sequence that takes it.

Best fit of all pieces, step 4 alone, is planned first. Where it takes no more sequences
than the tokens fill, no plan takes fewer; elsewhere the plan of steps 1 to 4 is made too
and the one of fewer sequences is used. A histogram of many lengths with small ones among
them is best fit's; one of few lengths, of which certain ones belong together, is not.

The plan is a list of runs (length, first piece, number, first sequence, offset); it
grows with the number of lengths and not with the number of pieces. Pieces are
numbered within a length by salted counts, so a length that a third of all pieces
have is spread over many tasks, and are joined to the runs.

Defined results: a null or empty text holds the end token alone; repeated rows are
packed each, those of one id told apart by no column; an empty table gives an empty
table; columns besides the key and the text are ignored; a key of null is kept.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomline.llm import bpe
from loomline.llm.shared import gathered, ship, written

CAPACITY, END = 2048, 0
#: Pieces of more than capacity / SMALL are grouped, into about so many groups: a filling
#: holds up to SMALL - 1 grouped pieces.
SMALL, GROUPS = 8, 120
#: Pieces of one length that are numbered in one task, about.
NUMBERED = 200_000
TEXT_BYTES, LONGEST = 2 << 20, 200
#: Words whose ids a process keeps.
KNOWN = 150_000
_PARTS = regex.compile(r"\x00|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x00]+|\s+(?!\S)|\s+")




class Known:
    """Ids of words that come after a space, kept from one block of texts for the next ones.

    A word stays if it was new in two blocks in a row, until :data:`KNOWN` have; the others
    are merged in each block, so what is kept changes no result.
    """

    def __init__(self) -> None:
        self.codes: dict[str, bytes] = {}
        self.last: set[str] = set()

    def settle(self, new: list[str]) -> None:
        """Forget the words ``new`` of a block, but for those that stay."""
        room = KNOWN - (len(self.codes) - len(new))
        for w in new:
            if room > 0 and w in self.last:
                room -= 1
            else:
                del self.codes[w]
        self.last = set(new) if room > 0 else set()


@lru_cache(maxsize=1)
def _known(path: str) -> Known:
    return Known()


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text by a byte-level BPE, little-endian unsigned 32-bit numbers.

    A space or a line break between two characters that are no white space begins a new
    word in any text, so texts of single spaces and breaks are cut there and each
    distinct word is merged once, a frequent one not again in later blocks. Other texts are left to the tokenizers library.
    """
    merges = bpe.merger(path)
    out: list[bytes] = [b""] * len(texts)
    cut: list[tuple[int, list[str], list[int]]] = []
    whole: list[int] = []
    distinct: set[str] = set()
    heads: set[str] = set()
    for i, t in enumerate(texts):
        if not t:
            continue
        words = t.split()
        # each two words are parted by one character, a space or a break; none is at the ends
        gaps = len(words) - 1
        if gaps < 0 or sum(map(len, words)) + gaps != len(t) or t.count(" ") + t.count("\n") != gaps or "\x00" in t or any(s in t for s in merges.specials):
            whole.append(i)
            continue
        first = [0]
        for line in t.split("\n")[:-1]:
            first.append(first[-1] + line.count(" ") + 1)
        distinct.update(words)
        heads.update([words[k] for k in first])
        cut.append((i, words, first))
    if cut:
        known = _known(path)
        bare, begun = list(distinct.difference(known.codes)), list(heads)
        made = _encode_words([" " + w for w in bare] + begun + ["\n"], path)
        break_, head = made[-1], dict(zip(begun, made[len(bare) : -1], strict=True))
        known.codes.update(zip(bare, made, strict=False))
        inner = known.codes.__getitem__
        for i, words, first in cut:
            codes = list(map(inner, words))
            for k in first:
                codes[k] = break_ + head[words[k]]
            codes[0] = head[words[0]]
            out[i] = b"".join(codes)
        known.settle(bare)
    if whole:
        for i, e in zip(whole, bpe.library(path).encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
    return out


def _encode_words(words: list[str], path: str) -> list[bytes]:
    merges = bpe.merger(path)
    easy = bpe.all_plain(words)
    usual = [i for i, w in enumerate(words) if len(w) <= LONGEST and (easy or bpe.plain(w))]
    out: list[bytes] = [b""] * len(words)
    # letters alone, after a space or not, are one part
    single = [(w[1:] if w[0] == " " else w).isalpha() for w in map(words.__getitem__, usual)]
    usual = [*compress(usual, single), *compress(usual, map(not_, single))]
    at = sum(single)
    parts, owners = [words[i].encode() for i in usual[:at]], list(range(at))
    for p in _PARTS.findall("\x00".join([words[i] for i in usual[at:]])):
        if p == "\x00":
            at += 1
        else:
            parts.append(p.encode())
            owners.append(at)
    ids, starts = merges.merge(parts)
    sizes = np.bincount(np.array(owners, dtype=np.int64), np.diff(starts), len(usual)).astype(np.int64)
    ends = (4 * np.cumsum(sizes)).tolist()
    raw, begin = ids.astype("<u4").tobytes(), 0
    for i, end in zip(usual, ends, strict=True):
        out[i] = raw[begin:end]
        begin = end
    rest = sorted(set(range(len(words))) - set(usual)) if len(usual) < len(words) else []
    if rest:
        for i, e in zip(rest, bpe.library(path).encode_batch([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    end = np.array([END], dtype="<u4").tobytes()
    for table in gathered(batches, "text", TEXT_BYTES):
        rows, piece, start, length, crc, ids = [], [], [], [], [], []
        for r, code in enumerate(encode_texts([t or "" for t in table.column("text").to_pylist()], path)):
            code += end
            n = len(code) // 4
            cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                rows.append(r)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                part = code[4 * a : 4 * b]
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        key = table.column("key").combine_chunks().take(pa.array(rows, type=pa.int64()))
        columns = [key, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["key", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.binary()))
            names.append("ids")
        out = pa.RecordBatch.from_arrays(columns, names)
        for at in range(0, out.num_rows, 1000):
            yield out.slice(at, 1000)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's pieces: key, piece, start, length, ids_crc32 and, if asked for, ``ids``."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lambda it: _pieces(it, path, capacity, with_ids), f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
        .withColumnRenamed("key", key)
    )




def _best_filling(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The filling of the greatest worth, any number of each size (an unbounded knapsack)."""
    value = np.zeros(capacity + 1)
    chosen = np.full(capacity + 1, -1, dtype=np.int64)
    for k, s in enumerate(sizes):
        for a in range(s, capacity + 1, s):  # a block of s rooms builds on the block before
            b = min(a + s, capacity + 1)
            gains = value[a - s : b - s] + worth[k]
            better = gains > value[a:b] + 1e-12
            value[a:b][better] = gains[better]
            chosen[a:b][better] = k
    filling = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while chosen[c] >= 0:
        filling[chosen[c]] += 1
        c -= sizes[chosen[c]]
    return float(worth @ filling), filling


def fillings(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Column generation for ``demand`` pieces of each of few ascending ``sizes``.

    Returns fillings with whole numbers of uses, rounded down; what they leave over is
    for the caller. Every size is positive and at most the capacity.
    """
    k = len(sizes)
    b = np.array(demand, dtype=float)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        gain, filling = _best_filling(sizes, worth, capacity)
        if gain <= 1 + 1e-7:
            break
        uses = np.linalg.solve(basis, b)
        step = np.linalg.solve(basis, filling.astype(float))
        ratio = np.where(step > 1e-9, uses / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = filling
    uses = np.floor(np.maximum(np.linalg.solve(basis, b), 0) + 1e-6).astype(np.int64)
    left = np.array(demand, dtype=np.int64)
    result = []
    for j in np.argsort(-uses, kind="stable"):
        column = basis[:, j].astype(np.int64)
        n = int(min([uses[j], *(left[column > 0] // column[column > 0])]))
        if n > 0:
            result.append((column, n))
            left -= column * n
    return result


class _Bins:
    """Runs of alike sequences by the room that is left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.next, self.rooms = capacity, 0, []
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def add(self, room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.runs[room]:
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.runs[room].append((first, n))

    def take(self, length: int, n: int) -> tuple[int, int, int]:
        """Up to ``n`` sequences with the least room for ``length``: first, how many, room before."""
        at = bisect_left(self.rooms, length)
        if at == len(self.rooms):
            many = self.capacity // length
            count = -(-n // many)
            first, self.next = self.next, self.next + count
            self.add(self.capacity, first, count)
            return self.take(length, n)
        room = self.rooms[at]
        first, many = self.runs[room].pop()
        if many > n:
            self.runs[room].append((first + n, many - n))
            many = n
        if not self.runs[room]:
            self.rooms.pop(at)
        return first, many, room


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first piece, number, first sequence, offset) that place every piece.

    Pieces of a length are numbered from 0. Run by run, piece ``first + i`` lies in
    sequence ``first sequence + i`` at ``offset``.
    """
    runs, used = _plan(histogram, capacity, 0)
    if groups and used * capacity - sum(length * n for length, n in histogram.items()) >= capacity:
        grouped, n = _plan(histogram, capacity, groups)
        if n <= used:
            return grouped
    return runs


def _plan(histogram: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    runs: list[tuple[int, int, int, int, int]] = []
    bins = _Bins(capacity)
    placed: dict[int, int] = defaultdict(int)

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, placed[length], n, first, offset))
        placed[length] += n

    if n := histogram.get(capacity, 0):
        place(capacity, n, 0, 0)
        bins.next = n
    large = sorted((length, n) for length, n in histogram.items() if groups and capacity // SMALL < length < capacity and n)
    total = sum(n for _, n in large)
    if total:
        # whole lengths to groups of about equal numbers: a length that many pieces have is a group of its own
        sizes, members = [], []
        held, own = 0, []
        for length, n in large:
            own.append([length, n])
            held += n
            if held >= total / groups or length == large[-1][0]:
                sizes.append(length)
                members.append(own)
                held, own = 0, []
        for filling, uses in fillings(sizes, [sum(n for _, n in m) for m in members], capacity):
            slots = [i for i in range(len(sizes) - 1, -1, -1) for _ in range(int(filling[i]))]
            while uses:
                # a run lasts as long as the real length in each slot; one length may fill several slots
                now: list[int] = []
                need: dict[tuple[int, int], int] = defaultdict(int)
                taken: dict[int, tuple[int, int]] = {}
                for i in slots:
                    at, used = taken.get(i, (len(members[i]) - 1, 0))
                    if members[i][at][1] <= used:
                        at, used = at - 1, 0
                    taken[i] = (at, used + 1)
                    need[i, at] += 1
                    now.append(members[i][at][0])
                n = min([uses, *(members[i][at][1] // k for (i, at), k in need.items())])
                first, bins.next, offset = bins.next, bins.next + n, 0
                for length in now:
                    place(length, n, first, offset)
                    offset += length
                for (i, at), k in need.items():
                    members[i][at][1] -= n * k
                    if not members[i][at][1]:
                        members[i][at] = (0, 0)
                for i in {i for i, _ in need}:
                    members[i] = [m for m in members[i] if m[1]]
                bins.add(capacity - offset, first, n)
                uses -= n
    for length in sorted((k for k, n in histogram.items() if n > placed[k]), reverse=True):
        while (n := histogram[length] - placed[length]) > 0:
            first, many, room = bins.take(length, n)
            place(length, many, first, capacity - room)
            bins.add(room - length, first, many)
    return runs, bins.next




def assign(parts: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``parts`` is read twice: pass a written table.

    The histogram has at most ``capacity`` bins of ``salts`` counts each; the plan that is
    joined to the pieces is bounded by the number of lengths.
    """
    spark = parts.sparkSession
    most = parts.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, min(4096, -(-most // NUMBERED)))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    counts: dict[int, dict[int, int]] = defaultdict(dict)
    for r in salted.groupBy("length", "salt").count().collect():
        counts[r.length][r.salt] = r["count"]
    runs = plan({length: sum(by.values()) for length, by in counts.items()}, capacity, groups)
    # a run's part for each salt: rank in the salt, so that the numbering needs no global order
    rows = []
    bounds: dict[int, list[tuple[int, int, int]]] = {}
    for length, by in counts.items():
        at, own = 0, []
        for salt in sorted(by):
            own.append((salt, at, at + by[salt]))
            at += by[salt]
        bounds[length] = own
    for length, first, n, sequence, offset in runs:
        own = bounds[length]
        i = bisect_left([b for _, _, b in own], first + 1)
        while i < len(own) and own[i][1] < first + n:
            salt, a, b = own[i]
            lo, hi = max(a, first), min(b, first + n)
            rows.append((length, salt, lo - a, hi - a, sequence + lo - first - (lo - a), offset))
            i += 1
    kinds = T.StructType([T.StructField(c, k) for c, k in (("length", T.LongType()), ("salt", T.IntegerType()), ("from_rank", T.LongType()), ("to_rank", T.LongType()), ("shift", T.LongType()), ("offset", T.LongType()))])
    runs_df = spark.createDataFrame(rows, kinds)
    table = runs_df.groupBy("length", "salt").agg(F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "shift", "offset"))).alias("runs"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(key, "piece", "start", "ids_crc32")) - 1
    joined = salted.withColumn("rank", rank.cast("long")).join(table, ["length", "salt"])
    run = F.filter("runs", lambda r: (r["from_rank"] <= F.col("rank")) & (F.col("rank") < r["to_rank"]))[0]
    return joined.withColumn("run", run).select(
        *parts.columns, (F.col("run.shift") + F.col("rank")).alias("sequence_id"), F.col("run.offset").alias("offset")
    )


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return assign(written(pieces(docs, path, key, text, capacity, with_ids), "pieces"), key, capacity)
