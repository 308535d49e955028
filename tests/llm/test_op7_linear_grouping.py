from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomline.llm import op7_linear_grouping as op

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "a b\nc d", "a  b", " lead", "trail ", "x\ty", "two\n\nbreaks", "don't we'll 123 ½", "日本語 текст 🙂", "nul\x00 x",
    "a<|endoftext|>b c", "z" * 4000, "word " * 5000 + "end", "İx Σ", "the same text", "the same text",
]


def check_plan(histogram: dict[int, int], capacity: int, groups: int) -> int:
    runs, used = op._plan(histogram, capacity, groups)
    placed, bins = defaultdict(list), defaultdict(list)
    for length, first, n, sequence, offset in runs:
        placed[length].extend(range(first, first + n))
        for i in range(n):
            bins[sequence + i].append((offset, length))
    assert {k: n for k, n in histogram.items() if n} == {k: len(v) for k, v in placed.items()}
    assert all(sorted(v) == list(range(len(v))) for v in placed.values())
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert used >= len(bins)
    return len(bins)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 9), max_size=12), st.sampled_from([0, 1, 3, 8]))
def test_every_plan_places_each_piece_once(histogram, groups):
    check_plan(histogram, 64, groups)


def best_fit(lengths: list[int], capacity: int) -> int:
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        insort(rooms, (rooms.pop(at) if at < len(rooms) else capacity) - n)
    return len(rooms)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2049, 20_000).tolist()
    histogram = dict(Counter(lengths))
    bound = -(-sum(lengths) // 2048)
    # rounding up costs a group's share of the large pieces, rounding down a sequence a group
    assert check_plan(histogram, 2048, op.GROUPS) <= bound + len(lengths) / op.GROUPS + op.GROUPS
    runs = op.plan(histogram)
    assert len({s + i for _, _, n, s, _ in runs for i in range(n)}) <= best_fit(lengths, 2048)


def test_lengths_that_belong_together_meet():
    # half + e with two quarters, and four quarters: 6 + 3 sequences, where best fit takes 11
    for many in (1, 100):
        histogram = {1032: 6 * many, 528: 6 * many, 520: 6 * many, 496: 12 * many}
        lengths = [length for length, n in histogram.items() for _ in range(n)]
        assert best_fit(lengths, 2048) == 11 * many
        runs = op.plan(histogram)
        assert len({s + i for _, _, n, s, _ in runs for i in range(n)}) == 9 * many
        assert check_plan(histogram, 2048, op.GROUPS) == 9 * many


def test_pieces_and_packing_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(op, "NUMBERED", 2)  # several salts
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    library = Tokenizer.from_file(PATH)
    rows = op.pack(docs, PATH, with_ids=True).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert len(by) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            part = want[at : at + r.length].tobytes()
            assert (r.piece, r.start, r.ids_crc32, bytes(r.ids)) == (k, at, zlib.crc32(part), part), (i, t)
            assert k == 0 or r.length == 2048
            at += r.length
        assert at == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_other_white_space_is_left_to_the_library():
    texts = ["x\ty\tz\n\n\nb", "a  b\tc", "a\xa0b  c", "a\r\nb\n\nc", " a\tb", "a\tb\n", "a\u2028b\n c", "a\x1cb  c"]
    library = Tokenizer.from_file(PATH)
    assert [np.frombuffer(e, dtype="<u4").tolist() for e in op.encode_texts(texts, PATH)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_table(spark):
    assert op.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_frequent_words_are_merged_once_and_few_are_kept(monkeypatch):
    merged = []
    own = op._encode_words
    monkeypatch.setattr(op, "_encode_words", lambda words, path: merged.append(words) or own(words, path))
    monkeypatch.setattr(op, "KNOWN", 4)
    op._known.cache_clear()
    library = Tokenizer.from_file(PATH)
    for i in range(4):
        texts = [f"the same words come, again, again {i} new{i} don't", f"new{i} a\nb the é{i} 3½", "again\ncome,", "x"]
        assert [np.frombuffer(e, dtype="<u4").tolist() for e in op.encode_texts(texts, PATH)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(op._known(PATH).codes) == 4 and not op._known(PATH).last
    assert len(merged[2]) == len(merged[0]) - 4
    op._known.cache_clear()
