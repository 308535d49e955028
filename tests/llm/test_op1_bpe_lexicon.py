from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loomline.llm import op1_bpe_lexicon as op

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "Hello, World! it's 2024", "İstanbul ΣΑΣ Straße ﬁ é é", "a<|endoftext|>b <|startoftext|>", "\x1c x\x85y z w",
    "日本語 текст 🙂🙂", "x" * 5000, "aaa aaaa aaaaaaa 'll 've don't", "a\tb\nc\r\nd\x0be\x0cf", "½²³ 12345 $$$***", "the the the the", "the the the the",
]


def test_lexicon_finds_exactly_its_words(tmp_path):
    words = sorted({w.encode() for w in "in inn inner sinner winner win wins é tree trees".split()})
    ids, offsets = op.merge_words(words, PATH)
    file = tmp_path / "x.lexicon"
    file.write_bytes(op.compile_lexicon(words[::-1], *op.merge_words(words[::-1], PATH)))
    lexicon = op.Lexicon(str(file))
    assert lexicon.ranks(words).tolist() == list(range(len(words)))
    assert (lexicon.ranks([b"", b"i", b"innerx", b"zebra"]) == -1).all()
    assert op.encode_words(words, PATH, lexicon) == op.encode_words(words, PATH, None)
    assert lexicon.ids.tolist() == ids.tolist() and lexicon.offsets.tolist() == offsets.tolist()


def test_empty_lexicon(tmp_path):
    file = tmp_path / "x.lexicon"
    file.write_bytes(op.compile_lexicon([], np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64)))
    assert op.Lexicon(str(file)).ranks([b"a", b""]).tolist() == [-1, -1]


def test_round_trip_equals_the_library(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    library = Tokenizer.from_file(PATH)
    rows = {r.doc_id: r for r in op.digests(docs, PATH).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[i].n_tokens == len(ids), (i, t)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decode_of_encode_is_the_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    apart = op.decode(op.encode(docs, PATH), PATH)
    assert sorted(map(tuple, apart.collect())) == sorted(map(tuple, op.round_trip(docs, PATH).collect()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.digests(docs, PATH).collect() == []
