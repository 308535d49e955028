from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from loomline.llm import op4_neighbour_quality as op4
from loomline.llm import op8_pu_toxicity as op8


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["an", "ther", "ing", "ou", "re", "st", "ble"]) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(600):
        words = prose(rng, rng.randint(20, 120))
        junk, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum,", "Moron"])
        if junk:
            words = [w + rng.choice(["%%%", "$$$", "***"]) for w in words] if i % 2 else [w for w in words for _ in range(6)]
        rows.append((i, " ".join(words), int(not junk), int(toxic)))
    return rows


def tables(spark, corpus):
    extra = [(9001, None), (9002, ""), (9003, "one"), (9004, "long idiot " * 40_000), (5, corpus[5][1])]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in corpus] + [(i, t, 0.1) for i, t in extra], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in corpus] + [(None, 1, 1), (9001, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_held_out_rows(spark, corpus):
    rows = op4.quality(*tables(spark, corpus)).collect()
    assert len(rows) == len(corpus) + 5
    truth = {i: q for i, _, q, _ in corpus}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in rows if r.doc_id in (9001, 9002)} == {0.0}


def test_scores_equal_brute_force(corpus):
    space = op4.Space([(t, q) for _, t, q, _ in corpus[:200]])
    texts = [t for _, t, _, _ in corpus[200:260]]
    for t, got in zip(texts, space.scores(texts, block=7), strict=True):
        v = (op4.terms(t) * space.weights) @ space.axes
        near = space.vectors @ (v / np.linalg.norm(v))
        top = np.argsort(-near, kind="stable")[: op4.NEIGHBOURS]
        w = np.maximum(near[top].astype(float), 0) ** op4.POWER
        assert abs(got - (w * space.labels[top]).sum() / w.sum()) < 1e-4


def test_toxicity_on_held_out_rows(spark, corpus):
    rows = op8.toxicity(*tables(spark, corpus)).collect()
    truth = {i: x for i, _, _, x in corpus}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[9004].predicted == 1 and by[9001].predicted == by[9002].predicted == 0


def test_filters_keep_columns_and_rows(spark, corpus):
    docs, labels = tables(spark, corpus)
    good = {r.doc_id for r in op4.quality(docs, labels).collect() if r.predicted}
    kept = op4.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    clean = {r.doc_id for r in op8.toxicity(docs, labels).collect() if not r.predicted}
    kept = op8.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op4.quality(docs, labels).collect() == [] and op8.toxicity(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x")], docs.schema)
    assert [r.score for r in op4.quality(one, labels).collect()] == [0.5]
    assert op8.toxicity(one, labels).first().predicted == 0


def test_training_holds_little_memory():
    rng = random.Random(9)
    texts = [" ".join(prose(rng, 400)) for _ in range(1500)]
    tracemalloc.start()
    try:
        space = op4.Space((t, i % 2) for i, t in enumerate(texts))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(space.labels) == 1500 and space.vectors.shape == (1500, op4.DIMENSIONS)
    assert peak < 40e6
