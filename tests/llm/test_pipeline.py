from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import op3_paragraph_dedup as op3
from loomline.llm import op5_minmax_dedup as op5
from loomline.llm import similar
from loomline.llm.shared import written


@pytest.fixture
def one_bucket(monkeypatch):
    """Every unit in one bucket, with no second key that two of them could share."""

    def clusters(units, sets_of, percent):
        return similar.clusters(written(units.withColumn("keys", F.array(F.lit(1).cast("long"))), "units"), sets_of, percent)

    for op in (op3, op5):
        monkeypatch.setattr(op, "clusters", clusters)


def test_stages_find_every_copy_in_a_large_bucket(spark, one_bucket):
    rng = random.Random(3)
    own = {i: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)] for i in range(60)}
    near = {100 + i: own[i][:60] + ["other"] + own[i][61:] for i in range(0, 60, 2)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in {**own, **near}.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.single(spark, docs, "").collect()) == sorted(own)
    left = {r.doc_id: r.text for r in corpus_pipeline.unrepeated(spark, docs, "").collect()}
    assert left == {**{i: " ".join(w) for i, w in own.items()}, **dict.fromkeys(near, "")}


def test_texts_of_a_repeated_id_are_all_compared(spark):
    """Two paragraphs at the same place of one id's texts: each is a candidate, none is lost with the other."""
    rng = random.Random(6)
    p, q, r = (["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)] for _ in range(3))
    near = lambda w, i: " ".join([*w[:i], "other", *w[i + 1 :]])
    rows = [(1, " ".join(p)), (2, " ".join(q)), (2, near(p, 45)), (2, " ".join(r)), (3, near(q, 40)), (3, near(r, 41)), (4, near(r, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [(x.doc_id, x.text) for x in corpus_pipeline.unrepeated(spark, docs, "").collect()]
    assert sorted(left) == sorted([*rows[:2], (2, ""), rows[3], (3, ""), (3, ""), (4, "")])
