"""Toxicity by non-negative positive-unlabelled learning.

A linear model over words and their beginnings is trained in numpy from texts known to
be toxic and from unlabelled texts, of which a share that is known, the class prior,
is toxic too. The risk of taking unlabelled texts for clean is corrected by that share
of the toxic texts' risk, and kept from falling below zero: where it would, a step
follows the toxic texts' own risk alone, so the model learns no single texts by heart.

Samples are bounded: :data:`POSITIVES` toxic and :data:`UNLABELLED` unlabelled rows. The
unlabelled texts are taken without their labels, from the rows that are not held out: what
chance puts into the toxic sample is then in the other one too. Scoring reads whole texts and looks up
each distinct word once; no text is cut.

Defined results: a null or empty text scores as one without known words (near 0); without
toxic rows to learn from every score is 0; repeated rows are scored each; an empty table
gives an empty table. Key and text alone are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.labelled import MODEL, packed, remainder, rows_of, sample, unlabelled, unpacked
from loomline.llm.shared import chunks, ship

POSITIVES, UNLABELLED, FEATURES = 3000, 6000, 1500
#: A feature is taken up if toxic texts have it so many standard deviations more often than chance.
SURPRISE = 6.0
#: From this score on a text counts as toxic.
TOXIC = 0.7
TEXT_BYTES = 4 << 20
_MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_/\\~"
_MEMO = 100_000


def features(word: str) -> list[str]:
    """A word's features: itself and its beginnings, in lower case without marks around."""
    w = word.strip(_MARKS)
    if not w:
        return []
    return [w + " ", *(w[:n] for n in (4, 5, 6) if len(w) >= n)]


class Model:
    """Weights of the features; unknown features weigh nothing."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.memo: dict[str, float] = {}

    def __getstate__(self) -> tuple:
        return self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def word(self, w: str) -> float:
        x = sum(self.weights.get(f, 0.0) for f in features(w))
        if len(self.memo) >= _MEMO:
            self.memo.clear()
        self.memo[w] = x
        return x

    def score(self, text: str | None) -> float:
        known, word = self.memo.get, self.word
        total = self.bias
        for w in set((text or "").lower().split()):
            x = known(w)
            total += word(w) if x is None else x
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _chosen(names: list[str], p: np.ndarray, n: int, u: np.ndarray, m: int) -> list[int]:
    """Features that toxic texts have clearly more often, most telling first.

    ``p`` of ``n`` toxic texts and ``u`` of ``m`` others have a feature.
    """
    b = (u + 0.5) / max(1, m)
    surprise = (p - n * b) / np.sqrt(n * b + 0.5)
    telling = np.flatnonzero((p >= 3) & (surprise > SURPRISE) & (p > 2 * n * b))
    return sorted(telling.tolist(), key=lambda f: (surprise[f], names[f]), reverse=True)[:FEATURES]


def train(sample: Iterable[tuple[str, int]], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Non-negative PU learning with the logistic loss, full steps by Adam.

    ``sample`` has toxic texts (1) and unlabelled ones (0) after them; each is read once and
    its features are kept as numbers.
    """
    of = lru_cache(maxsize=_MEMO)(features)
    code: dict[str, int] = {}
    known = lru_cache(maxsize=_MEMO)(lambda w: [code[f] for f in of(w) if f in code])
    sets: list[np.ndarray] = []
    np_ = 0
    for text, positive in sample:
        own = set(text.lower().split())
        found = {code.setdefault(f, len(code)) for w in own for f in of(w)} if positive else {f for w in own for f in known(w)}
        sets.append(np.fromiter(found, dtype=np.int32, count=len(found)))
        np_ += positive
    if not np_:
        return Model({}, -30.0)
    every = list(code)
    p, u = (np.bincount(np.concatenate([np.empty(0, dtype=np.int32), *part]), minlength=len(every)) for part in (sets[:np_], sets[np_:]))
    chosen = _chosen(every, p, np_, u, len(sets) - np_)
    place = np.full(len(every), -1)
    place[chosen] = np.arange(len(chosen))
    names = [every[f] for f in chosen]
    column = place[np.concatenate(sets)]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[column >= 0]
    column = column[column >= 0]
    n, nu = len(sets), max(1, len(sets) - np_)
    is_p = np.arange(n) < np_
    w, b = np.zeros(len(names)), math.log(prior / (1 - prior))
    m1, m2 = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(row, weights=w[column], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.logaddexp(0, z)  # loss of calling a text clean
        negative = clean[~is_p].sum() / nu - prior * clean[is_p].sum() / np_
        g = np.zeros(n)
        if negative >= 0:
            g[is_p] = prior * (s[is_p] - 1) / np_ - prior * s[is_p] / np_
            g[~is_p] = s[~is_p] / nu
        else:
            g[is_p] = prior * (s[is_p] - 1) / np_
        grad = np.append(np.bincount(column, weights=g[row], minlength=len(names)) + decay * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", positives: int = POSITIVES, rest: int = UNLABELLED) -> Model:
    """A model from bounded samples; the class prior is the share of toxic ones among the labels."""
    share = labels.where(F.col(label).isNotNull()).agg(F.avg((F.col(label) == 1).cast("double"))).first()[0]
    if not share:
        return Model({}, -30.0)
    ship(docs.sparkSession)
    prior = min(0.9, max(1e-3, share))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(train(rows_of(batches, "text", "positive"), prior))

    own = sample(docs, labels, label, positives, 1, key, text).select("text", F.lit(1).alias("positive"))
    own = own.union(unlabelled(docs, rest, key, text).select("text", F.lit(0).alias("positive"))).where("text != ''")
    return unpacked(own.repartition(1).sortWithinPartitions(F.desc("positive"), "text").mapInArrow(fitted, MODEL), Model({}, -30.0))


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    score = model.value.score
    for batch in chunks(batches, "text", TEXT_BYTES):
        scores = pa.array([score(t) for t in batch.column("text").to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), scores], [*batch.schema.names, "score"])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lambda it: (b.select(["key", "score"]) for b in _scored(it, shared)), f"key {kind}, score double")
        .withColumnRenamed("key", key)
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the third of rows held out are not read."""
    own = remainder("doc_id", 3) != 1
    model = fit(docs.where(own), labels.where(own))
    return score(docs, model).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= TOXIC, 1).otherwise(0).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores below :data:`TOXIC`."""
    ship(docs.sparkSession)
    own = remainder("doc_id", 3) != 1
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.where(own), labels.where(own)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _scored(batches, shared):
            yield batch.filter(pa.compute.less(batch.column(batch.num_columns - 1), TOXIC)).select(list(range(batch.num_columns - 1)))

    return docs.mapInArrow(kept, docs.schema)
