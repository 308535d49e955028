"""Text quality by voting of the nearest labelled documents in a latent-semantic space.

A text's terms are pairs of neighbouring characters (by class: letters, capitals,
digits, each mark) and a few terms of its shape: how often a word repeats the one
before, how few of its words differ. Term counts, damped and weighted by rarity, are
projected on the leading singular vectors of the labelled sample. The sample's unit
vectors are broadcast; every document's cosines with all of them are computed exactly,
a block of documents at a time, and the nearest ones' labels are averaged by similarity.

The sample is bounded: :data:`LABELLED` rows (6000 vectors of 96 numbers, 2.3 MB),
whatever the corpus. Fitting uses nothing but those rows; scoring reads whole texts.

Defined results: a null text or one without terms scores 0; without labelled rows every
score is 0.5; repeated rows are scored each; an empty table gives an empty table; ties of
neighbours go to the row that comes first in the sample. Key and text alone are read, so
other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.labelled import MODEL, packed, remainder, rows_of, sample, unpacked
from loomline.llm.shared import chunks, ship

#: Labelled rows that are kept, dimensions, neighbours that vote, power of the similarity.
LABELLED, DIMENSIONS, NEIGHBOURS, POWER = 6000, 96, 15, 4
#: From this score on a text counts as good.
GOOD = 0.3
TEXT_BYTES = 4 << 20
_CLASSES = 48


def _classes() -> np.ndarray:
    own = np.zeros(256, dtype=np.int64)
    for b in range(97, 123):
        own[b] = 1 + (b - 97) // 2  # 1 to 13: letters, two by two
    own[65:91] = 14
    own[48:58] = 15
    own[[32, 9, 13]] = 16
    own[10] = 17
    own[128:192] = 18
    own[192:] = 19
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[]_{|}~"):
        own[ord(c)] = 20 + i % 28
    return own


_CLASS = _classes()
TERMS = _CLASSES * _CLASSES + 16


def terms(text: str) -> np.ndarray:
    """Damped counts of a text's terms, as 32-bit numbers."""
    out = np.zeros(TERMS, dtype=np.float32)
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if not len(raw):
        return out
    c = _CLASS[raw]
    pairs = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES * _CLASSES)
    # the share of each pair, damped, so that long and short texts of a kind lie close
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / max(1, len(raw) - 1))
    words = text.split()
    if len(words) > 1:
        n = len(words)
        again = sum(map(str.__eq__, words, words[1:])) / (n - 1)
        few = 1 - len(set(words)) / n
        out[_CLASSES * _CLASSES] = again
        out[_CLASSES * _CLASSES + 1 + min(7, int(again * 8))] = 0.3 if again > 0.02 else 0.0
        out[_CLASSES * _CLASSES + 9] = max(0.0, few - 0.5) if n > 20 else 0.0
    return out


def _nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` greatest of each row, those of equal value by place."""
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    least = np.take_along_axis(near, top, axis=1).min(axis=1)
    # where the last one is tied, the first places of that value count
    for i in np.flatnonzero((near >= least[:, None]).sum(axis=1) > k):
        top[i] = np.argsort(-near[i], kind="stable")[:k]
    return top


class Space:
    """The labelled sample's latent-semantic space."""

    def __init__(self, sample: Iterable[tuple[str | None, int]]) -> None:
        labels: list[int] = []
        rows: list[tuple[np.ndarray, np.ndarray]] = []  # a text has few of the terms
        for t, y in sample:
            if t and t.strip():
                own = terms(t)
                at = np.flatnonzero(own)
                rows.append((at.astype(np.uint16), own[at]))
                labels.append(y)
        self.labels = np.array(labels, dtype=np.float64)
        held = np.zeros(TERMS, dtype=np.int64)
        for at, _ in rows:
            held[at] += 1
        self.weights = np.log((1 + len(labels)) / (1 + held)).astype(np.float32) + 0.3
        # terms that no text has would only be zeros in the product, which is held four times
        use = np.flatnonzero(held)
        product = np.zeros((len(use), len(use)))
        for x in self._blocks(rows):
            part = x[:, use].astype(np.float64)
            product += part.T @ part
        values, vectors = np.linalg.eigh(product)
        del product
        leading = np.argsort(-values)[:DIMENSIONS]
        self.axes = np.zeros((TERMS, DIMENSIONS), dtype=np.float32)
        self.axes[use, : len(leading)] = vectors[:, leading]
        del vectors
        self.vectors = np.concatenate([np.empty((0, DIMENSIONS), dtype=np.float32), *map(self.project, self._blocks(rows))])

    def _blocks(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """Weighted terms of a few rows at a time."""
        for first in range(0, len(rows), 512):
            x = np.zeros((len(rows[first : first + 512]), TERMS), dtype=np.float32)
            for own, (at, value) in zip(x, rows[first : first + 512], strict=True):
                own[at] = value
            yield x * self.weights

    def project(self, weighted: np.ndarray) -> np.ndarray:
        y = weighted @ self.axes
        size = np.linalg.norm(y, axis=1, keepdims=True)
        return y / np.where(size > 0, size, 1)

    def scores(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        """Score of each text: the similarity-weighted share of label 1 among its neighbours."""
        out = np.full(len(texts), 0.5)
        n, k = len(self.labels), min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            if n:
                near = self.project(np.array([terms(t or "") for t in part]) * self.weights) @ self.vectors.T
                top = _nearest(near, k)
                weight = np.maximum(np.take_along_axis(near, top, axis=1).astype(np.float64), 0) ** POWER
                total = weight.sum(axis=1)
                share = (weight * self.labels[top]).sum(axis=1) / np.where(total > 0, total, 1)
                out[at : at + block] = np.where(total > 0, share, 0.5)
            for i, t in enumerate(part):
                if not t or not t.strip():
                    out[at + i] = 0.0
        return out.clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", limit: int = LABELLED) -> Space:
    """The space of at most ``limit`` labelled documents, made by one task: no text comes to the driver."""
    ship(docs.sparkSession)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(Space(rows_of(batches, "text", "label")))

    return unpacked(sample(docs, labels, label, limit, key=key, text=text).repartition(1).sortWithinPartitions("text", "label").mapInArrow(fitted, MODEL), Space([]))


def _scored(batches: Iterator[pa.RecordBatch], space) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", TEXT_BYTES):
        scores = space.value.scores(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), pa.array(scores, pa.float64())], [*batch.schema.names, "score"])


def score(docs: DataFrame, space: Space, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and ``score`` of every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(space)
    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lambda it: (b.select(["key", "score"]) for b in _scored(it, shared)), f"key {kind}, score double")
        .withColumnRenamed("key", key)
    )


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the fifth of rows held out are not read."""
    space = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, space).select(
        "doc_id",
        (remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= GOOD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores :data:`GOOD` or more."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.where(remainder("doc_id", 5) != 0)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _scored(batches, shared):
            yield batch.filter(pa.compute.greater_equal(batch.column(batch.num_columns - 1), GOOD)).select(list(range(batch.num_columns - 1)))

    return docs.mapInArrow(kept, docs.schema)
