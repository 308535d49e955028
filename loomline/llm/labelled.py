"""Bounded samples of labelled rows, for the trained operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The column in which a task returns a trained model.
MODEL = "model binary"


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of a sample one by one, so that its texts are never held all at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 16):
            part = batch.slice(at, 16)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def packed(model: Any) -> pa.RecordBatch:
    """A trained model as a row."""
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def unpacked(rows: DataFrame, default: Any) -> Any:
    """The model of the first row, ``default`` if there is none."""
    row = rows.first()
    return pickle.loads(bytes(row.model)) if row else default


def remainder(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``: the fold of a row."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, value: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` and ``label`` of at most ``limit`` labelled rows, the first by a hash of the key.

    Rows whose label is null take no part; ``value`` keeps one label only. Of labels that
    one key has several of, the smallest counts. The join broadcasts ``limit`` keys.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("label"))
    if value is not None:
        wanted = wanted.where(F.col("label") == value)
    wanted = wanted.orderBy(F.xxhash64(key), key).limit(limit).withColumnRenamed(key, "label_key")
    return docs.select(F.col(key).alias("own_key"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(wanted), F.col("own_key") == F.col("label_key")
    ).select("text", "label")


def unlabelled(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text`` of at most about ``limit`` documents, the first by a hash of the key."""
    keys = docs.select(F.col(key).alias("label_key")).where(F.col("label_key").isNotNull())
    keys = keys.orderBy(F.xxhash64("label_key"), "label_key").limit(limit).distinct()
    return docs.select(F.col(key).alias("own_key"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(keys), F.col("own_key") == F.col("label_key")
    ).select("text")
