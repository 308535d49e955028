"""Near duplicates among documents by min-max hashing.

Of each document's shingles the least and the greatest hash under every permutation are
kept, so half as many evaluations give a signature, and bands of it are bucket keys.
Equal sets are put together before buckets are made; links are confirmed on full sets;
see :mod:`loomline.llm.similar` for how no link is lost without comparing all pairs.

With 24 bands of 4 values, two documents of similarity 0.85 share no band with a chance
of 2e-8, of 0.8 of 3e-6.

Defined results: a null, empty or blank text has no shingles, is linked with nothing and
is kept; repeated rows are one group; texts of a repeated id are documents of their own,
linked only if they are alike; a row whose id is null is kept and has no component; an
empty table gives an empty table. Key and text alone are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import shingles
from loomline.llm.shared import chunks, settled, ship, written
from loomline.llm.similar import clusters, small

BANDS, ROWS = 24, 4
TEXT_BYTES = 2 << 20


@lru_cache(maxsize=4)
def _hashing(bands: int, rows: int) -> shingles.MinMax:
    return shingles.MinMax(bands, rows)


def _texts_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have words, their sets one after another and the sets' starts."""
    own = [shingles.words(t) for t in texts]
    many = np.array([len(w) for w in own], dtype=np.int64)
    last = np.cumsum(many)
    used = np.flatnonzero(many)
    h = shingles.hashed([w for words in own for w in words])
    return used, *shingles.sets_of(h, (last - many)[used], last[used], size)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    hashing = _hashing(BANDS, ROWS)
    for batch in chunks(batches, "text", TEXT_BYTES):
        used, items, starts = _texts_sets(batch.column("text").to_pylist(), size)
        n = np.zeros(batch.num_rows, dtype=np.int64)
        n[used] = np.diff(np.append(starts, len(items)))
        keys, sigs = hashing.signed(items, starts)
        of = np.full(batch.num_rows, -1)
        of[used] = np.arange(len(used))
        at = pa.array(of, mask=of < 0)
        set_key = pa.array(shingles.set_keys(items, starts), pa.binary()).take(at)
        key = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64())).take(at)
        sig = pa.array([s.tobytes() for s in sigs], pa.binary()).take(at)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n), set_key, key, sig], ["doc_id", "version", "n", "set_key", "keys", "sig"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in chunks(batches, "text", TEXT_BYTES):
        used, items, starts = _texts_sets(batch.column("text").to_pylist(), size)
        out = pa.RecordBatch.from_arrays(
            [batch.column("id").take(pa.array(used)), batch.column("set_key").take(pa.array(used)), pa.array(shingles.set_keys(items, starts), pa.binary()), pa.array(shingles.parts(items, starts), pa.binary())],
            ["id", "set_key", "own_key", "items"],
        )
        out = out.filter(pa.compute.equal(out.column("set_key"), out.column("own_key"))).select(["id", "items"])
        ids = out.column("id").to_pylist()
        new = [i not in seen and not seen.add(i) for i in ids]
        yield out.filter(pa.array(new, pa.bool_()))


def _labelled(docs: DataFrame, size: int, percent: int, key: str, text: str) -> DataFrame:
    """doc_id, version (a hash of the text), n and component_id of each row."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    signed = written(own.mapInArrow(lambda it: _signed(it, size), "doc_id long, version long, n long, set_key binary, keys array<long>, sig binary"), "signed")
    # equal sets are one unit, numbered apart from doc_id: several texts may have one id
    units = signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "keys", "sig")])
    units = written(units.withColumn("id", F.monotonically_increasing_id()), "units")
    reps = units.select("set_key", "doc_id", "id")
    rows = written(signed.select("doc_id", "version", "n", "set_key"), "rows")
    settled(spark, signed)

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = written(reps.join(ids, "id", "left_semi"), "wanted")
        of = own.select("doc_id", "text").join(small(wanted), "doc_id").select("text", "id", "set_key")
        return of.mapInArrow(lambda it: _sets(it, size), "id long, items binary")

    found, links = clusters(units, sets_of, percent)
    labels = reps.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = written(labels.join(first, "component").select("set_key", "component_id"), "labels")
    settled(spark, units, found, links)
    with_words = rows.where("n > 0").join(labels, "set_key", "left").select("doc_id", "version", "n", "component_id")
    without = rows.where("n = 0").select("doc_id", "version", "n", F.col("doc_id").alias("component_id"))
    return with_words.union(without)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row: key, n_shingles, component_id, kept."""
    out = _labelled(docs, size, percent, key, text)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, without all but one of each group.

    The group's least id stays, of several texts of that id the one with the least hash.
    """
    rows = _labelled(docs, size, percent, key, text).where("n > 0 AND doc_id IS NOT NULL")
    rows = written(rows.groupBy("component_id", "doc_id", "version").count(), "versions")
    kept = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "version")).alias("kept"))
    rows = rows.join(kept, "component_id").withColumn("stays", F.struct("doc_id", "version") == F.col("kept"))
    rows = written(rows.where("NOT stays OR count > 1").select(F.col("doc_id").alias("gone_key"), F.col("version").alias("gone_version"), "stays"), "decided")
    gone, twice = rows.where("NOT stays").drop("stays"), rows.where("stays").drop("stays")
    version = F.xxhash64(docs[text].cast("string"))
    left = docs.join(small(gone), (docs[key] == F.col("gone_key")) & (version == F.col("gone_version")), "left_anti")
    if twice.isEmpty():
        return left
    twice = small(twice)
    same = (left[key] == F.col("gone_key")) & (F.xxhash64(left[text].cast("string")) == F.col("gone_version"))
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates([key, text]))
