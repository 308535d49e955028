"""Approximate nearest neighbours by a permutation index.

A bounded sample gives the pivots. A vector is represented by its nearest pivots in
order; it is posted in the inverted files of the first few. A query visits the files of
its own nearest pivots; what they hold is ranked by the footrule distance of the two
orders, and the best ranked are compared exactly. Inner products are made distances by
one more coordinate (the largest norm squared less the own one, under a root), so vectors
of any length are searched rightly.

Each file is cut into shards of about :data:`SHARD` vectors by a hash of the id, so a file
that holds a third of all vectors is many tasks; a shard takes its queries one by one and
returns each one's nearest few. All rows are indexed; every query visits every shard of
its files.

Defined results: vectors that are null, zero, of another dimension than most or that hold
null or non-finite numbers take no part; equal scores go to the smaller id; repeated
rows of an id are one vector, the first by value; fewer candidates than asked for are all
returned; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.llm.shared import ship, written

#: Pivots (the sample), length of the orders, files a vector is posted in, files a query visits.
PIVOTS, ORDER, POSTED, VISITED = 128, 32, 6, 72
#: Candidates of a shard that are compared exactly, per query; vectors of a shard.
RERANKED, SHARD = 2000, 8192


def orders(x: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest pivots of each vector, nearest first, ties to the first pivot."""
    distance = (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)
    return np.argsort(distance, axis=1, kind="stable")[:, :n].astype(np.int16)


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.append(x, np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))[:, None], axis=1)


def _posted(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, most: float, lift: bool, files: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.array(batch.column("vector").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(batch.num_rows, -1)
        own = orders(_lifted(x, most) if lift else np.append(x, np.zeros((len(x), 1)), axis=1), pivots, ORDER)
        k = min(files, own.shape[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("vector"), pa.array(list(own.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(own[:, :k].astype(np.int32)), pa.list_(pa.int32()))],
            ["id", "vector", "order", "files"],
        )


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.array(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(column), -1)


def _searched(queries: pa.Table, shard: pa.Table, top: int, pivots: int, reranked: int) -> pa.Table:
    out: list[list] = [[], [], []]
    if queries.num_rows and shard.num_rows:
        ids = shard.column("id").to_numpy()
        by_id = np.argsort(ids)
        ids, x = ids[by_id], _matrix(shard.column("vector"), np.float64)[by_id]
        order = _matrix(shard.column("order"), np.int64)[by_id]
        places = np.full((len(ids), pivots), order.shape[1], dtype=np.int16)
        np.put_along_axis(places, order, np.broadcast_to(np.arange(order.shape[1], dtype=np.int16), order.shape).copy(), axis=1)
        places = np.ascontiguousarray(places.T)
        q_ids, q, q_order = queries.column("id").to_numpy(), _matrix(queries.column("vector"), np.float64), _matrix(queries.column("order"), np.int64)
        few = len(ids) > reranked
        for i in range(len(q_ids)):
            near = np.arange(len(ids))
            if few:
                footrule = np.abs(places[q_order[i]] - np.arange(q_order.shape[1], dtype=np.int16)[:, None]).sum(axis=0, dtype=np.int32)
                near = np.sort(np.argpartition(footrule, reranked)[:reranked])
            near = near[ids[near] != q_ids[i]]
            score = (x[near] * q[i]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:top]
            out[0].extend([q_ids[i]] * len(best))
            out[1].extend(ids[near][best].tolist())
            out[2].extend(score[best].tolist())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (doubles) of the vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = rows.where(~bad & F.exists("vector", lambda v: v != 0))
    most = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (most.n if most else 0)).groupBy("id").agg(F.min("vector").alias("vector"))


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, pivots: int = PIVOTS, posted: int = POSTED, visited: int = VISITED, reranked: int = RERANKED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each query among ``vectors``.

    Both tables have ``id`` and ``vector`` as :func:`usable` gives them.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = written(vectors, "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    most = vectors.agg(F.max(norm)).first()[0]
    sample = [r.vector for r in vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).collect()]
    schema = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], schema)
    table = _lifted(np.array(sample, dtype=np.float64), most)
    held = len(sample)
    kinds = "id long, vector array<double>, `order` array<int>, files array<int>"
    hot = vectors.mapInArrow(lambda it: _posted(it, table, most, True, posted), kinds)
    posting = hot.select("id", "vector", "order", F.explode("files").alias("file"))
    sizes = written(posting, "postings")
    # shards for each file by its own size, so that a file of any size is cut
    cuts = sizes.groupBy("file").count().select("file", F.ceil(F.col("count") / SHARD).cast("int").alias("cuts"))
    cuts = {r.file: max(1, r.cuts) for r in cuts.collect()}  # one number for each pivot
    n_cuts = F.element_at(F.create_map(*[F.lit(x) for f, c in cuts.items() for x in (f, c)]), F.col("file"))
    index = sizes.withColumn("shard", F.pmod(F.xxhash64("id"), n_cuts).cast("int"))
    asked = queries.mapInArrow(lambda it: _posted(it, table, most, False, visited), kinds).select("id", "vector", "order", F.explode("files").alias("file"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.coalesce(n_cuts, F.lit(1)) - 1)))
    found = (
        asked.groupBy("file", "shard")
        .cogroup(index.groupBy("file", "shard"))
        .applyInArrow(lambda a, b: _searched(a, b, top, held, reranked), "query_id long, vec_id long, score double")
        .distinct()
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def every_twentieth(vectors: DataFrame) -> DataFrame:
    """The search for every row whose id is divisible by 20, among all rows."""
    own = written(usable(vectors), "usable")
    return search(own, own.where("id % 20 = 0"))
