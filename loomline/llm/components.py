"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's greater (or smaller) neighbours are hung on the least."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the least node that it reaches, for all nodes of ``edges``.

    Nothing but a count and a checksum comes to the driver. Neighbours of one node are
    never collected: minima are aggregated and joined back, so a node with very many
    neighbours is spread by adaptive skew joins. Each round is written to the shared
    folder, so lost executors cost no earlier round. Loops and repeated edges are fine.
    """
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        after = written(_star(_star(now, True), False), "edges")
        new = _mark(after)
        discard(now)
        now = after
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
