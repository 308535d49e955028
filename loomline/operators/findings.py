"""The life of findings: best of several, ids, history, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row of each group, the first by ``order``."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def numbered_ids(df: DataFrame, parts: list[Column], order: list[str]) -> DataFrame:
    """``finding_id``: a digest of what a finding says, with -2, -3 ... for its repeats."""
    base = F.md5(F.concat_ws("\u0001", *parts))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(*order))
    out = df.withColumn("_base", base).withColumn("_n", n)
    return out.withColumn("finding_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_n").cast("string")))).drop("_base", "_n")


def recorded(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """History after a run: findings that are new, still there or gone."""
    a, b = before.select(key).distinct().withColumn("_a", F.lit(1)), now.select(key).distinct().withColumn("_b", F.lit(1))
    status = F.when(F.col("_b").isNull(), "fixed").when(F.col("_a").isNull(), "new").otherwise("open")
    return a.join(b, key, "full").select(key, status.alias("status"))


def digest(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """One digest a group that doesn't depend on the order of its rows."""
    row = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))
    return rows.groupBy(by).agg(F.md5(F.array_join(F.sort_array(F.collect_list(row)), "")).alias("digest"))
