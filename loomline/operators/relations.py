"""Joins and aggregates over call, declaration and containment relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def suffixes(name: Column) -> Column:
    """All dotted suffixes of a qualified name, the name itself first."""
    parts = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def pattern_matches(calls: DataFrame, patterns: DataFrame, callee: str = "callee") -> DataFrame:
    """Calls joined with the ``pattern`` they match: ``a.b`` is the name or a dotted suffix of it,
    ``*.m`` its last segment of several, a name without a dot the whole name.

    Suffixes are exploded and joined by value, so no pattern is tried against every call.
    """
    name = F.col(callee)
    dotted = F.filter(suffixes(name), lambda s: s.contains(".") | (s == name))
    last = F.when(name.contains("."), F.array(F.concat(F.lit("*."), F.element_at(F.split(name, "\\."), -1)))).otherwise(F.array().cast("array<string>"))
    return calls.withColumn("pattern", F.explode(F.array_distinct(F.concat(dotted, last)))).join(patterns, "pattern")


def first_of_tiers(candidates: DataFrame, by: list[str], tier: str, target: str, most: int) -> DataFrame:
    """Of each group the candidates of its least tier, none if they are more than ``most``."""
    own = Window.partitionBy(*by)
    best = candidates.withColumn("_least", F.min(tier).over(own)).where(F.col(tier) == F.col("_least")).drop("_least")
    counted = best.groupBy(*by).agg(F.countDistinct(target).alias("_n")).where(F.col("_n") <= most).drop("_n")
    return best.join(counted, by, "left_semi").select(*by, tier, target).distinct()


def covers_all(pairs: DataFrame, owner: str, member: str, required: DataFrame) -> DataFrame:
    """Owners that have every required member (relational division by counts)."""
    wanted = required.select(member).distinct()
    total = wanted.agg(F.count("*").alias("_total"))
    counted = pairs.join(wanted, member, "left_semi").groupBy(owner).agg(F.countDistinct(member).alias("_n"))
    return counted.join(total, F.col("_n") == F.col("_total")).select(owner)


def agreed(df: DataFrame, by: str, value: str) -> DataFrame:
    """The one value that all rows of a group have, null where they differ."""
    low, high = F.min(value), F.max(value)
    return df.groupBy(by).agg(F.when(low == high, low).alias("agreed"))


def smallest(df: DataFrame, by: str, value: str, n: int, name: str) -> DataFrame:
    """The ``n`` least distinct values of each group, sorted, as text."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(value))
    kept = df.select(by, value).distinct().withColumn("_rank", rank).where(F.col("_rank") <= n)
    return kept.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda x: x.cast("string")), ",").alias(name))
