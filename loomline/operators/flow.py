"""Straight-line data flow: what reaches a statement from those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def before(by: str, *order: str):
    """The statements of one function before the present one."""
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def last_before(value: Column, when: Column, by: str, *order: str) -> Column:
    """``value`` of the last earlier statement for which ``when`` holds."""
    return F.last(F.when(when, value), ignorenulls=True).over(before(by, *order))


def next_edges(df: DataFrame, by: str, order: str) -> DataFrame:
    """Edges from each statement to the next of its function."""
    return df.withColumn("dst", F.lead(order).over(Window.partitionBy(by).orderBy(order))).where("dst IS NOT NULL")
