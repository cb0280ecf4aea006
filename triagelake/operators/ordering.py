"""Positions in an order within groups of any size: no task holds a group.

Rows are dealt by ranges of (group, keys) and sorted inside their ranges, so a row's position is its place in its
range plus the group's rows in the ranges before.  A range is a contiguous piece of the order, so there are at most as
many (group, range) pairs as groups and ranges together; their counts are one small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import settled

#: Rows of a group up to which one task may order it; beyond, ranges of it are ordered.
TASK_ROWS = 1_000_000


def largest_group(df: DataFrame, *by: str) -> int:
    """Rows of the largest group: one aggregation that combines before its shuffle."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def positions(df: DataFrame, by: list[str], keys: list[Column], name: str) -> DataFrame:
    """df with each row's position (from 1) within its group in the order of keys, which should end on a unique one.

    The sorted rows are written once: the ranges are drawn by sampling, and both readers below must see the same ones.
    """
    dealt = df.repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys)
    rows = settled(dealt.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    pieces = rows.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], F.col("_range").alias("_piece"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_piece")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    out = rows.join(F.broadcast(pieces), same)  # groups and ranges together at most
    return out.withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).select(*df.columns, name)


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(group, value, average rank) of each value of a group; equal values, however many, share the mean of their positions."""
    at = positions(df.select(*by, value), by, [F.col(value)], "_pos")
    return at.groupBy(*by, value).agg(((F.min("_pos").cast("double") + F.max("_pos")) / 2).alias(name))
