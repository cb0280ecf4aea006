"""Rows of text files numbered in the order of the files, without a pass through Python or one task.

A split of a file is read by one task, in order.  So a row's number is its place in its split plus the rows of all
splits before it, and the splits' counts are a table of one row for each split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLIT = ("_file", "_start")


def with_split(rows: DataFrame) -> DataFrame:
    """rows of a file source with _file, _start (their split) and _at, which ascends within it."""
    return rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")
    )


def before(per_split: DataFrame, *counts: str) -> DataFrame:
    """Each split's counts summed over the splits before it; per_split has one row a split."""
    w = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    return per_split.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts})


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows of a file source with their number in the files, from 0."""
    marked = with_split(rows)
    splits = before(marked.groupBy(*SPLIT).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first")), "_rows")
    out = marked.join(splits, list(SPLIT))
    return out.withColumn(name, F.col("_rows") + F.col("_at") - F.col("_first")).drop(*SPLIT, "_at", "_rows", "_first")
