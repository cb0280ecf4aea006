"""Streaming ingest, beyond the batch engine: daily counts per account with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, user_id, n, total) of an event stream or table; closed days come out once the watermark passes."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    ).select(F.to_date("w.start").alias("day"), "user_id", "n", "total")
