"""Daily counts of a stream: closed days come out once, rows within the watermark count, later ones do not."""

import datetime as dt

from triagelake.streaming import daily_counts

SHAPE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_late_rows_of_a_stream(spark, tmp_path):
    source, out, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))

    def arrive(*rows):
        """Rows come, and the stream catches up; a second run lets the watermark of the first take effect."""
        spark.createDataFrame([(i, ts, u, "purchase", v, "{}") for i, ts, u, v in rows], SHAPE).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            stream = daily_counts(spark.readStream.schema(SHAPE).parquet(source), "1 day")
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)

    def closed():
        return sorted((str(r.day), r.user_id, r.n, r.total) for r in spark.read.schema("day date, user_id long, n long, total double").parquet(out).collect())

    arrive((1, at(1, 3), 7, 1.5), (2, at(1, 23), 7, 2.25), (3, at(2, 1), 7, 1.0), (4, at(1, 5), 8, 4.0))
    assert closed() == []  # no day is closed yet
    arrive((5, at(1, 9), 7, 0.25), (6, at(3, 1), 8, 9.0))  # the first day's row is late, within the watermark
    assert closed() == [("2024-01-01", 7, 3, 4.0), ("2024-01-01", 8, 1, 4.0)]
    arrive((7, at(1, 10), 7, 100.0), (8, at(2, 20), 7, 3.0), (9, at(5, 0), 9, 1.0))  # too late for the first day, in time for the second
    assert closed() == [("2024-01-01", 7, 3, 4.0), ("2024-01-01", 8, 1, 4.0), ("2024-01-02", 7, 2, 4.0), ("2024-01-03", 8, 1, 9.0)]
    batch = daily_counts(spark.read.parquet(source)).where("day <= '2024-01-03'").collect()
    # a table has no late rows: the one that came too late for the stream counts
    assert sorted((str(r.day), r.user_id, r.n, r.total) for r in batch) == [("2024-01-01", 7, 4, 104.0), ("2024-01-01", 8, 1, 4.0), ("2024-01-02", 7, 2, 4.0), ("2024-01-03", 8, 1, 9.0)]
