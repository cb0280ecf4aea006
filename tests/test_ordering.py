"""Positions and average ranks in ranges against windows: ties that span ranges, one hot group, null groups, no task with a group."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from triagelake.operators import backtest as B
from triagelake.operators import ordering
from triagelake.params import OperatingPoint


@pytest.fixture(params=["4", "13"])
def dealt(spark, request):
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", old[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])


def sample(spark, n=3000):
    r = np.random.default_rng(1)
    groups = r.choice(["hot", "b", "c", None], n, p=[0.7, 0.1, 0.1, 0.1])
    return spark.createDataFrame([(str(g) if g is not None else None, int(v), k) for k, (g, v) in enumerate(zip(groups, r.integers(0, 5, n)))], "g string, v int, id long").repartition(5)


def test_positions_are_row_numbers_and_no_task_has_the_hot_group(spark, dealt):
    df = sample(spark)
    keys = [F.col("v").desc(), F.col("id").asc()]
    got = ordering.positions(df, ["g"], keys, "pos")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy(*keys)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    ranges = df.repartitionByRange("g", *keys).where("g = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 0.6 * df.where("g = 'hot'").count()


def test_average_ranks_over_ties_that_span_ranges(spark, dealt):
    df = sample(spark).where("g is not null")
    got = {(r.g, r.v): r.avg for r in ordering.average_ranks(df, ["g"], "v", "avg").collect()}
    rows = [(r.g, r.v) for r in df.collect()]
    for (g, v), avg in got.items():
        below, same = sum(x == g and y < v for x, y in rows), sum((x, y) == (g, v) for x, y in rows)
        assert avg == below + (same + 1) / 2
    assert len(got) == 15


def test_ranks_and_spearman_are_the_same_in_ranges(spark, dealt):
    r = np.random.default_rng(4)
    rows = []
    for k in range(400):
        day = dt.datetime(2024, 1, 1 + (k % 10 == 0))
        rows.append((f"{k:020d}", day, day + dt.timedelta(hours=int(r.integers(0, 3))), float(r.integers(0, 4)), [["R1", "R2"][int(r.integers(0, 2))]], bool(r.random() < 0.3), float(r.integers(0, 3))))
    shape = "alert_id string, period_start timestamp_ntz, first_txn_ts timestamp_ntz, alert_amount double, fired_rules array<string>, is_true_positive boolean, score double"
    prepared = spark.createDataFrame(rows, shape)
    point = OperatingPoint(k=5, evaluation_start="2024-01-01")
    rungs = (*B.LADDER, "C1")
    one, two = B.ranks(prepared, point, rungs), B.ranks(prepared, point, rungs, task_rows=10)
    names = ["alert_id", *[f"rank_{x}" for x in rungs]]
    assert sorted(map(tuple, one.select(*names).collect())) == sorted(map(tuple, two.select(*names).collect()))
    plan = two._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    for t in (10**6, 10):  # one side constant: no correlation
        assert [r.rho for r in B.spearman(prepared.withColumn("score", F.lit(1.0)), "alert_amount", "score", None, t).collect()] == [None]
    for by in ("period_start", None):
        a, b = (B.spearman(prepared, "alert_amount", "score", by, t).collect() for t in (10**6, 10))
        assert sorted((str(x[:-1]), round(x.rho, 9)) for x in a) == sorted((str(x[:-1]), round(x.rho, 9)) for x in b) and len(a) == (2 if by else 1)
