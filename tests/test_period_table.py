"""Whole replacement of period tables, periods written by many tasks, and the digest tree of a store."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from triagelake.operators import store
from triagelake.params import Parameters
from triagelake.sources import period_table


def rows(spark, n, days=3, mark=0):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.when(F.col("id") % 10 < 8, 0).otherwise(F.col("id") % days).cast("int"))
    return spark.range(n).select("id", (F.col("id") * 2 + mark).alias("v"), day.alias("period"))


def test_a_period_is_written_by_many_tasks_and_pruned_when_read(spark, tmp_path):
    path = str(tmp_path / "t")
    df = rows(spark, 2000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions of a small table would be joined
    try:
        period_table.write(df, path, "id", rows_a_task=200)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, period_table.read(spark, path).select(*df.columns).collect())) == sorted(map(tuple, df.collect()))
    files = glob.glob(f"{period_table.current(spark, path)}/period=2024-01-01/*.parquet")
    sizes = [spark.read.parquet(f).count() for f in files]
    assert len(sizes) > 2 and max(sizes) < 0.7 * sum(sizes)  # four shuffle partitions in tests
    plan = period_table.read(spark, path).where("period = date'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan


def test_a_write_that_dies_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    period_table.write(rows(spark, 100), path, "id")
    old = sorted(map(tuple, period_table.read(spark, path).collect()))
    started = period_table.read(spark, path)  # a reader of the old table
    dies = rows(spark, 100, mark=1).withColumn("v", F.when(F.col("id") == 57, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        period_table.write(dies, path, "id")
    assert sorted(map(tuple, period_table.read(spark, path).collect())) == old
    period_table.write(rows(spark, 50, mark=1), path, "id")
    assert period_table.read(spark, path).count() == 50 and started.count() == 100
    for k in range(3):
        period_table.write(rows(spark, 10 + k), path, "id")
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 2 and period_table.read(spark, path).count() == 12
    with pytest.raises(ValueError, match="no table"):
        period_table.read(spark, str(tmp_path / "none"))


def sample(spark, n=300):
    made = spark.range(n).select(
        F.concat(F.lit("1|"), F.col("id")).alias("subject_account"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("period"),
        F.lit("R1").alias("rule_id"), F.lit('{"count":2}').alias("evidence"), F.array("id").alias("contributing_txn_ids"),
    )
    return store.build_alerts(made, Parameters())


def test_digest_tree_names_the_range_of_a_changed_a_moved_and_a_doubled_row(spark):
    alerts = sample(spark).cache()
    tree = store.digest_tree(alerts)
    assert {r.level: (r.n, r.alerts) for r in tree.groupBy("level").agg(F.count("*").alias("n"), F.sum("alerts").alias("alerts")).collect()}[0] == (1, 300)
    assert store.differing_ranges(tree, store.digest_tree(alerts.repartition(7))).count() == 0
    picked = alerts.orderBy("alert_id").first()
    one = F.col("alert_id") == picked.alert_id
    prefix, day = spark.range(1).select(F.substring(F.md5(F.lit(picked.alert_id)), 1, 4)).first()[0], str(picked.period_start.date())
    changed = alerts.withColumn("contributing_txn_ids", F.when(one, F.array(F.lit(999).cast("long"))).otherwise(F.col("contributing_txn_ids")))
    moved = alerts.withColumn("period_start", F.when(one, F.col("period_start") + F.expr("interval 1 day")).otherwise(F.col("period_start")))
    doubled = alerts.unionByName(alerts.where(one))
    found = lambda other, level=3: sorted((r.period, r.prefix, r.alerts_a, r.alerts_b) for r in store.differing_ranges(tree, store.digest_tree(other), level).collect())
    held = next(r.alerts for r in tree.where("level = 3").collect() if (r.period, r.prefix) == (day, prefix))
    assert found(changed) == [(day, prefix, held, held)] and found(doubled) == [(day, prefix, held, held + 1)]
    assert found(changed, 2) == [(day, prefix[:2], *found(changed, 2)[0][2:])] and [x[0] for x in found(changed, 1)] == [day] and len(found(changed, 0)) == 1
    to = str(picked.period_start.date().replace(day=picked.period_start.day + 1))
    assert sorted({x[0] for x in found(moved)}) == [day, to] and {x[1] for x in found(moved)} == {prefix}
    assert len({store.store_digest(x) for x in (alerts, changed, moved, doubled)}) == 4 and store.store_digest(alerts.limit(0)) == store.store_digest(alerts.limit(0))
    alerts.unpersist()
