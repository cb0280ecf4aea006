"""The daily activity table: growth by days against a rebuild, days that are redone, refusals, and what reads it."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import daily, rules
from triagelake.operators import features as FE
from triagelake.operators import store
from triagelake.params import FIXTURE_PARAMS

SHAPE = "txn_id long, ts timestamp_ntz, from_account string, to_account string, from_bank long, to_bank long, amount double, currency string, format string, period date"


def ledger(spark, seed=1, n=400, first=0):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b = r.choice(12, 2, replace=False)
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=int(r.integers(0, 9)), hours=int(r.integers(0, 24)))
        rows.append((first + k, ts, f"{a % 3}|{a}", f"{b % 3}|{b}", int(a % 3), int(b % 3), float(r.integers(1, 20000)) / 100, "US Dollar", "purchase", ts.date()))
    return spark.createDataFrame(rows, SHAPE)


def rows_of(df):
    return sorted(map(str, df.select("side", "account", "bank", "day", "c", "p", "s", "x", "f").collect()))


def test_a_table_that_grows_by_days_is_that_of_a_rebuild(spark, tmp_path):
    txns, path = ledger(spark), str(tmp_path / "d")
    upto = lambda a, b: txns.where(F.col("period").between(f"2024-01-{a:02d}", f"2024-01-{b:02d}"))
    daily.build(upto(1, 4), path)
    assert rows_of(daily.read(spark, path)) == rows_of(daily.activity(upto(1, 4)))
    for a, b in ((5, 5), (6, 8), (6, 9), (9, 9)):  # days are added, and redone
        daily.extend(spark, upto(a, b), path)
        assert rows_of(daily.read(spark, path)) == rows_of(daily.activity(upto(1, max(b, 8 if a > 5 else b))))
    other = upto(1, 7).unionByName(ledger(spark, 7, 200, 1000).where("period >= '2024-01-08'"))  # the last two days are corrected
    daily.extend(spark, other.where("period >= '2024-01-08'"), path)
    assert rows_of(daily.read(spark, path)) == rows_of(daily.activity(other))
    before = rows_of(daily.read(spark, path))
    with pytest.raises(ValueError, match="2024-01-05"):
        daily.extend(spark, upto(4, 4), path)
    daily.extend(spark, upto(20, 21), path)  # nothing
    assert rows_of(daily.read(spark, path)) == before


def test_an_extension_reads_no_activity_of_earlier_days(spark, tmp_path):
    txns, path = ledger(spark), str(tmp_path / "d")
    daily.build(txns.where("period < '2024-01-06'"), path)
    kept = {f: f.stat().st_mtime_ns for f in (tmp_path / "d").rglob("*.parquet")}
    daily.extend(spark, txns.where("period >= '2024-01-06'"), path)
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in kept.items())


def test_rules_and_features_are_the_same_from_the_table(spark, tmp_path):
    txns, path = ledger(spark), str(tmp_path / "d")
    daily.build(txns, path)
    table, juris = daily.read(spark, path), spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "bank long, jurisdiction string")
    a, b = (rules.run_rules(txns, juris, FIXTURE_PARAMS, t) for t in (None, table))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    alerts = store.build_alerts(a, FIXTURE_PARAMS)
    x, y = (FE.build_features(alerts, txns, FIXTURE_PARAMS, t) for t in (None, table))
    assert sorted(map(str, x.collect())) == sorted(map(str, y.collect())) and x.count() > 20
