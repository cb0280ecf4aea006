"""The CSV, accounts and patterns readers, label matching and the store, on files written here."""

import pytest
from pyspark.sql import functions as F

from triagelake.operators import store
from triagelake.params import Parameters, Window
from triagelake.sources import ledger

ROWS = [
    ("2022/09/01 00:10", "1", "AAA", "2", "BBB", "100.00", "US Dollar", "101.00", "US Dollar", "ACH", "1"),
    ("2022/09/01 00:20", "1", "CCC", "1", "CCC", "200.00", "US Dollar", "200.00", "US Dollar", "Reinvestment", "0"),
    ("2022/09/20 00:30", "1", "DDD", "2", "EEE", "300.00", "Euro", "300.00", "Euro", "ACH", "1"),
    ("2022/09/02 23:59", "7", "AAA", "9", "BBB", "1.50", "Euro", "1.50", "Euro", "Cash", "0"),
    ("2022/09/02 10:00", "1", "FFF", "1", "FFF", "5.00", "Euro", "5.00", "Euro", "Cash", "1"),
]


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "trans.csv"
    path.write_text("\n".join([ledger.CSV_HEADER, *map(",".join, ROWS)]) + "\n", encoding="utf-8")
    return str(path)


def test_ledger_leaves_out_self_transfers_the_outcome_and_other_days(spark, csv):
    got = ledger.load_transactions(spark, csv, Window())
    assert tuple(got.columns) == ledger.LEDGER
    rows = sorted(tuple(r) for r in got.select("txn_id", "from_account", "to_account", "from_bank", "amount", "currency", "format").collect())
    assert rows == [(0, "1|AAA", "2|BBB", 1, 100.0, "US Dollar", "ACH"), (3, "7|AAA", "9|BBB", 7, 1.5, "Euro", "Cash")]
    assert ledger.load_transactions(spark, csv).count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "flag" not in plan and "Python" not in plan and "ExistingRDD" not in plan


def test_rows_are_numbered_over_splits_and_files(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        path = tmp_path / "many.csv"
        path.write_text("\n".join([ledger.CSV_HEADER, *(f"2022/09/01 00:10,1,A{i},2,B{i},{i}.00,Euro,{i}.00,Euro,ACH,0" for i in range(200))]) + "\n")
        got = ledger.load_transactions(spark, str(path))
        assert got.rdd.getNumPartitions() > 4
        assert {r.from_account: r.txn_id for r in got.collect()} == {f"1|A{i}": i for i in range(200)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("header", [ledger.CSV_HEADER.replace("Account", "Acct", 1), "", ledger.CSV_HEADER + ",More"])
def test_another_header_is_refused(spark, tmp_path, header):
    path = tmp_path / "bad.csv"
    path.write_text(header + "\n" + ",".join(ROWS[0]) + "\n")
    with pytest.raises(ValueError, match="header"):
        ledger.load_transactions(spark, str(path))


@pytest.mark.parametrize("size", ["134217728", "64"])
def test_every_file_of_a_folder_must_have_the_header(spark, tmp_path, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        folder = tmp_path / "many"
        folder.mkdir()
        (folder / "a.csv").write_text(ledger.CSV_HEADER + "\n" + ",".join(ROWS[0]) + "\n")
        (folder / "b.csv").write_text("\ufeff" + ledger.CSV_HEADER + "\r\n" + ",".join(ROWS[2]) + "\r\n", encoding="utf-8")
        assert ledger.load_transactions(spark, str(folder)).count() == 2
        names = ledger.CSV_HEADER.split(",")
        names[5], names[7] = names[7], names[5]  # paid before received
        (folder / "c.csv").write_text(",".join(names) + "\n" + ",".join(ROWS[3]) + "\n")
        with pytest.raises(ValueError, match="header in .*c.csv"):
            ledger.load_transactions(spark, str(folder))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_byte_order_mark_is_taken_and_short_rows_are_refused(spark, tmp_path):
    path = tmp_path / "bom.csv"
    path.write_text("﻿" + ledger.CSV_HEADER + "\n" + ",".join(ROWS[0]) + "\n", encoding="utf-8")
    assert ledger.load_transactions(spark, str(path)).count() == 1
    short = tmp_path / "short.csv"
    short.write_text(ledger.CSV_HEADER + "\n" + ",".join(ROWS[0][:9]) + "\n")
    with pytest.raises(ValueError, match="fields"):
        ledger.ingest(spark, str(short), str(tmp_path / "out"))


def test_ingest_writes_the_ledger_by_period(spark, csv, tmp_path):
    got = ledger.ingest(spark, csv, str(tmp_path / "ledger"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ledger.load_transactions(spark, csv).collect()))


def test_jurisdictions(spark, tmp_path):
    path = tmp_path / "accounts.csv"
    path.write_text("Bank Name,Bank ID,Account Number\nFrance Bank #12,1,a\nFirst National #3,2,b\nFrance Bank #12,1,c\nSavings Bank of X #4,3,d\n")
    got = {r.bank: r.jurisdiction for r in ledger.load_bank_jurisdictions(spark, str(path)).collect()}
    assert got == {1: "France", 2: "domestic", 3: "domestic"}


def pattern_text(rows):
    line = ",".join
    return f"""BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 2-degree
{line(rows[0])}
END LAUNDERING ATTEMPT - FAN-OUT

BEGIN LAUNDERING ATTEMPT - CYCLE
{line(rows[2])}
END LAUNDERING ATTEMPT - CYCLE
"""


@pytest.mark.parametrize("size", ["134217728", "64"])
@pytest.mark.parametrize("ends", ["\n", "\r\n"])
def test_patterns_and_labels(spark, csv, tmp_path, size, ends):
    path = tmp_path / "patterns.txt"
    path.write_bytes(pattern_text(ROWS).replace("\n", ends).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = sorted(map(tuple, ledger.parse_patterns(spark, str(path)).collect()))
        assert got == sorted([(",".join(ROWS[0][:10]), 0, "FAN-OUT"), (",".join(ROWS[2][:10]), 1, "CYCLE")])
        labels = sorted(((r.txn_id, str(r.period), r.attempt_id, r.typology) for r in ledger.load_labels(spark, csv, str(path)).collect()))
        # the flagged self transfer has no attempt and stays
        assert labels == [(0, "2022-09-01", 0, "FAN-OUT"), (2, "2022-09-20", 1, "CYCLE"), (4, "2022-09-02", None, None)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_pattern_line_without_a_transaction_is_refused(spark, csv, tmp_path):
    path = tmp_path / "patterns.txt"
    path.write_text(pattern_text([ROWS[0], ROWS[1], (*ROWS[2][:5], "999.00", *ROWS[2][6:])]))
    with pytest.raises(ValueError, match="match"):
        ledger.load_labels(spark, csv, str(path))


def sample_alerts(spark):
    rows = spark.createDataFrame(
        [("1|A", "2022-09-01", "R1", '{"count":2}', [1, 2]), ("1|A", "2022-09-01", "R5", '{"count":2}', [2, 3]), ("2|B", "2022-09-02", "R2", '{"pairs":1}', [9])],
        "subject_account string, period string, rule_id string, evidence string, contributing_txn_ids array<long>",
    ).withColumn("period", F.to_date("period"))
    return store.build_alerts(rows, Parameters())


def test_store_round_trip_and_digest(spark, tmp_path):
    alerts = sample_alerts(spark)
    path = store.write_store(alerts, str(tmp_path), Parameters())
    assert path.endswith(Parameters().store_version())
    back = store.read_store(spark, path)
    assert sorted(map(str, back.select(*alerts.columns).collect())) == sorted(map(str, alerts.collect()))
    assert store.store_digest(back) == store.store_digest(alerts.repartition(3)) == store.store_digest(alerts.orderBy(F.desc("alert_id")))
    assert store.store_digest(alerts.limit(1)) != store.store_digest(alerts)
    store.write_store(alerts.where("subject_account = '1|A'"), str(tmp_path), Parameters())  # replaces
    assert store.read_store(spark, path).count() == 1


def test_overrides_are_typed_and_names_are_checked():
    p = Parameters().override(["r1_threshold=500", "r1_min_count=3", "r7_formats=Cash, Wire", "r3_window_periods=5"])
    assert (p.r1_threshold, p.r1_min_count, p.r7_formats, p.r3_window_periods) == (500.0, 3, ("Cash", "Wire"), 5)
    with pytest.raises(ValueError, match="no such parameter"):
        Parameters().override(["r9_nothing=1"])


def test_digests_follow_the_values():
    p = Parameters()
    assert p.digest() == Parameters().digest() != p.replace(r1_band=0.2).digest()
    assert len(p.digest()) == 16 and p.store_version() == f"triagelake-1_{p.digest()}"
