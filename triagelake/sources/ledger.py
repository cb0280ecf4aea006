"""Ledgers: from the transactions CSV, and from an event table.

A ledger has txn_id, ts, from_account, to_account, from_bank, to_bank, amount, currency, format, period.
The outcome column of the CSV is never selected here; only the label readers read it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triagelake.params import TYPOLOGIES, Window
from triagelake.sources import period_table
from triagelake.sources.text_rows import SPLIT, before, numbered, with_split

#: The CSV's header, and our names for its columns by position.
CSV_HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
CSV_NAMES = ("ts", "from_bank", "from_name", "to_bank", "to_name", "received", "received_currency", "paid", "paid_currency", "format", "flag")
LEDGER = ("txn_id", "ts", "from_account", "to_account", "from_bank", "to_bank", "amount", "currency", "format", "period")


def check_header(spark: SparkSession, path: str, expected: str = CSV_HEADER) -> None:
    """Refuses a path of which any file's first line is not the expected header, a byte-order mark aside, and one without a line.

    The first lines are those of each file's first split; only whether one differs comes back.
    """
    lines = with_split(spark.read.text(path)).where("_start = 0")
    first = lines.groupBy("_file").agg(F.min_by("value", "_at").alias("line"))
    line = F.rtrim(F.ltrim("line", F.lit("\ufeff")), F.lit("\r"))
    got = first.agg(F.count("*").alias("files"), F.min(F.when(line != expected, F.col("_file"))).alias("other")).first()
    if not got.files or got.other is not None:
        raise ValueError(f"unexpected header in {got.other or path}")


def check_rows(spark: SparkSession, path: str) -> None:
    """Refuses a file with a row of more or fewer fields than the header: one pass over all columns."""
    fields = [T.StructField(n, T.StringType()) for n in (*CSV_NAMES, "_bad")]
    rows = spark.read.csv(path, header=True, schema=T.StructType(fields), mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    # the second half never holds; it has the reader parse all columns, which is what marks a row
    wrong = rows.where(F.col("_bad").isNotNull() | (F.concat_ws("", *CSV_NAMES) == "\0"))
    if not wrong.isEmpty():
        raise ValueError(f"a row of {path} has another number of fields than the header")


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with txn_id, the row's number in the file. What is not selected is not parsed."""
    check_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in CSV_NAMES])
    return numbered(spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=True), "txn_id")


def load_transactions(spark: SparkSession, path: str, window: Window | None = None) -> DataFrame:
    """The ledger of a transactions CSV without self transfers, optionally cut to a window.

    Refuses another header.  The outcome column is never selected, so the reader leaves it out.
    """
    rows = _raw(spark, path).drop("flag").select(
        "txn_id", F.to_timestamp_ntz("ts", F.lit("yyyy/MM/dd HH:mm")).alias("ts"),
        F.concat_ws("|", "from_bank", "from_name").alias("from_account"), F.concat_ws("|", "to_bank", "to_name").alias("to_account"),
        F.col("from_bank").cast("long").alias("from_bank"), F.col("to_bank").cast("long").alias("to_bank"),
        F.col("received").cast("double").alias("amount"), F.col("received_currency").alias("currency"), "format",
    )
    rows = rows.where("from_account <> to_account").withColumn("period", F.to_date("ts"))
    return rows.where(F.col("period").between(window.start, window.end)) if window else rows


def load_bank_jurisdictions(spark: SparkSession, path: str) -> DataFrame:
    """(bank, jurisdiction) of an accounts CSV: the country in "<Country> Bank #n", domestic otherwise."""
    rows = spark.read.csv(path, header=True)
    name = F.regexp_replace("Bank Name", r" #\d+$", "")
    country = F.nullif(F.regexp_extract(name, r"^(\w+) Bank$", 1), F.lit(""))
    rows = rows.select(F.col("Bank ID").cast("long").alias("bank"), F.coalesce(country, F.lit("domestic")).alias("jurisdiction"))
    return rows.groupBy("bank").agg(F.min("jurisdiction").alias("jurisdiction"))


def ingest(spark: SparkSession, path: str, out: str, window: Window | None = None) -> DataFrame:
    """Checks a transactions CSV, writes its ledger as Parquet by period and reads it back: later reads are pruned."""
    check_rows(spark, path)
    period_table.write(load_transactions(spark, path, window), out, "txn_id")
    return period_table.read(spark, out).select(*LEDGER)


def parse_patterns(spark: SparkSession, path: str) -> DataFrame:
    """(key, attempt_id, typology) of the patterns file: one row a transaction line inside a block.

    Blocks are told by running counts of their first and last lines: within a split of the file by a window, and over
    splits by sums of one row a split, so no task reads the whole file.
    """
    lines = with_split(spark.read.text(path)).withColumn("line", F.rtrim("value", F.lit("\r")))
    begin, end = F.col("line").startswith("BEGIN "), F.col("line").startswith("END ")
    name = F.when(begin, F.trim(F.regexp_extract("line", r" - ([^:]*)", 1)))
    lines = lines.select(*SPLIT, "_at", "line", begin.cast("int").alias("b"), end.cast("int").alias("e"), name.alias("name"))
    per_split = lines.groupBy(*SPLIT).agg(F.sum("b").alias("begun_before"), F.sum("e").alias("ended_before"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("_at"))).alias("last_name"))
    earlier = W.orderBy(*SPLIT).rowsBetween(W.unboundedPreceding, -1)
    splits = before(per_split.withColumn("name_before", F.last("last_name", True).over(earlier)).drop("last_name"), "begun_before", "ended_before")
    w = W.partitionBy(*SPLIT).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    run = lines.select(*SPLIT, "line", "b", "e", F.sum("b").over(w).alias("begun"), F.sum("e").over(w).alias("ended"), F.last("name", True).over(w).alias("typology"))
    run = run.join(splits, list(SPLIT)).withColumns({
        "begun": F.col("begun") + F.col("begun_before"), "ended": F.col("ended") + F.col("ended_before"), "typology": F.coalesce("typology", "name_before"),
    })
    body = run.where("b = 0 and e = 0 and begun > ended and trim(line) <> ''")
    return body.select(F.regexp_replace("line", ",[^,]*$", "").alias("key"), (F.col("begun") - 1).alias("attempt_id"), "typology")


def load_labels(spark: SparkSession, transactions: str, patterns: str) -> DataFrame:
    """(txn_id, period, attempt_id, typology) of the flagged rows of the whole file, self transfers included.

    Refuses a patterns file of which a line matches no transaction.
    """
    flagged = _raw(spark, transactions).where("flag = '1'").select(
        "txn_id", F.to_date(F.to_timestamp_ntz("ts", F.lit("yyyy/MM/dd HH:mm"))).alias("period"), F.concat_ws(",", *CSV_NAMES[:10]).alias("key")
    )
    known = parse_patterns(spark, patterns)
    labels = flagged.join(known, "key", "left")
    matched, expected = labels.where("attempt_id is not null").count(), known.count()
    if matched != expected:
        raise ValueError(f"{expected} pattern lines match {matched} transactions")
    return labels.select("txn_id", "period", "attempt_id", "typology")


# ---- the bundled event table as a ledger


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events read as a ledger: users pay the counterparties in props."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("_k", F.get_json_object("props", "$.k").cast("long"))  # read out once a row
    k = F.col("_k")
    bank = lambda c: F.pmod(c, F.lit(25))
    account = lambda c: F.concat_ws("|", bank(c).cast("string"), c.cast("string"))
    user = F.col("user_id")
    rows = e.where(user != k).select(
        F.col("event_id").alias("txn_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), account(user).alias("from_account"), account(k).alias("to_account"),
        bank(user).alias("from_bank"), bank(k).alias("to_bank"), F.col("value").alias("amount"),
        F.when(F.col("event_id") % 4 == 0, "Euro").otherwise("US Dollar").alias("currency"), F.col("event_type").alias("format"),
    )
    return rows.withColumn("period", F.to_date("ts"))


def events_jurisdictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("long").alias("bank"), F.col("r_name").alias("jurisdiction"))


def events_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome labels of the event ledger; read by the backtest only."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'error' and value >= 100")
    k = F.get_json_object("props", "$.k").cast("long")
    names = F.array(*[F.lit(t) for t in TYPOLOGIES])
    return e.select(
        F.col("event_id").alias("txn_id"), F.to_date("ts").alias("period"), F.when(k % 3 != 0, k).alias("attempt_id"),
        F.when(k % 3 != 0, F.element_at(names, (k % 8 + 1).cast("int"))).alias("typology"),
    )
