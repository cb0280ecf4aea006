"""What each account does each day, kept as a table that grows by days; rules and features read it and not the ledger.

``activity`` has for each side of the payments (out: the account pays, in: it is paid), account and day the number of
payments c, of counterparties p, their sum s and largest x, and the number f of counterparties seen on that day for the
first time.  Distinct counterparties of any span of days up to one follow by adding f.

A stored table has two parts by day: the activity, and the counterparties first seen.  ``extend`` replaces the days from
its first one on, so that a day can be added or redone: it reads the ledger of those days and the counterparties seen
before, and writes only those days' folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDES = {"out": ("from", "to"), "in": ("to", "from")}


def by_party(txns: DataFrame) -> DataFrame:
    """(side, account, bank, party, day, c, s, x): the payments of an account with each counterparty on each day.

    Rows are dealt by (side, account, party), so what follows in an order of a party's days needs no further shuffle.
    """
    side = lambda n, own, other: F.struct(F.lit(n).alias("side"), F.col(f"{own}_account").alias("account"), F.col(f"{own}_bank").alias("bank"), F.col(f"{other}_account").alias("party"))
    both = F.array(*[side(n, own, other) for n, (own, other) in SIDES.items()])
    rows = txns.select(F.explode(both).alias("k"), F.col("period").alias("day"), "amount").select("k.*", "day", "amount")
    return rows.repartition("side", "account", "party").groupBy("side", "account", "party", "day").agg(
        F.min("bank").alias("bank"), F.count("*").alias("c"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(28,2)").alias("s"), F.max("amount").alias("x")
    )


def _activity(party: DataFrame, seen: DataFrame) -> DataFrame:
    """Activity of by-party rows, where seen (side, account, party, day) has each counterparty's first day."""
    daily = party.groupBy("side", "account", "day").agg(
        F.min("bank").alias("bank"), F.sum("c").alias("c"), F.count("*").alias("p"), F.sum("s").cast("decimal(28,2)").alias("s"), F.max("x").alias("x")
    )
    fresh = seen.groupBy("side", "account", "day").agg(F.count("*").alias("f"))
    return daily.join(fresh, ["side", "account", "day"], "left").select("side", "account", "bank", "day", "c", "p", "s", "x", F.coalesce("f", F.lit(0)).alias("f"))


def activity(txns: DataFrame) -> DataFrame:
    party = by_party(txns).withColumn("first", F.min("day").over(Window.partitionBy("side", "account", "party")))
    return party.groupBy("side", "account", "day").agg(
        F.min("bank").alias("bank"), F.sum("c").alias("c"), F.count("*").alias("p"), F.sum("s").cast("decimal(28,2)").alias("s"), F.max("x").alias("x"), F.sum((F.col("day") == F.col("first")).cast("long")).alias("f")
    ).select("side", "account", "bank", "day", "c", "p", "s", "x", "f")


def _write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.repartition("day", "account").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def build(txns: DataFrame, path: str) -> None:
    """Writes the table of a whole ledger."""
    party = by_party(txns)
    seen = party.groupBy("side", "account", "party").agg(F.min("day").alias("day"))
    for df, part in ((_activity(party, seen), "activity"), (seen, "seen")):
        df.repartition("day", "account").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("day").parquet(f"{path}/{part}")


def extend(spark: SparkSession, txns: DataFrame, path: str) -> None:
    """Replaces the stored days from the ledger's first day on by those of the ledger; a day not stored yet is added.

    Refuses a ledger that lacks a stored day after its first one: that day's first-seen counterparties would be stale.
    Killed halfway, it can be run again.
    """
    new = {r.period for r in txns.select("period").distinct().collect()}  # one row a day
    if not new:
        return
    kept = {r.day for r in spark.read.parquet(f"{path}/activity").select("day").distinct().collect()}
    if missing := {d for d in kept if d >= min(new)} - new:
        raise ValueError(f"the ledger lacks {min(missing)}, which is stored")
    party = by_party(txns)
    before = spark.read.parquet(f"{path}/seen").where(F.col("day") < F.lit(min(new))).select("side", "account", "party")
    seen = party.groupBy("side", "account", "party").agg(F.min("day").alias("day")).join(before, ["side", "account", "party"], "left_anti")
    _write(_activity(party, seen), f"{path}/activity")
    # a day without a new counterparty has no folder of its own; rows of days that are replaced go by a marker of none
    none = txns.select("period").distinct().select(F.lit("").alias("side"), F.lit("").alias("account"), F.lit("").alias("party"), F.col("period").alias("day"))
    _write(seen.select("side", "account", "party", "day").unionByName(none), f"{path}/seen")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/activity").select("side", "account", "bank", "day", "c", "p", "s", "x", "f")
