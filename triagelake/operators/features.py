"""Point-in-time alert features, and the gate that proves they read nothing from the future.

All periods are built at once: daily aggregates per account with running windows that stop before the day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.functions import cents, day_number, draw
from triagelake.operators import daily
from triagelake.params import RULES, Parameters
from triagelake.sources import period_table

VERSION = "features-1"
KEYS = ("alert_id", "subject_account", "period_start", "feature_cutoff_ts")
_SIDES = tuple(daily.SIDES)
_PARTS = ("count", "counterparties", "amount_total", "amount_max", "amount_mean")
FEATURES = (
    *[f"{span}_{side}_{part}" for span in ("history", "period") for side in _SIDES for part in _PARTS],
    "period_hour_spread", "period_whole_dollar_share", "period_corridor_format_share", "period_cross_bank_share", "period_currencies",
    "history_active_periods", "fired_rule_count", "contributing_transactions", *[f"fired_{r.lower()}" for r in RULES],
    "period_over_history_rate", "period_counterparty_ratio", "period_over_history_amount",
)


def _activity(days_table: DataFrame, days: DataFrame, side: str) -> DataFrame:
    """(account, day) of the asked days with the side's history and period figures, from the daily activity.

    Distinct counterparties do not add up over days, so each counterparty counts on the day it is first seen.
    """
    known = days_table.where(F.col("side") == side).select("account", "day", "c", "p", "s", "x", "f", F.lit(False).alias("asked"))
    asked = days.select("account", "day", *[F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("c", "p", "s", "x", "f")], F.lit(True).alias("asked"))
    rows = known.unionByName(asked).groupBy("account", "day").agg(*[F.max(c).alias(c) for c in ("c", "p", "s", "x", "f", "asked")])
    w = Window.partitionBy("account").orderBy(day_number("day")).rangeBetween(Window.unboundedPreceding, -1)
    mean = lambda s, n: F.coalesce(F.try_divide(s.cast("double"), n), F.lit(0.0))
    h = {"count": F.coalesce(F.sum("c").over(w), F.lit(0)), "counterparties": F.coalesce(F.sum("f").over(w), F.lit(0)), "amount_total": F.sum("s").over(w), "amount_max": F.max("x").over(w)}
    out = {f"history_{side}_{k}": v for k, v in h.items()} | {
        f"period_{side}_count": F.coalesce("c", F.lit(0)), f"period_{side}_counterparties": F.coalesce("p", F.lit(0)), f"period_{side}_amount_total": F.col("s"), f"period_{side}_amount_max": F.col("x"),
    }
    if side == "out":
        out["history_active_periods"] = F.count("c").over(w)
    rows = rows.select("account", "day", "asked", *[v.alias(k) for k, v in out.items()]).where("asked").drop("asked")
    for span in ("history", "period"):
        total = f"{span}_{side}_amount_total"
        rows = rows.withColumns({
            f"{span}_{side}_amount_mean": mean(F.col(total), F.col(f"{span}_{side}_count")), total: F.coalesce(F.col(total).cast("double"), F.lit(0.0)),
            f"{span}_{side}_amount_max": F.coalesce(f"{span}_{side}_amount_max", F.lit(0.0)),
        })
    return rows


def _spread(n: Column) -> Column:
    """Sample standard deviation of whole numbers, 0 for fewer than two, from exact sums: it does not depend on how rows are dealt."""
    size = F.count(n)
    squares = size * F.sum(n * n) - F.sum(n) * F.sum(n)
    return F.when(size > 1, F.sqrt(squares.cast("double") / (size * (size - 1)))).otherwise(0.0)


def _shape(txns: DataFrame, p: Parameters) -> DataFrame:
    share = lambda cond: F.avg(cond.cast("double"))
    return txns.groupBy(F.col("from_account").alias("account"), F.col("period").alias("day")).agg(
        _spread(F.hour("ts").cast("long")).alias("period_hour_spread"), share(cents("amount") % 100 == 0).alias("period_whole_dollar_share"),
        share(F.col("format").isin(*p.r7_formats)).alias("period_corridor_format_share"), share(F.col("from_bank") != F.col("to_bank")).alias("period_cross_bank_share"),
        F.count_distinct("currency").alias("period_currencies"),
    )


def build_features(alerts: DataFrame, txns: DataFrame, p: Parameters, days_table: DataFrame | None = None) -> DataFrame:
    """The feature table: keys, 39 features and the version. Refuses frames that carry outcomes.

    days_table is the ledger's daily activity if it is at hand; else it is made here.
    """
    for c in (*alerts.columns, *txns.columns):
        if "aunder" in c.lower():
            raise ValueError(f"outcome column among the inputs: {c}")
    base = alerts.select(*KEYS, "fired_rules", "contributing_txn_ids", F.col("subject_account").alias("account"), F.to_date("period_start").alias("day"))
    days = base.select("account", "day").distinct()
    out = base
    table = daily.activity(txns) if days_table is None else days_table
    for part in (*[_activity(table, days, side) for side in _SIDES], _shape(txns, p)):
        out = out.join(part, ["account", "day"], "left")
    out = out.withColumns(
        {"fired_rule_count": F.size("fired_rules"), "contributing_transactions": F.size("contributing_txn_ids")}
        | {f"fired_{r.lower()}": F.array_contains("fired_rules", r).cast("int") for r in RULES}
    )
    out = out.na.fill(0)
    n, hc, ap = F.col("period_out_count"), F.col("history_out_count"), F.col("history_active_periods")
    out = out.withColumns({
        "period_over_history_rate": n / F.greatest(hc / F.greatest(ap, F.lit(1)), F.lit(0.001)),
        "period_counterparty_ratio": F.col("period_out_counterparties") / F.greatest(n, F.lit(1)),
        "period_over_history_amount": F.col("period_out_amount_total") / F.greatest("history_out_amount_total", F.lit(1.0)),
    })
    return out.select(*KEYS, *FEATURES, F.lit(VERSION).alias("feature_version"))


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (*KEYS, "feature_version")]


def write_features(built: DataFrame, path: str) -> None:
    """The feature table as Parquet, a folder a period, so that walk-forward reads only the periods it needs."""
    period_table.write(built.withColumn("period", F.to_date("period_start")), path, "alert_id")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """A written feature table; refuses one of another version."""
    out = period_table.read(spark, path).drop("period")
    if not out.where(F.col("feature_version") != VERSION).isEmpty():
        raise ValueError(f"the table at {path} is not of version {VERSION}")
    return out


def leakage_sample(alerts: DataFrame, sample: int = 200, seed: int = 1) -> DataFrame:
    """The alerts that the gate rebuilds: the first by a seeded hash."""
    return alerts.orderBy(draw(F.lit(str(seed)), F.col("alert_id")), "alert_id").limit(sample)


def leakage_report(
    alerts: DataFrame, txns: DataFrame, p: Parameters, sample: int = 200, seed: int = 1, build: Callable[[DataFrame, DataFrame, Parameters], DataFrame] = build_features
) -> DataFrame:
    """(feature, differing): features of sampled alerts that change when the future is cut off. Empty: no leak.

    The sample is a stated size, drawn by hash.  Only transactions of its accounts are read; each sampled cutoff day gets
    its own trimmed copy of them by one join.
    """
    found = leakage_sample(alerts, sample, seed)
    picked = alerts.sparkSession.createDataFrame(found.collect(), found.schema)  # at most sample rows, read many times below
    asked = F.broadcast(picked.select("subject_account").distinct())  # at most the sample's size
    mine = lambda c: txns.join(asked, F.col(c) == F.col("subject_account"), "left_semi")
    txns = mine("from_account").unionByName(mine("to_account")).dropDuplicates(["txn_id"])
    whole = build(picked, txns, p)
    names = feature_columns(whole)
    cuts = picked.select("feature_cutoff_ts").distinct()
    # a ledger and alerts for each cutoff, told apart by a prefix on the account names
    tag = lambda c: F.concat_ws("#", F.col("feature_cutoff_ts").cast("string"), F.col(c))
    trimmed = txns.join(F.broadcast(cuts), F.col("ts") < F.col("feature_cutoff_ts")).withColumns({"from_account": tag("from_account"), "to_account": tag("to_account")}).drop("feature_cutoff_ts")
    again = build(picked.withColumn("subject_account", tag("subject_account")), trimmed, p)
    a = whole.select("alert_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("alert_id", names, "feature", "full")
    b = again.select("alert_id", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("alert_id", names, "feature", "trimmed")
    return a.join(b, ["alert_id", "feature"]).where(~F.col("full").eqNullSafe(F.col("trimmed"))).groupBy("feature").agg(F.count("*").alias("differing"))
