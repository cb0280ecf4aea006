"""The alert store: collapse of rule rows to alerts, its files and its digest."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import alert_id
from triagelake.params import ENGINE, Parameters
from triagelake.sources import period_table


def build_alerts(rows: DataFrame, p: Parameters) -> DataFrame:
    """One alert for each (subject, period) on which a rule fired."""
    out = rows.groupBy("subject_account", "period").agg(
        F.array_sort(F.collect_set("rule_id")).alias("fired_rules"), F.array_sort(F.collect_list(F.struct("rule_id", "evidence"))).alias("rule_evidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("contributing_txn_ids")))).alias("contributing_txn_ids"),
    )
    start = F.col("period").cast("timestamp_ntz")
    end = F.date_add("period", 1).cast("timestamp_ntz")
    return out.select(
        alert_id(F.col("subject_account"), F.col("period"), F.col("fired_rules")).alias("alert_id"), "subject_account", start.alias("period_start"), end.alias("period_end"),
        "fired_rules", "rule_evidence", "contributing_txn_ids", end.alias("feature_cutoff_ts"), F.lit(ENGINE).alias("engine_version"), F.lit(p.digest()).alias("param_set_hash"),
    )


def period_index(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.to_date("period_start").alias("period")).agg(
        F.count("*").alias("n_alerts"), F.sum(F.size("fired_rules")).alias("n_rules"), F.sum(F.size("contributing_txn_ids")).alias("n_txns")
    )


def write_store(alerts: DataFrame, root: str, p: Parameters) -> str:
    """Replaces the store of this engine and parameter set: one folder a period."""
    path = f"{root}/{p.store_version()}"
    period_table.write(alerts.withColumn("period", F.to_date("period_start")), path, "alert_id")
    return path


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return period_table.read(spark, path).drop("period")


def digest_tree(alerts: DataFrame) -> DataFrame:
    """(level, period, prefix, digest, alerts): a Merkle tree of the store's content.

    Level 3 has the digest of the alerts of a period whose key begins with four given hex digits (the key is a hash of
    the alert id), level 2 those of two digits, level 1 a period and level 0 the store.  A node's digest is that of its
    parts' digests in order, so a row that is changed, moved to another period or doubled changes every node above it.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(alerts.columns)), {"ignoreNullFields": "false"}), 256)
    key = F.substring(F.md5("alert_id"), 1, 4)
    level = alerts.select(F.to_date("period_start").cast("string").alias("period"), key.alias("prefix"), F.lit("").alias("part"), row.alias("digest"), F.lit(1).cast("long").alias("alerts"))
    out = None
    for depth in (3, 2, 1, 0):
        if depth < 3:
            period, prefix = (F.col("period") if depth else F.lit("")), F.substring("prefix", 1, 2) if depth == 2 else F.lit("")
            level = level.select(period.alias("period"), prefix.alias("prefix"), F.col("prefix" if depth else "period").alias("part"), "digest", "alerts")
        parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: F.concat_ws(":", x["part"], x["digest"]))
        level = level.groupBy("period", "prefix").agg(F.sha2(F.array_join(parts, ","), 256).alias("digest"), F.sum("alerts").alias("alerts"))
        here = level.select(F.lit(depth).alias("level"), "period", "prefix", "digest", "alerts")
        out = here if out is None else out.unionByName(here)
    return out


def differing_ranges(a: DataFrame, b: DataFrame, level: int = 3) -> DataFrame:
    """(period, prefix, alerts_a, alerts_b) of the ranges of one level in which two digest trees differ."""
    side = lambda t, n: t.where(F.col("level") == level).select("period", "prefix", F.col("digest").alias(f"d_{n}"), F.col("alerts").alias(f"alerts_{n}"))
    both = side(a, "a").join(side(b, "b"), ["period", "prefix"], "full").where(~F.col("d_a").eqNullSafe(F.col("d_b")))
    return both.select("period", "prefix", F.coalesce("alerts_a", F.lit(0)).alias("alerts_a"), F.coalesce("alerts_b", F.lit(0)).alias("alerts_b"))


def store_digest(alerts: DataFrame) -> str:
    """Sixteen hex digits of the root of the store's digest tree. File names and the order of rows do not matter."""
    root = digest_tree(alerts).where("level = 0").first()
    return (root.digest if root else hashlib.sha256(b"").hexdigest())[:16]


def evidence(alerts: DataFrame) -> DataFrame:
    """Rule evidence of each alert: one row a rule, the JSON as stored."""
    return alerts.select("alert_id", F.explode("rule_evidence").alias("e")).select("alert_id", "e.rule_id", "e.evidence")


#: The quantities of a rule's evidence that may be published; parameters never are.
PUBLISHABLE = {
    "R1": ("count", "total"),
    "R2": ("pairs", "largest_pass_through"),
    "R3": ("counterparties", "total"),
    "R4": ("counterparties", "total"),
    "R5": ("count", "total"),
    "R6": ("count", "prior_count"),
    "R7": ("count", "total", "jurisdictions"),
    "R8": ("count", "own_mean", "peer_mean", "prior_periods"),
}


#: What a published quantity is, and its unit.
QUANTITIES = {
    "count": ("payments on the day", "payments"),
    "total": ("sum of those payments, currencies as they come", "amount"),
    "pairs": ("payments in and out that match", "pairs"),
    "largest_pass_through": ("largest payment in that went out again", "amount"),
    "counterparties": ("different counterparties in the window", "accounts"),
    "jurisdictions": ("different jurisdictions paid", "jurisdictions"),
    "prior_count": ("payments on the days looked back to", "payments"),
    "own_mean": ("the account's mean on its earlier active days", "payments a day"),
    "peer_mean": ("mean of the bank's accounts on the day", "payments a day"),
    "prior_periods": ("earlier days on which the account was active", "days"),
}


def described_evidence(alerts: DataFrame) -> DataFrame:
    """(alert_id, rule_id, name, value, label, unit): the allowed quantities with what they are."""
    rows = [(n, *about) for n, about in QUANTITIES.items()]
    return publishable_evidence(alerts).join(F.broadcast(alerts.sparkSession.createDataFrame(rows, "name string, label string, unit string")), "name").select("alert_id", "rule_id", "name", "value", "label", "unit")


def publishable_evidence(alerts: DataFrame) -> DataFrame:
    """(alert_id, rule_id, name, value) of the allowed quantities."""
    allowed = F.lit(None).cast("array<string>")
    for rule, names in PUBLISHABLE.items():
        allowed = F.when(F.col("rule_id") == rule, F.array(*[F.lit(n) for n in names])).otherwise(allowed)
    values = F.from_json("evidence", "map<string,string>")
    out = evidence(alerts).select("alert_id", "rule_id", F.explode(allowed).alias("name"), values.alias("v"))
    return out.select("alert_id", "rule_id", "name", F.col("v")[F.col("name")].cast("double").alias("value")).where("value is not null")
