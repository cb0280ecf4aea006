"""Queries of the review desk, as functions over artifact tables and case rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RAILS = ("ACH", "Cash", "Cheque", "Credit Card")
ORDERINGS = ("B0", "B1", "B2", "B3", "C1")
MAX_NODES = 18


def case_list(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("n_txns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


def case_detail(cases: DataFrame, case_id: str) -> DataFrame:
    if not re.fullmatch(r"sim-[a-z0-9-]{3,64}", case_id):
        raise ValueError("malformed case id")
    return cases.where(F.col("case_id") == case_id)


def timeline(cases: DataFrame, case_id: str, rail: str | None = None, limit: int = 18) -> DataFrame:
    """The case's payments in order: first the rail filter, then the limit."""
    if not 1 <= limit <= 18 or rail is not None and rail not in RAILS:
        raise ValueError("limit or rail out of bounds")
    rows = case_detail(cases, case_id)
    return (rows if rail is None else rows.where(F.col("format") == rail)).orderBy("n").limit(limit)


def case_evidence(cases: DataFrame) -> DataFrame:
    """(case_id, kind, statement): what a case's replay is, and the bound of every statement about it."""
    n = F.concat(F.lit("A fixed replay of "), F.count("*").cast("string"), F.lit(" synthetic transactions."))
    own = cases.groupBy("case_id").agg(n.alias("statement")).select("case_id", F.lit("replay").alias("kind"), "statement")
    bound = cases.select("case_id").distinct().select("case_id", F.lit("boundary").alias("kind"), F.lit("Scores and explanations are computed beforehand; reading trains and stores nothing.").alias("statement"))
    return own.unionByName(bound)


def provenance(artifact: dict) -> dict:
    """Where the artifact's data comes from, with the artifact's own digest."""
    own = artifact["provenance"]
    return own | {"version": own.get("dataset_version"), "retrieved": own.get("retrieved_at"), "slice_sha256": artifact["artifact_sha256"], "label": "realistic synthetic banking data"}


def methodology(artifact: dict) -> dict:
    """How the queue came about: versions, operating point, orderings and what the gate decided."""
    own = artifact["provenance"]
    return {
        "engine_version": own.get("engine_version"), "param_set_hash": own.get("param_set_hash"), "operating_point": artifact["operating_point"], "orderings": artifact["orderings"],
        "gate": artifact["result"]["gate"], "evaluation_periods": artifact["result"]["evaluation_periods"],
    }


def period_view(artifact: dict) -> dict:
    """The period with what is needed to read its queue: operating point, orderings, result, rules, typologies, attempts."""
    return {k: artifact[k] for k in ("period", "operating_point", "orderings", "result", "rules", "typologies", "period_attempts")}


def evidence_view(artifact: dict) -> dict:
    """The measured run by its parts, and the rung and depth it was measured against."""
    return {"reference_rung": artifact["result"]["gate"]["reference_rung"], "k": artifact["result"]["k"], "evidence": artifact["evidence"]}


def topology(cases: DataFrame) -> DataFrame:
    """Edges among a case's first 18 parties in order of appearance, with their payments."""
    ends = cases.select("case_id", "n", F.posexplode(F.array("from_account", "to_account")).alias("side", "party"))
    seen = ends.groupBy("case_id", "party").agg(F.min(F.col("n") * 2 + F.col("side")).alias("seen"))
    kept = seen.withColumn("node", F.row_number().over(Window.partitionBy("case_id").orderBy("seen"))).where(F.col("node") <= MAX_NODES)
    a = kept.select("case_id", F.col("party").alias("from_account"), F.col("node").alias("from_node"))
    b = kept.select("case_id", F.col("party").alias("to_account"), F.col("node").alias("to_node"))
    return cases.join(a, ["case_id", "from_account"]).join(b, ["case_id", "to_account"]).groupBy("case_id", "from_node", "to_node").agg(
        F.count("*").alias("payments"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount")
    )


def queue(ranked: DataFrame, ordering: str, k: int) -> DataFrame:
    """A period's whole queue in an ordering, with the cut line."""
    if ordering not in ORDERINGS:
        raise ValueError("unknown ordering")
    return ranked.withColumn("position", F.col(f"rank_{ordering}")).withColumn("worked", F.col("position") <= k)


def alert_view(ranked: DataFrame, alert_id: str, ordering: str = "C1") -> DataFrame:
    if not re.fullmatch(r"\d{20}", alert_id):
        raise ValueError("malformed alert id")
    return ranked.where(F.col("alert_id") == alert_id).withColumn("position", F.col(f"rank_{ordering}"))


def capacity_depth(hours: float, minutes_each: float, alerts: int) -> int:
    """How many alerts the hours cover: at least one, at most all."""
    return max(1, min(int(hours * 60 // minutes_each), alerts))


def capacity(alerts_of_period: DataFrame, hours: float, minutes_each: float) -> DataFrame:
    """(period, alerts, depth): the depth that the hours cover in each period."""
    asked = F.lit(int(hours * 60 // minutes_each))
    return alerts_of_period.select("period", F.col("n_alerts").alias("alerts"), F.greatest(F.lit(1), F.least(asked, F.col("n_alerts"))).alias("depth"))


def coverage(ranked: DataFrame, rank: str, at: int) -> DataFrame:
    """Per typology: attempts surfaced, those found down to a depth, and the deepest first find."""
    pairs = ranked.select("period_start", F.col(rank).alias("pos"), F.explode(F.arrays_zip("attempt_ids")).alias("z"), "typologies").select("period_start", "pos", F.col("z.attempt_ids").alias("attempt_id"), "typologies")
    first = pairs.groupBy("period_start", "attempt_id").agg(F.min("pos").alias("pos"), F.min_by("typologies", "pos").alias("typologies"))
    each = first.select("period_start", "attempt_id", "pos", F.explode("typologies").alias("typology"))
    return each.groupBy("period_start", "typology").agg(F.count("*").alias("surfaced"), F.sum((F.col("pos") <= at).cast("int")).alias("recovered"), F.max("pos").alias("deepest"))


def loses_coverage_first(cov: DataFrame) -> DataFrame:
    """Per period the typology whose deepest find lies deepest; ties by name."""
    w = Window.partitionBy("period_start").orderBy(F.col("deepest").desc(), F.col("typology"))
    return cov.withColumn("r", F.row_number().over(w)).where("r = 1").select("period_start", "typology", "deepest")


def queue_view(ranked: DataFrame, rank: str, typology: str | None = None, unattributed: bool = False, dispositions: DataFrame | None = None, disposition: str | None = None) -> DataFrame:
    """A filtered view of a queue; positions stay those of the whole queue.

    dispositions (alert_id, at, disposition) count by an alert's latest row.
    """
    out = ranked.withColumn("position", F.col(rank))
    if typology is not None:
        out = out.where(F.array_contains("typologies", typology))
    if unattributed:
        out = out.where("unattributed_only")
    if dispositions is not None:
        latest = dispositions.groupBy("alert_id").agg(F.max_by("disposition", "at").alias("disposition"))
        out = out.join(latest, "alert_id", "left")
        if disposition is not None:
            out = out.where(F.col("disposition") == disposition)
    return out


def best_and_worst(volume: DataFrame) -> DataFrame:
    """Periods with the most and the fewest freed alerts, and how many lose by the change."""
    key = F.struct("alerts_freed", "period_start")
    known = volume.where("alerts_freed is not null")
    return known.agg(
        F.max_by("period_start", F.struct("alerts_freed", (-F.unix_timestamp("period_start")).alias("t"))).alias("best"), F.min_by("period_start", key).alias("worst"),
        F.coalesce(F.sum((F.col("alerts_freed") < 0).cast("int")), F.lit(0)).alias("negative"),
    )
