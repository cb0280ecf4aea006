"""The published triage artifact and the bounded replay, from small per-period tables.

Selections run in Spark; what is assembled on the driver is one period's artifact, whose size the contract bounds.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import pseudonym
from triagelake.operators import backtest, store
from triagelake.params import OperatingPoint
from triagelake.plans import contract
from triagelake.session import settled

MAX_TXNS, MAX_ALERTS = 8, 3000
SCHEMA = "triage-artifact-1"


def bounded_transactions(alerts: DataFrame, txns: DataFrame, most: int = MAX_TXNS) -> DataFrame:
    """An alert's first transactions by (ts, txn_id) with pseudonyms, and how many there are in truth."""
    ids = alerts.select("alert_id", F.explode("contributing_txn_ids").alias("txn_id")).join(txns, "txn_id")
    w = Window.partitionBy("alert_id")
    out = ids.withColumns({"n": F.row_number().over(w.orderBy("ts", "txn_id")), "true_count": F.count("*").over(w)}).where(F.col("n") <= most)
    return out.select("alert_id", "n", "true_count", "txn_id", "ts", pseudonym(F.col("from_account")).alias("sender"), pseudonym(F.col("to_account")).alias("receiver"), "amount", "currency", "format")


def rule_table(alerts: DataFrame, day: str, universe: DataFrame) -> DataFrame:
    """Every rule with its alerts in the store and in one period, its supporting typologies and their live attempts."""
    rows = alerts.select(F.to_date("period_start").alias("d"), F.explode("fired_rules").alias("rule_id"))
    here = F.col("d") == F.lit(day).cast("date")
    volume = rows.groupBy("rule_id").agg(F.count("*").alias("store_alerts"), F.sum(here.cast("int")).alias("period_alerts"))
    return backtest.rule_support(universe).join(volume, "rule_id", "left").na.fill(0, ["store_alerts", "period_alerts"])


def funnel(prepared: DataFrame, universe: DataFrame, worked: DataFrame, point: OperatingPoint) -> DataFrame:
    """Live and surfaced attempts, and per rung the recovered ones among them."""
    u = universe.agg(F.count("*").alias("live"), F.coalesce(F.sum(F.col("surfaced").cast("int")), F.lit(0)).alias("surfaced"))
    got = worked.select("rung", F.explode("attempt_ids").alias("attempt_id")).distinct().join(universe.select("attempt_id"), "attempt_id").groupBy("rung").agg(F.count("*").alias("recovered"))
    rungs = worked.select("rung").distinct()
    return rungs.join(got, "rung", "left").na.fill(0).crossJoin(F.broadcast(u))


def canonical(value) -> bytes:
    """Sorted keys, no blanks, UTF-8, one line feed at the end."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode() + b"\n"


def digest(artifact: dict) -> str:
    return hashlib.sha256(canonical({k: v for k, v in artifact.items() if k != "artifact_sha256"})).hexdigest()


def sha256_file(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_json(path: str, value) -> None:
    with open(path, "wb") as f:
        f.write(canonical(value))


RUNGS = (*backtest.LADDER, "C1")


def _of_day(day: str):
    return lambda df: df.where(F.to_date("period_start") == F.lit(day).cast("date"))


def queue_table(alerts: DataFrame, txns: DataFrame, prepared: DataFrame, day: str, point: OperatingPoint, scores: DataFrame, contributions: DataFrame) -> DataFrame:
    """A period's whole queue, one row an alert, of any size: every rung's rank, evidence, contributions and first transactions as arrays."""
    of_day = _of_day(day)
    here = of_day(alerts)
    queue = of_day(backtest.scored_ranks(prepared, scores, point)).select(
        "alert_id", pseudonym(F.col("subject_account")).alias("subject"), "fired_rules", "first_txn_ts", F.round("alert_amount", 2).alias("alert_amount"), F.round("score", 6).alias("score"),
        "attempt_ids", "typologies", "is_true_positive", "unattributed_only", *[f"rank_{r}" for r in RUNGS],
    )
    ordered = lambda df, name, *columns: df.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    of_txn = ("n", "txn_id", "ts", "sender", "receiver", "amount", "currency", "format")
    first = bounded_transactions(here, txns)
    detail = first.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct(*of_txn))).alias("transactions"), F.max("true_count").alias("transaction_count"))
    why = ordered(contributions, "contributions", (-F.abs("contribution")).alias("k"), "feature", "value", "contribution")
    why = why.withColumn("contributions", F.transform("contributions", lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"), x["contribution"].alias("contribution"))))
    out = queue
    for part in (ordered(store.publishable_evidence(here), "evidence", "rule_id", "name", "value"), why, detail):
        out = out.join(part, "alert_id", "left")
    none = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("evidence", "contributions", "transactions")}
    return out.withColumns(none | {"transaction_count": F.coalesce("transaction_count", F.lit(0))})


def build_artifact(
    alerts: DataFrame, txns: DataFrame, prepared: DataFrame, labels: DataFrame, day: str, point: OperatingPoint, provenance: dict, scores: DataFrame, contributions: DataFrame, record: dict
) -> dict:
    """One period's artifact: its queue with every rung's ranks, evidence, contributions and transactions, and the run's blocks.

    scores cover the evaluation periods, contributions (alert_id, feature, value, contribution) the period's alerts;
    record is the run record.  At most MAX_ALERTS alerts come to the driver.
    """
    from triagelake.plans.record import evidence_block, result_block

    of_day = _of_day(day)
    here = of_day(alerts)
    queue = queue_table(alerts, txns, prepared, day, point, scores, contributions)
    rows = [r.asDict(recursive=True) for r in queue.orderBy("alert_id").limit(MAX_ALERTS + 1).collect()]
    if not rows:
        raise ValueError(f"no alert in {day}")
    if len(rows) > MAX_ALERTS:
        raise ValueError(f"more than {MAX_ALERTS} alerts in {day}")
    for row in rows:
        evidence: dict[str, dict] = {}
        for e in row["evidence"]:
            evidence.setdefault(e["rule_id"], {})[e["name"]] = e["value"]
        row |= {"evidence": evidence, "ranks": {r: row.pop(f"rank_{r}") for r in RUNGS}}
    plain = lambda df, key: [r.asDict(recursive=True) for r in df.orderBy(key).collect()]
    hits = sum(r["is_true_positive"] for r in rows)
    store_key = here.select("engine_version", "param_set_hash").first().asDict()
    out = {
        "artifact_schema": SCHEMA, "provenance": provenance | store_key | {"pipeline_run_id": hashlib.sha256(canonical({"schema": SCHEMA, "period": day, "provenance": provenance, **store_key})).hexdigest()},
        "period": {"start": day, "alerts": len(rows), "true_positives": hits, "base_rate": hits / len(rows)}, "operating_point": {"k": point.k, "evaluation_start": point.evaluation_start},
        "orderings": list(RUNGS), "quantities": {n: {"label": a, "unit": b} for n, (a, b) in store.QUANTITIES.items()}, "result": result_block(record, point), "evidence": evidence_block(record),
        "rules": plain(rule_table(alerts, day, backtest.attempt_universe(prepared, labels, point)), "rule_id"), "typologies": plain(backtest.typology_table(prepared, labels, day, point), "typology"),
        "period_attempts": plain(backtest.period_attempt_universe(prepared, labels, day), "attempt_id"), "queue": rows,
    }
    out = json.loads(canonical(out))
    out["artifact_sha256"] = digest(out)
    return out


def rows_of(artifact: dict) -> list[dict]:
    """The queue's rows, flat, for the desk's functions over a frame: ranks as rank_<rung>."""
    return [{k: v for k, v in row.items() if k != "ranks"} | {f"rank_{r}": n for r, n in row["ranks"].items()} for row in artifact["queue"]]


def admit(artifact: dict, pinned: str | None = None, approval: dict | None = None, require_approval: bool = True, limits: dict[str, contract.Bound] = contract.LIMITS) -> dict:
    """Returns the artifact if its schema, digest, pin, approval and every bound of the contract hold; raises otherwise."""
    if artifact.get("artifact_schema") != SCHEMA:
        raise ValueError("unknown artifact schema")
    if artifact.get("artifact_sha256") != digest(artifact):
        raise ValueError("artifact digest does not match its content")
    if pinned is not None and artifact["artifact_sha256"] != pinned:
        raise ValueError("artifact is not the pinned one")
    if require_approval and (not approval or approval.get("public_distribution_status") != "approved"):
        raise ValueError("artifact is not approved for distribution")
    if found := contract.violations(artifact, limits):
        raise ValueError(f"artifact is out of the contract's bounds: {'; '.join(found[:5])}")
    return artifact


# ---- replay


def replay_cases(txns: DataFrame, flagged: DataFrame) -> DataFrame:
    """(case_id, n, txn_id, ...): the bounded public cases, each ordered by (ts, txn_id).

    flagged holds the outcome's txn_ids.  escalation: first 16 of the earliest sender with 16 flagged payments;
    cash, mixed: first 8 flagged cash and 10 of the first 18 flagged payments if those span three rails;
    ach, ach-short, card: first 8, 5 and 8 clean payments of their rail.
    """
    marks = flagged.select("txn_id", F.lit(1).alias("flag")).distinct().hint("merge")  # grows with the ledger: no task may hold it whole
    rows = settled(txns.join(marks, "txn_id", "left").na.fill(0, ["flag"]))  # read by every case below
    bad, good = rows.where("flag = 1"), rows.where("flag = 0")
    order = ["ts", "txn_id"]
    first = bad.groupBy("from_account").agg(F.count("*").alias("c"), F.min(F.struct("ts", "txn_id")).alias("m")).where("c >= 16").orderBy("m", "from_account").limit(1)

    def take(case: str, df: DataFrame, most: int) -> DataFrame:
        top = df.orderBy(*order).limit(most)  # a bounded case
        return top.select(F.lit(case).alias("case_id"), F.row_number().over(Window.orderBy(*order)).alias("n"), "txn_id", "ts", "from_account", "to_account", "amount", "currency", "format")

    rails = bad.orderBy(*order).limit(18).agg(F.count_distinct("format").alias("rails"))
    mixed = bad.crossJoin(F.broadcast(rails)).where("rails >= 3").drop("rails")
    parts = [
        take("sim-escalation", bad.join(F.broadcast(first.select("from_account")), "from_account", "left_semi"), 16), take("sim-cash", bad.where("format = 'Cash'"), 8),
        take("sim-mixed", mixed, 10), take("sim-ach", good.where("format = 'ACH'"), 8), take("sim-ach-short", good.where("format = 'ACH'"), 5),
        take("sim-card", good.where("format = 'Credit Card'"), 8),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumns({"from_account": pseudonym(F.col("from_account")), "to_account": pseudonym(F.col("to_account"))})
