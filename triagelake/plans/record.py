"""The run record of a backtest, and the two blocks of the artifact that are read from it.

Metrics are Spark frames of one row for each rung, period or typology; the record gathers them as plain values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators import backtest as B
from triagelake.operators import resample
from triagelake.params import OperatingPoint
from triagelake.session import settled

RUNGS = (*B.LADDER, "C1")
#: Importances that are carried, and the least rank correlation of a stable order.
MAX_IMPORTANCE, STABLE = 15, 0.70


@dataclass
class Metrics:
    """The frames of a run; volume and the lifts compare the scored order with the ladder's strongest rung."""

    reference: str
    pooled: DataFrame
    per_period: DataFrame
    lift: DataFrame
    recall: DataFrame
    unattributed: DataFrame
    volume: DataFrame
    precision_intervals: DataFrame
    recall_intervals: DataFrame
    lift_intervals: dict[str, DataFrame]


def metrics(prepared: DataFrame, labels: DataFrame, scores: DataFrame, point: OperatingPoint, samples: int = 1000) -> Metrics:
    """Every metric of the ladder and of the scored order C1."""
    worked = settled(B.worked_queue(prepared, point).unionByName(B.scored_queue(prepared, scores, point)))  # at most K for each period and rung
    pooled, per_period = B.precision_pooled(worked), B.precision_per_period(worked)
    best = B.reference_rung(pooled).first()
    if best is None:
        raise ValueError("no alert in the evaluation periods")
    universe = B.attempt_universe(prepared, labels, point)
    return Metrics(
        best.rung, pooled, per_period, B.lift(pooled).where("rung = 'C1'"), B.typology_recall(universe, worked), B.unattributed(prepared, worked, point),
        B.volume_reduction(B.scored_ranks(prepared, scores, point), worked, "C1", best.rung, point),
        resample.bootstrap_mean(worked, "rung", ["period_start", "queue_position"], "is_true_positive", samples, point.seed),
        resample.bootstrap_mean(B.recall_outcomes(universe, worked, "C1"), "typology", ["attempt_id"], "recovered", samples, point.seed),
        {r: resample.bootstrap_lift(per_period, "C1", r, samples, point.seed) for r in B.LADDER},
    )


def _rows(df: DataFrame, *order: str) -> list[dict]:
    """A small frame's rows as plain values, days as text."""
    days = {c: F.col(c).cast("date").cast("string") for c, t in df.dtypes if t in ("date", "timestamp_ntz", "timestamp")}
    return [r.asDict(recursive=True) for r in df.withColumns(days).orderBy(*order).collect()]


def run_record(m: Metrics, point: OperatingPoint, store: dict, model: dict, importance: list[tuple[str, float]], stability: DataFrame) -> dict:
    """What a run leaves behind: the store and model it is about, and every metric with its interval."""
    return {
        **store, **model, "k": point.k, "evaluation_start": point.evaluation_start, "reference_rung": m.reference,
        "pooled": _rows(m.pooled, "rung"), "per_period": _rows(m.per_period, "period_start", "rung"), "lift": _rows(m.lift, "over"),
        "precision_intervals": {r["rung"]: [r["low"], r["high"]] for r in _rows(m.precision_intervals, "rung")},
        "lift_intervals": {over: [r["low"], r["high"]] for over, df in m.lift_intervals.items() for r in _rows(df, "low")},
        "typology_recall": _rows(m.recall, "typology", "rung"), "recall_intervals": {r["typology"]: [r["low"], r["high"]] for r in _rows(m.recall_intervals, "typology")},
        "unattributed": _rows(m.unattributed, "rung"), "volume_reduction": _rows(m.volume, "period_start"), "volume_reduction_pooled": B.pooled_reduction(m.volume, point).first()[0],
        "contribution_split": _rows(B.contribution_split(m.pooled), "base_tp")[0], "rank_stability": _rows(stability, "period_start"),
        "importance": [{"feature": f, "gain": g} for f, g in importance],
    }


def result_block(record: dict, point: OperatingPoint) -> dict:
    """The comparison as it was measured: the gate's two tests, and each rung's pooled precision with its interval."""
    over = record["reference_rung"]
    lift = next(r["lift"] for r in record["lift"] if r["over"] == over)
    interval = record["lift_intervals"][over]
    passed = B.gate(lift, interval[0] if interval[0] is not None else 0.0, point)
    pooled = {r["rung"]: r for r in record["pooled"]}
    periods = {r: sum(x["rung"] == r for x in record["per_period"]) for r in pooled}
    measured = [{"ordering": r, "periods": periods[r], **{c: pooled[r][c] for c in ("worked", "true_positives", "precision")}, "interval": record["precision_intervals"][r]} for r in RUNGS if r in pooled]
    gate = {"reference_rung": over, "threshold": point.gate, "lift": lift, "interval": interval, "met": passed["point_passed"], **passed, "promoted": False}
    return {"gate": gate, "measured": measured, "evaluation_periods": len({r["period_start"] for r in record["per_period"]}), "k": record["k"]}


def _by_rung(rows: list[dict], value: str) -> dict:
    return {r["rung"]: r[value] for r in sorted(rows, key=lambda r: RUNGS.index(r["rung"]))}


def evidence_block(record: dict) -> dict:
    """The measured run by attempt, typology, period and model, each beside the figure it must be read against."""
    over = record["reference_rung"]
    kinds: dict[str, list[dict]] = {}
    for r in record["typology_recall"]:
        kinds.setdefault(r["typology"], []).append(r)
    days: dict[str, list[dict]] = {}
    for r in record["per_period"]:
        days.setdefault(r["period_start"], []).append(r)
    top = {t: next(r for r in rows if r["rung"] == "C1") for t, rows in kinds.items()}
    live, surfaced = (sum(r[c] for r in top.values()) for c in ("attempts", "surfaced"))
    reached = {r: sum(x["recovered"] for rows in kinds.values() for x in rows if x["rung"] == r) for r in RUNGS}
    own = {d: next(r for r in rows if r["rung"] == over) for d, rows in days.items()}
    return {
        "funnel": {"attempts_live": live, "attempts_surfaced": surfaced, "lost_before_ordering": live - surfaced, "attempts_reached": reached},
        "typology_detail": [
            {"typology": t, "attempts_live": top[t]["attempts"], "attempts_surfaced": top[t]["surfaced"], "reached": _by_rung(kinds[t], "recovered"), "recall_of_live": top[t]["recall"],
             "recall_of_surfaced": top[t]["recall_of_surfaced"], "interval": record["recall_intervals"].get(t)} for t in sorted(kinds)
        ],
        "unattributed": {"alerts_in_population": record["unattributed"][0]["population"], "reached": _by_rung(record["unattributed"], "reached")} if record["unattributed"] else {},
        "per_period": [
            {"period_start": d, "alerts": own[d]["population"], "worked": own[d]["worked"], "coverage": own[d]["worked"] / own[d]["population"],
             "true_positives": _by_rung(days[d], "true_positives"), "precision": _by_rung(days[d], "precision")} for d in sorted(days)
        ],
        "volume_reduction": {"reference_rung": over, "pooled": record["volume_reduction_pooled"], "per_period": record["volume_reduction"]},
        "rank_stability": {"threshold": STABLE, "pairs": record["rank_stability"]},
        "feature_importance": {"features_in_model": len(record["importance"]), "carried": min(MAX_IMPORTANCE, len(record["importance"])), "top": record["importance"][:MAX_IMPORTANCE]},
    }
