"""The bounds of what may be published, as one table over the paths of an artifact, and the check that reads it.

A path names fields by dots and a list's items by []; {} stands for every key of an open map.  A field that the table
does not name is refused, and so is one that it names and the artifact lacks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: The published patterns, and the published bounds in the table below.
ALERT, PARTY, RULE, ORDERING, DIGEST, DAY = r"\d{20}", r"Party-[A-F0-9]{10}", r"R[1-8]", r"B[0-3]|C1", r"[0-9a-f]{64}", r"\d{4}-\d{2}-\d{2}"
PERIODS = 12


@dataclass(frozen=True)
class Bound:
    """kind: object, map, list, text, whole, number, flag; least and most bound a value, or how many items or characters."""

    kind: str
    least: float | None = None
    most: float | None = None
    pattern: str | None = None
    may_be_null: bool = False


def _many(most: int, least: int = 0) -> Bound:
    return Bound("list", least, most)


_OBJECT, _MAP, _TEXT, _FLAG, _COUNT, _SOME, _ANY, _SHARE = (
    Bound("object"), Bound("map"), Bound("text"), Bound("flag"), Bound("whole", 0), Bound("whole", 1), Bound("number"), Bound("number", 0, 1),
)
_DAY, _ORDERING, _NAME = Bound("text", pattern=DAY), Bound("text", pattern=ORDERING), Bound("text", 1, 32)
_MAYBE = Bound("whole", may_be_null=True)

LIMITS: dict[str, Bound] = {
    "artifact_schema": _TEXT, "artifact_sha256": Bound("text", pattern=DIGEST), "provenance": _MAP, "provenance.{}": Bound("any"),
    "period": _OBJECT, "period.start": _DAY, "period.alerts": _SOME, "period.true_positives": _COUNT, "period.base_rate": _SHARE,
    "operating_point": _OBJECT, "operating_point.k": _SOME, "operating_point.evaluation_start": _DAY, "orderings": _many(6), "orderings[]": _ORDERING,
    "quantities": _MAP, "quantities.{}": _OBJECT, "quantities.{}.label": _TEXT, "quantities.{}.unit": _TEXT,
    "result": _OBJECT, "result.evaluation_periods": _SOME, "result.k": _SOME, "result.gate": _OBJECT, "result.gate.reference_rung": _ORDERING, "result.gate.threshold": _ANY, "result.gate.lift": _ANY,
    "result.gate.interval": _many(2, 2), "result.gate.interval[]": replace(_ANY, may_be_null=True), **{f"result.gate.{n}": _FLAG for n in ("met", "point_passed", "interval_passed", "passed", "promoted")},
    "result.measured": _many(6), "result.measured[]": _OBJECT, "result.measured[].ordering": _ORDERING, "result.measured[].periods": _SOME, "result.measured[].worked": _SOME,
    "result.measured[].true_positives": _COUNT, "result.measured[].precision": _SHARE, "result.measured[].interval": _many(2, 2), "result.measured[].interval[]": _ANY,
    "evidence": _OBJECT, "evidence.funnel": _OBJECT, "evidence.funnel.attempts_live": _COUNT, "evidence.funnel.attempts_surfaced": _COUNT, "evidence.funnel.lost_before_ordering": _COUNT,
    "evidence.funnel.attempts_reached": _MAP, "evidence.funnel.attempts_reached.{}": _COUNT,
    "evidence.typology_detail": _many(8), "evidence.typology_detail[]": _OBJECT, "evidence.typology_detail[].typology": _TEXT, "evidence.typology_detail[].attempts_live": _COUNT,
    "evidence.typology_detail[].attempts_surfaced": _COUNT, "evidence.typology_detail[].reached": _MAP, "evidence.typology_detail[].reached.{}": _COUNT,
    "evidence.typology_detail[].recall_of_live": _SHARE, "evidence.typology_detail[].recall_of_surfaced": _SHARE, "evidence.typology_detail[].interval": _many(2, 2), "evidence.typology_detail[].interval[]": _ANY,
    "evidence.unattributed": _OBJECT, "evidence.unattributed.alerts_in_population": _COUNT, "evidence.unattributed.reached": _MAP, "evidence.unattributed.reached.{}": _COUNT,
    "evidence.per_period": _many(PERIODS), "evidence.per_period[]": _OBJECT, "evidence.per_period[].period_start": _DAY, "evidence.per_period[].alerts": _SOME, "evidence.per_period[].worked": _COUNT,
    "evidence.per_period[].coverage": _SHARE, "evidence.per_period[].true_positives": _MAP, "evidence.per_period[].true_positives.{}": _COUNT, "evidence.per_period[].precision": _MAP, "evidence.per_period[].precision.{}": _SHARE,
    "evidence.volume_reduction": _OBJECT, "evidence.volume_reduction.reference_rung": _ORDERING, "evidence.volume_reduction.pooled": replace(_ANY, may_be_null=True),
    "evidence.volume_reduction.per_period": _many(PERIODS), "evidence.volume_reduction.per_period[]": _OBJECT, "evidence.volume_reduction.per_period[].period_start": _DAY,
    **{f"evidence.volume_reduction.per_period[].{n}": _COUNT for n in ("attempts", "true_positives")},
    **{f"evidence.volume_reduction.per_period[].{n}": _MAYBE for n in ("attempts_depth", "alerts_depth", "attempts_freed", "alerts_freed")}, "evidence.volume_reduction.per_period[].target_was_zero": _FLAG,
    "evidence.rank_stability": _OBJECT, "evidence.rank_stability.threshold": _ANY, "evidence.rank_stability.pairs": _many(PERIODS), "evidence.rank_stability.pairs[]": _OBJECT,
    "evidence.rank_stability.pairs[].period_start": _DAY, "evidence.rank_stability.pairs[].rho": Bound("number", -1, 1, may_be_null=True),
    "evidence.feature_importance": _OBJECT, "evidence.feature_importance.features_in_model": _COUNT, "evidence.feature_importance.carried": _COUNT, "evidence.feature_importance.top": _many(15),
    "evidence.feature_importance.top[]": _OBJECT, "evidence.feature_importance.top[].feature": _TEXT, "evidence.feature_importance.top[].gain": Bound("number", 0),
    "rules": _many(8), "rules[]": _OBJECT, "rules[].rule_id": Bound("text", pattern=RULE), "rules[].supported": _FLAG, "rules[].typologies": _TEXT, "rules[].attempts": _COUNT, "rules[].store_alerts": _COUNT, "rules[].period_alerts": _COUNT,
    "typologies": _many(8), "typologies[]": _OBJECT, "typologies[].typology": _TEXT, **{f"typologies[].{a}_{b}": _COUNT for a in ("period", "evaluation") for b in ("attempts", "surfaced")},
    "period_attempts": _many(3000), "period_attempts[]": _OBJECT, "period_attempts[].attempt_id": _COUNT, "period_attempts[].typology": _TEXT, "period_attempts[].surfaced": _FLAG,
    "queue": _many(3000), "queue[]": _OBJECT, "queue[].alert_id": Bound("text", pattern=ALERT), "queue[].subject": Bound("text", pattern=PARTY), "queue[].fired_rules": _many(8), "queue[].fired_rules[]": Bound("text", pattern=RULE),
    "queue[].first_txn_ts": replace(_TEXT, may_be_null=True), "queue[].alert_amount": Bound("number", 0), "queue[].score": _ANY, "queue[].attempt_ids": _many(16), "queue[].attempt_ids[]": _COUNT,
    "queue[].typologies": _many(8), "queue[].typologies[]": _TEXT, "queue[].is_true_positive": _FLAG, "queue[].unattributed_only": _FLAG, "queue[].ranks": Bound("map", 1, 5), "queue[].ranks.{}": _SOME,
    "queue[].evidence": Bound("map", 0, 8), "queue[].evidence.{}": Bound("map", 0, 6), "queue[].evidence.{}.{}": _ANY,
    "queue[].contributions": _many(8), "queue[].contributions[]": _OBJECT, "queue[].contributions[].feature": _TEXT, "queue[].contributions[].value": _ANY, "queue[].contributions[].contribution": _ANY,
    "queue[].transactions": _many(8), "queue[].transactions[]": _OBJECT, "queue[].transactions[].n": Bound("whole", 1, 8), "queue[].transactions[].txn_id": _COUNT, "queue[].transactions[].ts": _TEXT,
    "queue[].transactions[].sender": Bound("text", pattern=PARTY), "queue[].transactions[].receiver": Bound("text", pattern=PARTY), "queue[].transactions[].amount": Bound("number", 0),
    "queue[].transactions[].currency": _NAME, "queue[].transactions[].format": _NAME, "queue[].transaction_count": _COUNT,
}


def limits(periods: int = PERIODS) -> dict[str, Bound]:
    """The table, for an evaluation of another number of periods."""
    return {p: replace(b, most=periods) if b.kind == "list" and b.most == PERIODS else b for p, b in LIMITS.items()}


_KINDS = {"object": dict, "map": dict, "list": list, "text": str, "flag": bool, "whole": int, "number": (int, float)}


def _children(path: str, table: dict[str, Bound]) -> set[str]:
    start = f"{path}." if path else ""
    return {p[len(start) :] for p in table if p.startswith(start) and re.fullmatch(r"[^.\[\]{}]+", p[len(start) :])}


def violations(value, table: dict[str, Bound] = LIMITS, path: str = "", at: str = "") -> list[str]:
    """What of an artifact is out of bounds, each with its place; empty if nothing is."""
    bound = table[path] if path else _OBJECT
    if value is None:
        return [] if bound.may_be_null or bound.kind == "any" else [f"{at}: null"]
    if bound.kind == "any":
        return []
    if not isinstance(value, _KINDS[bound.kind]) or isinstance(value, bool) != (bound.kind == "flag"):
        return [f"{at or 'artifact'}: not a {bound.kind}"]
    size = len(value) if bound.kind in ("list", "map", "text") else value
    found = []
    if bound.least is not None and size < bound.least or bound.most is not None and size > bound.most:
        found.append(f"{at}: {size} is not within {bound.least} and {bound.most}")
    if bound.pattern is not None and not re.fullmatch(bound.pattern, value):
        found.append(f"{at}: malformed")
    if bound.kind == "list":
        for k, x in enumerate(value):
            found += violations(x, table, f"{path}[]", f"{at}[{k}]")
    elif bound.kind == "map":
        for k, x in value.items():
            found += violations(x, table, f"{path}.{{}}", f"{at}.{k}")
    elif bound.kind == "object":
        known = _children(path, table)
        found += [f"{at}.{k}: not a published field" for k in value if k not in known]
        for k in sorted(known):
            here = f"{path}.{k}" if path else k
            found += violations(value[k], table, here, f"{at}.{k}" if at else k) if k in value else [f"{at}.{k}: missing"]
    return found
