"""Rule parameters, study window and operating point."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass

ENGINE = "triagelake-1"
RULES = tuple(f"R{n}" for n in range(1, 9))

#: The injected pattern classes, and the classes that give a rule a counterpart (they overlap).
TYPOLOGIES = ("BIPARTITE", "CYCLE", "FAN-IN", "FAN-OUT", "GATHER-SCATTER", "RANDOM", "SCATTER-GATHER", "STACK")
RULE_SUPPORT = {
    "R1": (),
    "R2": ("STACK", "CYCLE"),
    "R3": ("FAN-IN", "GATHER-SCATTER", "BIPARTITE"),
    "R4": ("FAN-OUT", "SCATTER-GATHER", "BIPARTITE"),
    "R5": (),
    "R6": (),
    "R7": (),
    "R8": (),
}


@dataclass(frozen=True)
class Parameters:
    """Thresholds of the eight rules; amounts are in the ledger's unit, periods are calendar days.

    Fixed values: the published defaults, under the names that overrides use. r8_lookback_periods is our own name for
    a length that is published as a constant.
    """

    r1_threshold: float = 10_000.0
    r1_band: float = 0.15
    r1_min_count: int = 2
    r2_min_amount: float = 20_000.0
    r2_tolerance: float = 0.03
    r2_max_hours: float = 12.0
    r3_window_periods: int = 3
    r3_min_originators: int = 18
    r4_window_periods: int = 3
    r4_min_beneficiaries: int = 18
    r5_min_amount: float = 100.0
    r5_multiple: float = 1.0
    r5_min_count: int = 2
    r6_lookback_periods: int = 3
    r6_dormancy_ceiling: int = 0
    r6_activation_count: int = 6
    r7_formats: tuple[str, ...] = ("Bitcoin", "Cash")
    r7_min_amount: float = 1_000.0
    r7_min_count: int = 3
    r8_lookback_periods: int = 10
    r8_min_prior_periods: int = 2
    r8_min_count: int = 4
    r8_own_multiple: float = 2.0
    r8_peer_multiple: float = 2.0

    def replace(self, **changes) -> Parameters:
        return dataclasses.replace(self, **changes)

    def override(self, settings: list[str]) -> Parameters:
        """NAME=VALUE settings, typed like the field; a tuple takes comma-separated names."""
        changes = {}
        for setting in settings:
            name, _, raw = setting.partition("=")
            if name not in {f.name for f in dataclasses.fields(self)}:
                raise ValueError(f"no such parameter: {name}")
            now = getattr(self, name)
            changes[name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if isinstance(now, tuple) else type(now)(raw)
        return self.replace(**changes)

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:16]

    def store_version(self) -> str:
        return f"{ENGINE}_{self.digest()}"


@dataclass(frozen=True)
class Window:
    """Study window, both days included. The published window."""

    start: str = "2022-09-01"
    end: str = "2022-09-10"


@dataclass(frozen=True)
class OperatingPoint:
    """What the review team works in a period, and where the evaluation starts. The published operating point."""

    k: int = 126
    evaluation_start: str = "2022-09-04"
    prior_weight: float = 126.0
    seed: int = 20220904
    gate: float = 1.3


@dataclass(frozen=True)
class Boost:
    """The boosted ranker. The published rounds, leaves, rate, least rows and truncation (the worked volume).

    depth bounds the passes a round; bins and l2 are our own.
    """

    rounds: int = 200
    leaves: int = 15
    rate: float = 0.05
    least_rows: int = 40
    truncation: int = 126
    depth: int = 6
    bins: int = 64
    l2: float = 1e-3


#: The bundled event tables as a ledger: parameters under which every rule fires.
FIXTURE_PARAMS = Parameters(
    r1_threshold=100.0, r1_band=0.40, r2_min_amount=20.0, r2_tolerance=0.10, r3_min_originators=12, r4_min_beneficiaries=10, r5_min_amount=1.0, r5_multiple=0.1,
    r6_lookback_periods=2, r6_dormancy_ceiling=1, r6_activation_count=4, r7_formats=("purchase", "signup"), r7_min_amount=10.0, r7_min_count=2, r8_peer_multiple=1.5,
)
FIXTURE_POINT = OperatingPoint(k=20, evaluation_start="2024-01-04", prior_weight=20.0)
FIXTURE_BOOST = Boost(rounds=10, leaves=8, rate=0.1, least_rows=10, truncation=20, depth=3)
