"""Constants that define the engine's semantics, and the bucket width that scales them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rate:
    warmup: int = 15
    z: float = 3.0
    halflife: float = 120.0
    min_events: int = 3
    min_alert_events: int = 10
    max_alerts: int = 5
    multivariate: float = 0.7
    reservoir: int = 4000
    min_fit: int = 200
    refit: int = 15
    neighbours: int = 5
    #: Width of the spans of a bucket whose addresses are reduced in one place.
    part_seconds: int = 5
    #: Width of the chunks of time whose parts are folded in order in one place.
    chunk_seconds: int = 21_600

    @property
    def alpha(self) -> float:
        return 1.0 - 0.5 ** (1.0 / max(self.halflife, 1.0))


@dataclass(frozen=True)
class Content:
    anomaly: float = 0.70
    suspicious: float = 0.40
    storm: int = 3
    min_window: int = 3
    min_score: int = 3
    max_alerts: int = 5


@dataclass(frozen=True)
class Drift:
    warmup: int = 30
    k: float = 0.75
    h: float = 6.0
    h_single: float = 10.0
    cap: float = 12.0
    clip: float = 3.0
    min_buckets: int = 6
    ewma_halflife: float = 5.0
    ewma_floor: float = 0.9
    halflife: float = 240.0
    freeze: float = 5.0
    count_floor: float = 1.0
    amount_floor: float = 200_000.0
    amount_relative: float = 0.35
    event_cap: float = 1_000_000.0
    emit_floor: float = 2.0
    max_alerts: int = 5
    max_payers: int | None = 10_000


@dataclass(frozen=True)
class Fusion:
    weights: dict = field(default_factory=lambda: {"rate": 0.55, "content": 0.60, "drift": 0.50})
    default_weight: float = 0.40
    halflife: float = 120.0
    boost: float = 0.25
    active: float = 0.05
    breadth: float = 0.05
    min_events: int = 10
    stale: float = 300.0
    elevated_up: float = 0.40
    elevated_down: float = 0.25
    critical_up: float = 0.75
    critical_down: float = 0.55
    emit_every: float = 30.0
    emit_delta: float = 0.15
    top: int = 5
    transitions: int = 20


#: Seconds during which an alert of the same kind is sent once.
DEDUP_SECONDS = 300
#: Error events in five minutes above which the monitor alerts.
MONITOR_ERRORS = 200
