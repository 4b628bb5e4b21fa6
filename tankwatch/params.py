"""Parameters of the telemetry operators; the defaults are those of fleets with pings about a minute apart."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    """A kind of fuel drop: where it happens, how long it lasts, what else must hold."""

    name: str
    state: str
    min_minutes: float
    max_minutes: float | None = None
    min_points: int = 0
    min_median_dt_s: float = 0.0


@dataclass(frozen=True)
class Detection:
    speed_stationary: float = 3.0
    gap_on_min: float = 5.0
    gap_off_min: float = 120.0
    min_segment_min: float = 5.0
    max_drain_rate: float = 3.0
    max_fill_rate: float = 25.0
    mad_k: float = 8.0
    max_gap_points: int = 3
    noise_mult_step: float = 3.0
    noise_mult_cum: float = 5.0
    floors: dict = field(default_factory=lambda: {"stationary_on": (0.5, 1.0), "ign_off": (0.3, 0.8)})
    max_rate: float = 5.0
    max_step: float = 50.0
    iou: float = 0.5
    noise_drop: float = -0.10
    patterns: tuple = (
        Pattern("short_stationary", "stationary_on", 5, 45),
        Pattern("extended_stationary", "stationary_on", 60, None),
        Pattern("postjourney", "ign_off", 10, None, 3, 30.0),
    )


@dataclass(frozen=True)
class Clustering:
    eps_m: float = 200.0
    min_samples: int = 10
