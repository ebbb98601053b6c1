"""Parameters of the operators; fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    window_ms: int = 60_000
    flow_minutes: tuple[int, ...] = (1, 5, 15)
    whale_quantity: float = 1.0
    sector_bounds: tuple[float, float] = (0.5, 1.0)
    cvd_reset_ms: int = 4 * 3_600_000
    burst_ms: int = 200
    burst_end_ratio: float = 0.5
    absorption_eps: float = 1.0
    exhaustion_factor: float = 2.5
    history: int = 100
    delta_std_factor: float = 2.0
    min_trades: int = 10
    profile_bins: int = 20
    value_area: float = 0.70
    liquidation_bucket: float = 500.0
    label_horizon: int = 15
    label_threshold: float = 0.002
    outcome_flat: float = 0.0001


DEFAULT = Config()
