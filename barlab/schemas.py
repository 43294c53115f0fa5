"""Schemas and parameters that the operators share."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

BAR = "symbol string, date date, open double, high double, low double, close double, volume double"
BAR_COLUMNS = ("symbol", "date", "open", "high", "low", "close", "volume")
STRATEGIES = ("trend_model", "buy_hold", "sma200", "vol_hold")


@dataclass(frozen=True)
class Protocol:
    """Parameters of the study; dates bound periods from below, ends are exclusive."""

    sma: int = 200
    momentum: int = 63
    vol: int = 30
    annual: int = 365
    target_vol: float = 0.40
    max_position: float = 1.0
    band: float = 0.05
    cost_bps: float = 15.0
    lag: int = 2
    horizons: tuple[int, ...] = (7, 30)
    research_start: date = date(1996, 1, 1)
    calibration_end: date = date(1999, 1, 1)
    holdout_start: date = date(2000, 1, 1)
    data_end: date = date(2001, 11, 5)
    inner_start: date = date(1998, 1, 1)
    outer_start: date = date(2000, 1, 1)
    sma_grid: tuple[int, ...] = (150, 200, 250)
    momentum_grid: tuple[int, ...] = (42, 63, 84)
    cost_stress: tuple[float, ...] = (30.0, 50.0)
    lag_stress: tuple[int, ...] = (1, 3)
    shrink: int = 3
    search_horizon: int = 30
    dev_years: tuple[int, ...] = (1998, 1999)
    reuse_years: tuple[int, ...] = (2000, 2001)
    nested_features: tuple[str, ...] = ("return_7", "return_30", "ma200", "vol30")
    selectable: tuple[str, ...] = ("historical_prior", "regime_shrunk", "logistic_shrunk", "equal_blend")
    penalty: float = 0.1
    prior_weight: float = 0.5
    reps: int = 1000
    nested_reps: int = 2000
    blocks: tuple[int, ...] = (30, 60, 90)
    seed: int = 20240101

    @property
    def cost(self) -> float:
        return self.cost_bps / 10_000
