"""Driver-side settings; strict, with the invariants of the temporal protocol."""

from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, model_validator

SCHEMA_VERSION, COHORT_VERSION = "panel-schema-1", "active-history-1"

LAGS, WINDOWS = (1, 7, 14, 28, 56), (7, 28, 56)
LONGEST = 56
CODES = ["sku_code", "category_code", "subcategory_code"]
TARGET = [*CODES, *(f"lag_{n}" for n in LAGS), *(f"rolling_mean_{n}" for n in WINDOWS), *(f"rolling_std_{n}" for n in WINDOWS), "nonzero_rate_28", "days_since_nonzero", "context_mean"]
CALENDAR = ["day_of_week", "week_of_year", "month", "day_of_month", "is_weekend", "event_flag_feature", "snap_eligible_feature"]
PRICE = ["price_lag_1", "price_change_7", "relative_price"]
FEATURE_SETS = {"lag": TARGET, "calendar": [*TARGET, *CALENDAR], "full": [*TARGET, *CALENDAR, *PRICE]}


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Segmentation(Strict):
    fast_max_zero_ratio: float = 0.20
    intermittent_min_zero_ratio: float = 0.60

    @model_validator(mode="after")
    def _ordered(self):
        if not 0 <= self.fast_max_zero_ratio < self.intermittent_min_zero_ratio <= 1:
            raise ValueError("segment thresholds must be ordered within 0..1")
        return self


class Thresholds(Strict):
    global_missing_price: float = 0.25
    series_missing_price: float = 0.75
    long_zero_run_days: int = 84
    inactive_tail_days: int = 84
    extreme_quantity_quantile: float = 0.999
    extreme_price_change: float = 1.0


class Data(Strict):
    profile: Literal["smoke", "development", "release"] = "development"
    store_id: str = "CA_1"
    series_limit: int | None = 300
    seed: int = 42

    @model_validator(mode="after")
    def _limit(self):
        if (self.profile == "release") != (self.series_limit is None):
            raise ValueError("a release has no series limit; other profiles need one")
        return self


class Forecast(Strict):
    horizon: int = Field(28, ge=1)
    minimum_history: int = Field(112, ge=1)
    development_folds: int = Field(3, ge=0)


class Settings(Strict):
    data: Data = Data()
    forecast: Forecast = Forecast()
    segmentation: Segmentation = Segmentation()
    thresholds: Thresholds = Thresholds()


class Fold(Strict):
    fold_id: str
    role: Literal["development", "locked"]
    train_start: date
    train_end: date
    evaluation_start: date
    evaluation_end: date

    @property
    def locked(self) -> bool:
        return self.role == "locked"

    @model_validator(mode="after")
    def _adjacent(self):
        if self.evaluation_start != self.train_end + timedelta(days=1):
            raise ValueError(f"{self.fold_id}: evaluation must start the day after training ends")
        if not self.train_start <= self.train_end < self.evaluation_end:
            raise ValueError(f"{self.fold_id}: dates are out of order")
        return self


class Protocol(Strict):
    """Rolling-origin folds, bands and baselines."""

    folds: list[Fold]
    horizon: int = 28
    minimum_history: int = 112
    lags: list[int] = [1, 7, 28]
    bands: list[tuple[int, int]] = [(1, 7), (8, 14), (15, 21), (22, 28)]
    weight_window: int = 28
    alpha: float = Field(0.1, gt=0, le=1)
    #: What transforms learn from, and how a seasonal forecast goes on beyond its lag.
    transforms_fit_scope: Literal["fold_training_only", "all_rows"] = "fold_training_only"
    recursive: bool = True

    @model_validator(mode="after")
    def _sound(self):
        if sum(f.locked for f in self.folds) != 1 or not self.folds[-1].locked:
            raise ValueError("exactly the last fold must be locked")
        for a, b in zip(self.folds, self.folds[1:], strict=False):
            if b.evaluation_start != a.evaluation_end + timedelta(days=1):
                raise ValueError(f"{b.fold_id}: evaluation windows must adjoin")
        for f in self.folds:
            if (f.evaluation_end - f.train_end).days != self.horizon:
                raise ValueError(f"{f.fold_id}: window differs from the horizon")
        if self.lags != sorted(set(self.lags)) or self.lags[0] < 1:
            raise ValueError("lags must be positive and ascending")
        if [d for a, b in self.bands for d in range(a, b + 1)] != list(range(1, self.horizon + 1)):
            raise ValueError("bands must cover the horizon once")
        return self

    @property
    def development(self) -> list[Fold]:
        return [f for f in self.folds if not f.locked]

    def all_bands(self) -> list[tuple[str, int, int]]:
        return [("all", 1, self.horizon), *((f"days_{a:02d}_{b:02d}", a, b) for a, b in self.bands)]


def rolling_protocol(first: date, last: date, horizon: int = 28, development: int = 3, **more: Any) -> Protocol:
    """Folds that end at the last date: the final window is locked, those before it are for development."""
    folds = []
    for k in range(development + 1):
        end = last - timedelta(days=horizon * (development - k))
        name, role = (f"development_{k + 1}", "development") if k < development else ("locked_final", "locked")
        cut = end - timedelta(days=horizon)
        folds.append(Fold(fold_id=name, role=role, train_start=first, train_end=cut, evaluation_start=cut + timedelta(days=1), evaluation_end=end))
    return Protocol(folds=folds, horizon=horizon, **more)


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """base with over's entries, recursively; over wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_settings(path: str | Path, base: str | Path | None = None) -> Settings:
    tree = yaml.safe_load(Path(path).read_text()) or {}
    return Settings(**(merged(yaml.safe_load(Path(base).read_text()) or {}, tree) if base else tree))
