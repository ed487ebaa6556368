"""Parameters of operators and jobs. Defaults give the documented standard behaviour."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from quaestor import constants as C


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class FeedParams:
    """How a raw feed is validated and normalised."""

    required_columns: tuple[str, ...] = C.REQUIRED_COLUMNS
    success_statuses: tuple[str, ...] = C.SUCCESS_STATUSES
    refund_types: tuple[str, ...] = C.REFUND_TYPES
    valid_txn_types: tuple[str, ...] | None = C.VALID_TXN_TYPES
    late_days: int = 0
    date_format: str | None = None

    def __post_init__(self):
        _require(self.late_days >= 0, "late_days must be >= 0")


@dataclass(frozen=True)
class ReconcileParams:
    tolerance: float = 0.01
    grain: str = "timestamp"
    fail_on_mismatch: bool = True

    def __post_init__(self):
        _require(self.tolerance >= 0, "tolerance must be >= 0")
        _require(self.grain in ("timestamp", "day"), "grain is 'timestamp' or 'day'")


@dataclass(frozen=True)
class SkewParams:
    """When a key counts as hot, and how finely its rows are split.

    A key is hot above ``max(min_hot_rows, total_rows / max_hot_keys)`` rows, so fewer than
    ``max_hot_keys`` keys can ever be hot: that bounds the list of hot keys that gets broadcast.
    """

    min_hot_rows: int = 5_000_000
    max_hot_keys: int = 100_000
    slice_rows: int = 2_000_000

    def __post_init__(self):
        _require(self.min_hot_rows >= 1 and self.slice_rows >= 1, "row limits must be >= 1")
        _require(1 <= self.max_hot_keys <= 100_000, "max_hot_keys must lie in 1..100000")


@dataclass(frozen=True)
class AmlParams:
    enabled: bool = True
    velocity_windows: tuple[str, ...] = C.VELOCITY_WINDOWS
    velocity_frame: str = "rows"
    daily_txn_count_threshold: int = 10
    daily_amount_threshold: float = 50_000.0
    seven_day_amount_threshold: float = 150_000.0
    ctr_threshold: float = 10_000.0
    lower_bound_factor: float = 0.90
    upper_bound_factor: float = 0.99
    min_structuring_txns: int | None = None
    structuring_window_days: int = 7
    round_numbers_enabled: bool = True
    large_round_amounts: tuple[float, ...] = C.ROUND_AMOUNTS
    weight_velocity_daily_count: float = 25
    weight_velocity_daily_amount: float = 30
    weight_velocity_7d_amount: float = 35
    weight_structuring: float = 50
    weight_round_number: float = 15
    low: float = 25
    medium: float = 50
    high: float = 75
    skew: SkewParams | None = field(default_factory=SkewParams)

    def __post_init__(self):
        _require(self.velocity_frame in ("rows", "days"), "velocity_frame is 'rows' or 'days'")
        _require(self.ctr_threshold > 0, "ctr_threshold must be > 0")


@dataclass(frozen=True)
class TrustParams:
    """Freshness and latency limits, drift switches and alert-event settings."""

    max_data_age_hours: float = 24.0
    max_processing_minutes: float = 30.0
    track_additions: bool = True
    track_removals: bool = True
    track_type_changes: bool = True
    allowed_new_columns: tuple[str, ...] = ()
    critical_columns: tuple[str, ...] = ()
    severity_filter: tuple[str, ...] = ("warning", "error", "critical")
    throttle_minutes: float = 5.0

    def __post_init__(self):
        _require(self.max_data_age_hours >= 0, "max_data_age_hours must be >= 0")
        _require(self.max_processing_minutes >= 0, "max_processing_minutes must be >= 0")
        _require(self.throttle_minutes >= 0, "throttle_minutes must be >= 0")


@dataclass(frozen=True)
class JobParams:
    feed: FeedParams = field(default_factory=FeedParams)
    reconcile: ReconcileParams = field(default_factory=lambda: ReconcileParams(tolerance=0.0))
    aml: AmlParams = field(default_factory=AmlParams)
    trust: TrustParams = field(default_factory=TrustParams)


def params_hash(params, inputs: list[str] = ()) -> str:
    """SHA-256 over the sorted parameters and a listing of the inputs."""
    text = json.dumps({"params": asdict(params), "inputs": sorted(inputs)}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()
