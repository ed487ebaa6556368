"""Per-transaction features for AML rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import half_even, or_false
from quaestor.operators.velocity import attach_days, rolling_days, velocity, velocity_days
from quaestor.params import AmlParams


def time_features(ledger: DataFrame) -> DataFrame:
    """Hour, weekday (Monday = 0), weekend, and late night (from 0:00 up to 5:00).

    A date without a time is midnight, hence late night.
    """
    hour, weekday = F.hour("txn_date"), F.weekday("txn_date")
    return ledger.withColumns(
        {
            "hour_of_day": hour,
            "day_of_week": weekday,
            "is_weekend": or_false(weekday >= 5),
            "is_late_night": or_false(hour < 5),
        }
    )


def structuring_features(
    ledger: DataFrame,
    ctr_threshold: float = 10_000.0,
    lower_factor: float = 0.90,
    upper_factor: float = 0.99,
) -> DataFrame:
    """Amounts just below the reporting threshold (both bounds included), and their share of it."""
    magnitude = F.abs("amount")
    near = magnitude.between(ctr_threshold * lower_factor, ctr_threshold * upper_factor)
    return ledger.withColumns(
        {
            "is_near_threshold": or_false(near),
            "pct_of_threshold": half_even(magnitude / F.lit(ctr_threshold) * 100),
        }
    )


def round_number_features(
    ledger: DataFrame, round_amounts: tuple[float, ...] = C.ROUND_AMOUNTS
) -> DataFrame:
    """Amounts that are exactly one of the listed round amounts."""
    magnitude = F.abs("amount")
    hit = or_false(magnitude.isin(*[float(a) for a in round_amounts]))
    return ledger.withColumns(
        {"is_large_round": hit, "round_number_match": F.when(hit, magnitude)}
    )


def structuring_pattern(ledger: DataFrame, params: AmlParams = AmlParams()) -> DataFrame:
    """Add ``near_threshold_txns``: near-threshold transactions of the account within the last
    ``structuring_window_days`` calendar days. Needs :func:`structuring_features`."""
    label = f"{params.structuring_window_days}D"
    near = {"near": F.count_if("is_near_threshold")}
    rolled = rolling_days(ledger, near, (label,)).withColumnRenamed(
        f"near_{label.lower()}", "near_threshold_txns"
    )
    return attach_days(ledger, rolled)


def aml_features(ledger: DataFrame, params: AmlParams = AmlParams()) -> DataFrame:
    """All features in one plan; the round-number columns are absent when switched off.

    Day windows and the structuring pattern share their aggregation, window and join.
    """
    pattern = params.min_structuring_txns is not None
    df = structuring_features(
        time_features(ledger), params.ctr_threshold, params.lower_bound_factor, params.upper_bound_factor
    )
    if pattern and params.velocity_frame == "days":
        near = ("is_near_threshold", f"{params.structuring_window_days}D", "near_threshold_txns")
        df = velocity_days(df, params.velocity_windows, near)
    else:
        df = velocity(df, params.velocity_windows, params.velocity_frame, params.skew)
        df = structuring_pattern(df, params) if pattern else df
    if params.round_numbers_enabled:
        df = round_number_features(df, params.large_round_amounts)
    return df
