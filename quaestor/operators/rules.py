"""Weighted AML rules: flags, risk score, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import half_even, or_false
from quaestor.params import AmlParams


def _flags(params: AmlParams) -> dict[str, Column]:
    """Rule id -> condition over the feature columns; never null."""
    structuring = F.col("is_near_threshold")
    if params.min_structuring_txns is not None:
        structuring = structuring & (F.col("near_threshold_txns") >= params.min_structuring_txns)
    conditions = {
        "velocity_count": F.col("txn_count_1d") > params.daily_txn_count_threshold,
        "velocity_daily_amount": F.abs("amount_sum_1d") > params.daily_amount_threshold,
        "velocity_7d_amount": F.abs("amount_sum_7d") > params.seven_day_amount_threshold,
        "structuring": structuring,
        "round_number": F.col("is_large_round") if params.round_numbers_enabled else F.lit(False),
    }
    return {rule: or_false(condition) for rule, condition in conditions.items()}


def _weights(params: AmlParams) -> dict[str, float]:
    return {
        "velocity_count": params.weight_velocity_daily_count,
        "velocity_daily_amount": params.weight_velocity_daily_amount,
        "velocity_7d_amount": params.weight_velocity_7d_amount,
        "structuring": params.weight_structuring,
        "round_number": params.weight_round_number,
    }


def rule_flags(featured: DataFrame, params: AmlParams = AmlParams()) -> DataFrame:
    """Add one boolean column per rule."""
    names = {rule: column for rule, (column, _) in C.AML_RULES.items()}
    return featured.withColumns({names[r]: c for r, c in _flags(params).items()})


def risk_score(params: AmlParams = AmlParams()) -> Column:
    """Sum of the positive weights of the rules that fired, within 0..100, two digits."""
    score = F.lit(0.0)
    for rule, weight in _weights(params).items():
        if weight > 0:
            score = score + F.when(F.col(C.AML_RULES[rule][0]), float(weight)).otherwise(0.0)
    return half_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)))


def severity(score: Column, params: AmlParams = AmlParams()) -> Column:
    return (
        F.when(score >= params.high, "high")
        .when(score >= params.medium, "medium")
        .when(score >= params.low, "low")
        .otherwise("none")
    )


def apply_rules(featured: DataFrame, params: AmlParams = AmlParams()) -> DataFrame:
    """Flags, ``risk_score``, ``severity`` and ``is_alert`` for every transaction."""
    return (
        rule_flags(featured, params)
        .withColumn("risk_score", risk_score(params))
        .withColumn("severity", severity(F.col("risk_score"), params))
        .withColumn("is_alert", F.col("severity") != "none")
    )


def aml_metrics(scored: DataFrame) -> DataFrame:
    """One row: transactions, alerts by severity, and how often each rule fired."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_if("is_alert").alias("alert_transactions"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_severity") for s in ("high", "medium", "low")],
        *[F.count_if(column).alias(f"{rule}_triggers") for rule, (column, _) in C.AML_RULES.items()],
    )
