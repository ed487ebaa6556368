"""Freshness of tables and latency of runs against limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.columns import micros
from quaestor.params import TrustParams

# Fixed value: from this share of the limit on, a value is a warning.
WARN_SHARE = 0.8


def freshness_status(age_hours: Column, limit: float) -> Column:
    return (
        F.when(age_hours.isNull(), "unknown")
        .when(age_hours > limit, "stale")
        .when(age_hours > limit * WARN_SHARE, "warning")
        .otherwise("fresh")
    )


def last_updates(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``(table_name, last_updated)``: the newest timestamp of each table's column."""
    parts = [
        df.agg(F.lit(name).alias("table_name"), F.max(F.col(c).cast("timestamp_ntz")).alias("last_updated"))
        for name, (df, c) in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def freshness(updates: DataFrame, as_of: datetime, params: TrustParams = TrustParams()) -> DataFrame:
    """Age in hours at ``as_of`` and its status, per row of ``(table_name, last_updated)``."""
    now = F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    age = (micros(now) - micros(F.col("last_updated"))) / F.lit(3_600_000_000.0)
    return (
        updates.withColumn("data_age_hours", age)
        .withColumn("max_age_hours", F.lit(params.max_data_age_hours))
        .withColumn("status", freshness_status(F.col("data_age_hours"), params.max_data_age_hours))
    )


def latency(runs: DataFrame, params: TrustParams = TrustParams()) -> DataFrame:
    """Minutes from ``started`` to ``ended`` and the status, per row of a run log."""
    limit = params.max_processing_minutes
    minutes = (micros(F.col("ended")) - micros(F.col("started"))) / F.lit(60_000_000.0)
    status = (
        F.when(F.col("minutes") > limit, "violated")
        .when(F.col("minutes") > limit * WARN_SHARE, "warning")
        .otherwise("compliant")
    )
    return runs.withColumn("minutes", minutes).withColumn("status", status)


def freshness_metrics(report: DataFrame, at: Column) -> DataFrame:
    """Freshness rows in the common metric layout; an unknown age is recorded as -1."""
    return report.select(
        F.lit("data_freshness").alias("metric_name"),
        F.col("table_name").alias("subject"),
        at.alias("measured_at"),
        F.coalesce("data_age_hours", F.lit(-1.0)).alias("value"),
        F.col("max_age_hours").alias("threshold"),
        F.lit("hours").alias("unit"),
        "status",
    )


def latency_metrics(report: DataFrame, limit: float) -> DataFrame:
    return report.select(
        F.lit("processing_latency").alias("metric_name"),
        F.col("process").alias("subject"),
        F.col("ended").alias("measured_at"),
        F.col("minutes").alias("value"),
        F.lit(limit).alias("threshold"),
        F.lit("minutes").alias("unit"),
        "status",
    )


_COMPLIANT = ("compliant", "fresh")
_VIOLATED = ("violated", "stale")


def sla_report(metrics: DataFrame) -> DataFrame:
    """One row: metrics by outcome and the share that complies. Stale counts as a violation and
    fresh as compliant."""
    total, good = F.count(F.lit(1)), F.count_if(F.col("status").isin(*_COMPLIANT))
    return metrics.agg(
        total.alias("total_metrics"),
        good.alias("compliant"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.count_if(F.col("status").isin(*_VIOLATED)).alias("violations"),
        F.coalesce(good / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("compliance_rate"),
    )


def sla_summary(metrics: DataFrame) -> DataFrame:
    """One row: healthy or degraded (any violation), with counts."""
    violations = F.count_if(F.col("status").isin(*_VIOLATED))
    return metrics.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.when(violations > 0, "degraded").otherwise("healthy").alias("status"),
        violations.alias("violation_count"),
        F.count_if(F.col("status") == "warning").alias("warning_count"),
    )


def recent_violations(metrics: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` violations by time (a top-k, kept per partition before merging)."""
    return (
        metrics.filter(F.col("status").isin(*_VIOLATED))
        .orderBy(F.desc("measured_at"), "metric_name", "subject")
        .limit(n)
        .select("metric_name", "subject", "measured_at", "value", "threshold")
    )
