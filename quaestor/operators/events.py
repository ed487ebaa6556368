"""Alert events about runs and data: filtering, throttling, ids, acknowledgement, presets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import minute_stamp
from quaestor.operators.throttle import throttle
from quaestor.params import SkewParams, TrustParams

COLUMNS = ("event_at", "severity", "category", "title", "message", "source")


def filter_severity(events: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return events.filter(F.col("severity").isin(*allowed))


def throttle_key() -> Column:
    return F.concat_ws(":", "category", "title")


def alert_id() -> Column:
    """Category, title with underscores, and the minute."""
    title = F.replace("title", F.lit(" "), F.lit("_"))
    return F.concat_ws("_", "category", title, minute_stamp(F.col("event_at")))


def send_events(
    events: DataFrame,
    tie: str,
    params: TrustParams = TrustParams(),
    skew: SkewParams = SkewParams(),
    last_sent: DataFrame | None = None,
) -> DataFrame:
    """Events that pass the severity filter and the throttle, with their ids."""
    passing = filter_severity(events, params.severity_filter)
    sent = throttle(passing, throttle_key(), "event_at", tie, params.throttle_minutes, skew, last_sent)
    return sent.withColumn("alert_id", alert_id())


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Add ``acknowledged``, ``acknowledged_by``, ``acknowledged_at`` from ``acks``
    ``(alert_id, by, at)``. Each acknowledgement takes the first open alert with its id, so the
    n-th of an id goes to its n-th alert."""
    nth_alert = Window.partitionBy("alert_id").orderBy("event_at")
    nth_ack = Window.partitionBy("alert_id").orderBy("at", "by")
    placed = acks.select(
        "alert_id",
        F.row_number().over(nth_ack).alias("_nth"),
        F.col("by").alias("acknowledged_by"),
        F.col("at").alias("acknowledged_at"),
    )
    return (
        alerts.withColumn("_nth", F.row_number().over(nth_alert))
        .join(placed, ["alert_id", "_nth"], "left")
        .drop("_nth")
        .withColumn("acknowledged", F.col("acknowledged_by").isNotNull())
    )


def active_alerts(alerts: DataFrame, acks: DataFrame, severity: str | None = None) -> DataFrame:
    """Alerts nobody has acknowledged, of one severity if given."""
    acknowledged = ("acknowledged", "acknowledged_by", "acknowledged_at")
    open_ = acknowledge(alerts, acks).filter(~F.col("acknowledged")).drop(*acknowledged)
    return open_ if severity is None else open_.filter(F.col("severity") == severity)


def preset(
    rows: DataFrame,
    kind: str,
    title: Column,
    message: Column,
    at: Column,
    severity: Column | None = None,
) -> DataFrame:
    """Rows of any table as events of a preset: quality, sla, schema or run."""
    category, source, default = C.EVENT_PRESETS[kind]
    return rows.select(
        at.cast("timestamp_ntz").alias("event_at"),
        (F.lit(default) if severity is None else severity).alias("severity"),
        F.lit(category).alias("category"),
        title.alias("title"),
        message.alias("message"),
        F.lit(source).alias("source"),
    )


def _time(at: datetime) -> Column:
    return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def contract_events(violations: DataFrame, contract: str, at: datetime) -> DataFrame:
    title = F.concat(F.lit(f"Contract {contract}: "), "constraint_type", F.lit(" "), "column_name")
    return preset(violations, "quality", title, F.col("message"), _time(at), F.col("severity"))


def mismatch_events(mismatches: DataFrame, at: datetime) -> DataFrame:
    """One event for all reconciliation mismatches; none without a mismatch."""
    count = mismatches.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    message = F.format_string("totals differ beyond the tolerance on %d dates", "n")
    return preset(count, "quality", F.lit("Totals do not reconcile"), message, _time(at), F.lit("error"))


def sla_events(metrics: DataFrame) -> DataFrame:
    """One event per violated or stale metric."""
    bad = metrics.filter(F.col("status").isin("violated", "stale"))
    title = F.concat(F.lit("SLA Violation: "), "metric_name", F.lit(" "), "subject")
    message = F.format_string("%.1f %s (limit %.1f)", "value", "unit", "threshold")
    return preset(bad, "sla", title, message, F.col("measured_at"))


def drift_events(drift: DataFrame, at: datetime) -> DataFrame:
    title = F.concat(F.lit("Schema of "), "source", F.lit(": "), "event_type")
    return preset(drift, "schema", title, F.col("description"), _time(at), F.col("severity"))


def run_event(spark, title: str, message: str, at: datetime, failed: bool) -> DataFrame:
    """The success (info) or failure (critical) of a run as one event."""
    category, source, critical = C.EVENT_PRESETS["run"]
    row = [(at.replace(tzinfo=None), critical if failed else "info", category, title, message, source)]
    schema = "event_at timestamp_ntz, severity string, category string, title string, message string, source string"
    return spark.createDataFrame(row, schema)
