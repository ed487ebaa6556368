"""Alerts: one per account, day and rule, from the transactions that reached a severity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import exact_sum, half_even
from quaestor.operators.numbering import number_in_order

KEY = ("account_id", "alert_date", "rule_id")
# About how many ids one row of an alert lists.
PART_IDS = 10_000


def triggered(scored: DataFrame) -> DataFrame:
    """One row per alerted transaction and rule that fired on it.

    Flag columns that are absent count as not fired. A transaction whose score stays below the
    lowest severity raises no alert, even when a rule fired.
    """
    present = [(rule, flag) for rule, (flag, _) in C.AML_RULES.items() if flag in scored.columns]
    fired = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(rule)) for rule, flag in present]))
    return scored.filter("is_alert").select(
        "account_id",
        F.to_date("txn_date").alias("alert_date"),
        F.explode(fired).alias("rule_id"),
        "txn_id",
        F.abs("amount").alias("magnitude"),
        "risk_score",
        "severity",
    )


def _rule_name(rule: Column) -> Column:
    names = [F.lit(x) for rule_id, (_, name) in C.AML_RULES.items() for x in (rule_id, name)]
    return F.coalesce(F.create_map(*names)[rule], rule)


def alert_totals(hits: DataFrame) -> DataFrame:
    """The alerts without their transaction lists: every value is combined before the shuffle."""
    total = exact_sum(F.col("magnitude"))
    return (
        hits.groupBy(*KEY)
        .agg(
            F.max_by("severity", "risk_score").alias("severity"),
            half_even(F.max("risk_score")).alias("risk_score"),
            F.count(F.lit(1)).alias("triggering_txn_count"),
            F.bround(total, 2).alias("_total"),
        )
        .select(
            *KEY,
            _rule_name(F.col("rule_id")).alias("rule_name"),
            "severity",
            "risk_score",
            "triggering_txn_count",
            F.col("_total").cast("double").alias("triggering_amount_sum"),
            F.concat(
                _rule_name(F.col("rule_id")),
                F.lit(": "),
                F.col("triggering_txn_count").cast("string"),
                F.lit(" transactions totaling "),
                F.format_number("_total", 2),
            ).alias("description"),
            F.lit("open").alias("status"),
        )
    )


def alert_transactions(hits: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """The complete list in rows: every transaction of every alert; with :func:`numbered_alerts` also its id."""
    rows = hits.select(*KEY, "txn_id")
    return rows if numbered is None else rows.join(numbered.select(*KEY, "alert_id"), list(KEY))


def id_parts(hits: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """The ids of each alert in parts of about ``part_ids``: ``ids_part`` (from 0), ``triggering_txn_ids``.

    A hash of the id names the part, so no task ever holds all ids of a large alert. An alert of up to
    ``part_ids`` transactions has one part.
    """
    parts = F.ceil(F.count(F.lit(1)) / part_ids).alias("_parts")
    digest = F.conv(F.substring(F.md5("txn_id"), 1, 15), 16, 10).cast("bigint")
    part = F.coalesce(F.pmod(digest, F.col("_parts")), F.lit(0)).cast("int")
    return (
        alert_transactions(hits)
        .join(hits.groupBy(*KEY).agg(parts), list(KEY))
        .groupBy(*KEY, part.alias("ids_part"))
        .agg(F.sort_array(F.collect_list("txn_id")).alias("triggering_txn_ids"))
    )


def deduplicated_alerts(hits: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """Alerts with their ids as a sorted array: one row per alert and part of its ids."""
    return alert_totals(hits).join(id_parts(hits, part_ids), list(KEY), "left")


def numbered_alerts(hits: DataFrame, run_time: datetime) -> DataFrame:
    """One row per alert with ``alert_id``, numbered by account, date and rule within the run."""
    stamp = run_time.strftime("%Y%m%d%H%M%S")
    return number_in_order(alert_totals(hits), KEY, "_number").select(
        "*",
        F.format_string(f"AML-{stamp}-%06d", "_number").alias("alert_id"),
        F.lit(run_time.isoformat()).alias("alert_timestamp"),
    )


def with_ids(numbered: DataFrame, hits: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """The twelve alert columns and ``ids_part``: a row per alert and part of its ids, most alerts have one."""
    return numbered.join(id_parts(hits, part_ids), list(KEY), "left").select(*C.AML_ALERT_COLUMNS, "ids_part")


def whole_alerts(numbered: DataFrame, hits: DataFrame, part_ids: int = PART_IDS) -> DataFrame:
    """The twelve alert columns, one row per alert.

    The ids are null for alerts of more than ``part_ids``, whose list could be of any length: :func:`with_ids` has
    them in parts, :func:`alert_transactions` one by one.
    """
    listed = with_ids(numbered, hits, part_ids).filter(F.col("triggering_txn_count") <= part_ids).drop("ids_part")
    rest = numbered.filter(F.col("triggering_txn_count") > part_ids)
    rest = rest.withColumn("triggering_txn_ids", F.lit(None).cast("array<string>"))
    return listed.unionByName(rest.select(*C.AML_ALERT_COLUMNS))


def generate_alerts(hits: DataFrame, run_time: datetime, part_ids: int = PART_IDS) -> DataFrame:
    """:func:`with_ids` of the alerts numbered at ``run_time``.

    ``hits`` is read several times: pass :func:`triggered` of a stored scored table, or
    checkpoint it (``cut_lineage``) so that the windows behind it run once.
    """
    return with_ids(numbered_alerts(hits, run_time), hits, part_ids)


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.sum("triggering_txn_count").alias("txn_count"),
        F.count_distinct("account_id").alias("account_count"),
    )
