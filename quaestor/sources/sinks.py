"""Writers. A Parquet target is replaced as a whole, after its new content is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.operators.validate import validate_ledger_ids
from quaestor.sources import commits, fs


def replace_parquet(df: DataFrame, path: str, compression: str = "snappy") -> str:
    """Write next to ``path``, then swap folders: readers see the old or the new table."""
    spark, path = df.sparkSession, path.rstrip("/")
    run = uuid.uuid4().hex[:12]
    staged, old = f"{path}.__stage_{run}", f"{path}.__old_{run}"
    df.write.option("compression", compression).parquet(staged)
    had_old = fs.exists(spark, path)
    if had_old:
        fs.rename(spark, path, old)
    try:
        fs.rename(spark, staged, path)
    except Exception:
        if had_old:
            fs.rename(spark, old, path)
        raise
    fs.remove(spark, old)
    return path


def write_ledger(ledger: DataFrame, path: str, compression: str = "snappy") -> str:
    """Check the ids (present, not null, unique), then replace the ledger table."""
    validate_ledger_ids(ledger)
    return replace_parquet(ledger, path, compression)


def commit_ledger(ledger: DataFrame, path: str, base: commits.Manifest | None) -> commits.Manifest:
    """Check the ids, then commit the ledger as the version after ``base`` of a table with a commit log."""
    validate_ledger_ids(ledger)
    return commits.commit(ledger, path, base)


def write_daily_balance(balance: DataFrame, path: str) -> str:
    """Replace the balance table, in total order by account and date."""
    return replace_parquet(balance.orderBy("account_id", "txn_date"), path)


def write_aml_alerts(alerts: DataFrame, path: str) -> str:
    """Replace the alert table; the id list is stored as one comma-joined string."""
    joined = alerts.withColumn("triggering_txn_ids", F.array_join("triggering_txn_ids", ","))
    return replace_parquet(joined, path)


def write_report_json(rows: DataFrame, path: str) -> str:
    """Write a report (few rows: metrics, violations, summaries) as JSON lines."""
    rows.write.mode("overwrite").json(path)
    return path


def write_contract_report(report: DataFrame, path: str) -> str:
    """Store a contract's result and violations as one JSON document in a folder of its own."""
    return write_report_json(report.coalesce(1), path)


def read_contract_report(spark: SparkSession, path: str) -> DataFrame:
    """A stored report with its types."""
    violation = "constraint_type: string, column_name: string, message: string, severity: string, violation_count: bigint"
    counts = "error_count bigint, warning_count bigint, row_count bigint, column_count int"
    schema = f"contract_name string, version string, status string, {counts}, violations array<struct<{violation}>>"
    return spark.read.schema(schema).json(path)


def append_events_json(rows: DataFrame, path: str) -> str:
    """Append rows (lineage nodes, events, drift, SLA checks) to a JSON table."""
    rows.write.mode("append").json(path)
    return path


def write_rejections_csv(report: DataFrame, path: str) -> str:
    """Write the rejection report; one header per file, also when there are no rows.

    The report has one row per status, so a single output file is in order.
    """
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
