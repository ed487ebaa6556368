"""Balance per account and date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.columns import exact_sum

_METRICS = {
    "sum": lambda c: exact_sum(F.col(c)).cast("double"),
    "count": lambda c: F.count(c),
}
_SOURCE = {"sum": "amount", "count": "txn_id"}


def daily_balance(
    ledger: DataFrame,
    group_by: tuple[str, ...] = ("account_id", "txn_date"),
    metrics: dict[str, str] | None = None,
) -> DataFrame:
    """Sum of ``amount`` and count of non-null ``txn_id`` per group; null keys are left out.

    ``metrics`` names other outputs, as ``{output: "sum" | "count"}``. Unordered: the order is
    made where the table is written.
    """
    metrics = metrics or {"total_amount": "sum", "txn_count": "count"}
    keyed = ledger.dropna(subset=list(group_by))
    aggregates = [_METRICS[kind](_SOURCE[kind]).alias(name) for name, kind in metrics.items()]
    return keyed.groupBy(*group_by).agg(*aggregates)


def daily_balance_sql(ledger: DataFrame) -> DataFrame:
    """The same balance as a SQL statement over a view of the ledger, counting all rows."""
    return ledger.sparkSession.sql(
        """
        SELECT account_id, txn_date,
               CAST(SUM(CAST(amount AS DECIMAL(28,10))) AS DOUBLE) AS total_amount,
               COUNT(*) AS txn_count
        FROM {ledger}
        GROUP BY account_id, txn_date
        """,
        ledger=ledger,
    )
