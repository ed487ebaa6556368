"""Comparing the ledger with the feed it came from, date by date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions.columns import day_start, exact_sum
from quaestor.operators.validate import check_columns
from quaestor.params import ReconcileParams


class ReconciliationError(ValueError):
    """Totals differ by more than the tolerance on some date."""


def _totals(df: DataFrame, amount: str, name: str, grain: str) -> DataFrame:
    key = day_start(F.col("txn_date")) if grain == "day" else F.col("txn_date")
    dated = df.filter(F.col("txn_date").isNotNull())
    return dated.groupBy(key.alias("txn_date")).agg(exact_sum(F.col(amount)).alias(name))


def raw_totals(clean: DataFrame, grain: str = "timestamp") -> DataFrame:
    success = clean.filter(F.col("status_clean") == "SUCCESS")
    return _totals(success, "amount_clean", "raw_total", grain)


def ledger_totals(ledger: DataFrame, grain: str = "timestamp") -> DataFrame:
    return _totals(ledger, "amount", "ledger_total", grain)


def reconciliation(clean: DataFrame, ledger: DataFrame, grain: str = "timestamp") -> DataFrame:
    """Full outer join of both totals on the date; a missing side counts as 0.

    Totals and difference are exact decimals: distributed double sums would differ in their
    last digits from run to run, which a tolerance of zero does not allow.
    """
    check_columns(clean, ["status_clean", "amount_clean", "txn_date"], "raw columns")
    check_columns(ledger, ["amount", "txn_date"], "ledger columns")
    zero = F.lit(0).cast("decimal(38,10)")
    joined = raw_totals(clean, grain).join(ledger_totals(ledger, grain), "txn_date", "full_outer")
    return joined.select(
        "txn_date",
        F.coalesce("raw_total", zero).alias("raw_total"),
        F.coalesce("ledger_total", zero).alias("ledger_total"),
    ).withColumn("diff", F.col("raw_total") - F.col("ledger_total"))


def mismatches(recon: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Dates whose difference exceeds the tolerance (strictly)."""
    return recon.filter(F.abs("diff") > F.lit(str(tolerance)).cast("decimal(28,10)"))


def recon_summary(recon: DataFrame) -> DataFrame:
    return recon.agg(
        F.count(F.lit(1)).alias("dates_compared"),
        F.max(F.abs("diff")).cast("double").alias("max_abs_diff"),
    )


def reconcile(clean: DataFrame, ledger: DataFrame, params: ReconcileParams = ReconcileParams()) -> DataFrame:
    """The reconciliation table; raises on a mismatch unless told not to."""
    recon = reconciliation(clean, ledger, params.grain)
    if params.fail_on_mismatch:
        raise_on_mismatch(recon, params.tolerance)
    return recon


def raise_on_mismatch(recon: DataFrame, tolerance: float) -> None:
    bad = mismatches(recon, tolerance)
    sample = bad.orderBy("txn_date").limit(10).collect()
    if sample:
        lines = "\n".join(f"{r.txn_date}: {r.raw_total} vs {r.ledger_total}" for r in sample)
        raise ReconciliationError(f"Reconciliation failed on {bad.count()} dates, first:\n{lines}")
