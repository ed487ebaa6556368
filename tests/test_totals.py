"""Reconciliation, balances and quality metrics."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from quaestor.operators import balance, quality, reconcile
from quaestor.operators.percentiles import exact_percentiles
from quaestor.operators.transform import transform_transactions
from quaestor.params import ReconcileParams
from quaestor.sources.sinks import write_daily_balance, write_rejections_csv

from .conftest import collect, row


def shifted(ledger, by):
    return ledger.withColumn("amount", F.when(F.col("txn_id") == "t1", F.col("amount") + by).otherwise(F.col("amount")))


def test_matching_totals(base_feed):
    clean, ledger = transform_transactions(base_feed)
    recon = reconcile.reconcile(clean, ledger, ReconcileParams(tolerance=0.0))
    assert collect(recon.select(F.col("raw_total").cast("int"), F.col("diff").cast("int"))) == [(50, 0), (80, 0)]


def test_mismatch_raises_and_small_difference_does_not(base_feed):
    clean, ledger = transform_transactions(base_feed)
    with pytest.raises(reconcile.ReconciliationError, match="1 dates"):
        reconcile.reconcile(clean, shifted(ledger, 10))
    recon = reconcile.reconcile(clean, shifted(ledger, 0.005), ReconcileParams(tolerance=0.01))
    diffs = [float(r.diff) for r in recon.collect()]
    assert min(diffs) == -0.005
    loose = reconcile.reconcile(clean, shifted(ledger, 10), ReconcileParams(fail_on_mismatch=False))
    assert reconcile.recon_summary(loose).first().max_abs_diff == 10.0


def test_missing_side_counts_as_zero(base_feed):
    clean, ledger = transform_transactions(base_feed)
    recon = reconcile.reconciliation(clean, ledger.filter("txn_id <> 't3'"))
    bad = reconcile.mismatches(recon).first()
    assert (float(bad.raw_total), float(bad.ledger_total), float(bad.diff)) == (50.0, 0.0, 50.0)


def test_grain(feed):
    df = feed(row("a", txn_date="2024-01-01 08:00"), row("b", txn_date="2024-01-01 09:00"))
    clean, ledger = transform_transactions(df)
    assert reconcile.reconciliation(clean, ledger).count() == 2
    assert reconcile.reconciliation(clean, ledger, "day").count() == 1


def test_reconcile_checks_columns_and_takes_empty(base_feed):
    clean, ledger = transform_transactions(base_feed)
    with pytest.raises(ValueError, match="amount"):
        reconcile.reconcile(clean, ledger.drop("amount"))
    assert reconcile.reconcile(clean.limit(0), ledger.limit(0)).count() == 0


def test_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(f"t{i}", "a", rng.random() * 1e6) for i in range(2000)]
    df = spark.createDataFrame(rows, "txn_id string, account_id string, amount double").withColumn(
        "txn_date", F.lit("2024-01-01").cast("timestamp_ntz")
    )
    totals = {balance.daily_balance(df.repartition(n)).first().total_amount for n in (1, 3, 7)}
    assert len(totals) == 1


def test_daily_balance(spark, feed, tmp_path):
    df = feed(
        row("t1", amount="100"),
        row("t2", amount="50", kind="REFUND"),
        row("t3", amount="-25"),
        row("t5", "acc2", amount="10"),
    )
    _, ledger = transform_transactions(df)
    path = write_daily_balance(balance.daily_balance(ledger), str(tmp_path / "b"))
    got = [(r.account_id, r.total_amount, r.txn_count) for r in spark.read.parquet(path).collect()]
    assert got == [("acc1", 25.0, 3), ("acc2", 10.0, 1)]
    assert collect(balance.daily_balance_sql(ledger), "total_amount") == [(10.0,), (25.0,)]


def test_quality_row(feed):
    df = feed(
        row("t1", amount="10"),
        row("t1", amount="20", ingested="2024-01-05"),
        row(None, amount="30", status="FAILED"),
        row(None, account=None, amount="40"),
    )
    clean, ledger = transform_transactions(df)
    got = quality.quality_metrics(df, clean, ledger).first().asDict(recursive=True)
    assert got["row_counts"] == {"raw_total": 4, "transformed_total": 4, "ledger_total": 3, "skipped_total": 1}
    assert got["rejection_reasons"] == {
        "by_status": {"SUCCESS": 3, "FAILED": 1},
        "total_failed": 1,
        "failure_rate": 0.25,
    }
    flags = got["data_quality_flags"]
    assert (flags["txn_id_missing"], flags["account_id_missing"], flags["duplicate_txn_ids"]) == (2, 1, 2)
    assert flags["late_arrivals"] == 1 and flags["amount_outliers"] == 0
    stats = flags["amount_statistics"]
    assert (stats["count"], stats["mean"], stats["p25"], stats["p50"], stats["p75"]) == (4, 25.0, 17.5, 25.0, 32.5)
    assert stats["std"] == pytest.approx(statistics.stdev([10, 20, 30, 40]))


def test_quality_of_nothing_and_of_one_row(base_feed, feed):
    clean, ledger = transform_transactions(base_feed.limit(0))
    got = quality.quality_metrics(base_feed.limit(0), clean, ledger).first()
    assert got.rejection_reasons.failure_rate == 0 and got.rejection_reasons.by_status == {}
    assert got.data_quality_flags.amount_statistics.p50 is None
    one, kept = transform_transactions(feed(row("t1")))
    assert quality.quality_metrics(one, one, kept).first().data_quality_flags.amount_outliers == 0


def test_approximate_stats(base_feed):
    clean, _ = transform_transactions(base_feed)
    assert quality.amount_stats(clean, approximate=True).first().p50 == 50.0


def test_rejections(spark, feed, tmp_path):
    df = feed(row("t1"), row("t2", status="X", amount="0.125"), row("t3", "acc2", status="Y", amount="0.5"))
    clean, _ = transform_transactions(df)
    report = quality.rejection_report(clean)
    assert [tuple(r) for r in report.collect()] == [("FAILED", 2, 2, 0.62, 0.31)]
    write_rejections_csv(report.limit(0), str(tmp_path / "r"))
    lines = [line for p in (tmp_path / "r").glob("*.csv") for line in p.read_text().splitlines()]
    assert lines == ["status_clean,txn_id_count,account_id_nunique,amount_clean_sum,amount_clean_mean"]


@pytest.mark.parametrize("shape", ["uniform", "ties", "tail", "tiny", "constant", "neighbours"])
def test_narrowed_percentiles_are_exact(spark, shape):
    rng = random.Random(3)
    values = {
        "uniform": [rng.uniform(-50, 50) for _ in range(5001)],
        "ties": [rng.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(4000)],
        "tail": [rng.expovariate(1) ** 8 for _ in range(6000)],
        "tiny": [3.0, 1.0],
        "constant": [4.25] * 3000,
        "neighbours": [1.0 + rng.randrange(40) * 2.0**-52 for _ in range(5000)],
    }[shape]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    fractions = (0.0, 0.25, 0.5, 0.75, 0.99, 1.0)
    built_in = df.agg(F.percentile("x", list(fractions))).first()[0]
    assert exact_percentiles(df, "x", fractions) == pytest.approx(built_in, rel=1e-15)


def test_percentiles_of_values_without_end(spark):
    inf, nan = float("inf"), float("nan")
    values = [-inf, *[float(i) for i in range(5000)], 1e308, -1e308, inf, inf, nan]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    low, middle, high, top = exact_percentiles(df, "x", (0.0, 0.5, (len(values) - 2) / (len(values) - 1), 1.0))
    assert (low, middle, high) == (-inf, sorted(values[:-1])[len(values) // 2 - 1] + 0.5, inf) and top != top
