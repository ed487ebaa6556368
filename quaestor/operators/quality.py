"""Data-quality metrics of a run and the rejection report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import exact_sum, half_even
from quaestor.operators.percentiles import Spread, exact_percentiles
from quaestor.session import stored, stored_copy


def row_counts(raw: DataFrame, clean: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row: rows in the feed, in the clean set, in the ledger, and those skipped."""
    sizes = (
        raw.agg(F.count(F.lit(1)).alias("n"), F.lit("raw").alias("part"))
        .unionByName(clean.agg(F.count(F.lit(1)).alias("n"), F.lit("clean").alias("part")))
        .unionByName(ledger.agg(F.count(F.lit(1)).alias("n"), F.lit("ledger").alias("part")))
    )
    size = lambda part: F.sum(F.when(F.col("part") == part, F.col("n")))
    return sizes.agg(
        size("raw").alias("raw_total"),
        size("clean").alias("transformed_total"),
        size("ledger").alias("ledger_total"),
        (size("clean") - size("ledger")).alias("skipped_total"),
    )


def status_counts(clean: DataFrame) -> DataFrame:
    """Rows per ``status_clean``."""
    return clean.groupBy("status_clean").agg(F.count(F.lit(1)).alias("row_count"))


def failure_rate(clean: DataFrame) -> DataFrame:
    """One row: number of failed rows and their share (0 for an empty set)."""
    total = F.count(F.lit(1))
    failed = F.count_if(F.col("status_clean") != "SUCCESS")
    return clean.agg(
        failed.alias("total_failed"),
        F.coalesce(failed / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("failure_rate"),
    )


def null_flags(clean: DataFrame) -> DataFrame:
    present = [c for c in C.QUALITY_NULL_COLUMNS if c in clean.columns]
    return clean.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in present])


def duplicate_count(clean: DataFrame, column: str = "txn_id") -> DataFrame:
    """One row: rows beyond the first of each value; nulls count as one value."""
    per_value = clean.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_value.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"duplicate_{column}s"))


def late_count(clean: DataFrame) -> DataFrame:
    return clean.agg(F.count_if("is_late").alias("late_arrivals"))


def _moments(x: Column) -> list[Column]:
    return [
        F.count(x).alias("count"),
        (exact_sum(x).cast("double") / F.nullif(F.count(x), F.lit(0))).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]


_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
_STATS_SCHEMA = "count bigint, " + ", ".join(f"{name} double" for name in _STATS[1:])


def amount_stats(clean: DataFrame, column: str = "amount_clean", approximate: bool = False) -> DataFrame:
    """One row: count, mean, sample standard deviation, min, quartiles, max.

    Exact quartiles by default: the column is stored once and read twice, as a rule. ``approximate=True``
    takes Spark's sketch, all in one pass and without a copy.
    """
    x = F.col(column).cast("double")
    if approximate:
        quartiles = F.percentile_approx(x, [0.25, 0.5, 0.75]).alias("_quartiles")
        named = [F.get("_quartiles", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
        return clean.agg(*_moments(x), quartiles).select("*", *named).select(*_STATS)
    with stored_copy(clean.select(x.alias(column)), "amounts") as amounts:
        found = amounts.agg(*_moments(F.col(column)), *Spread.columns(F.col(column))).first().asDict()
        values = _with_quartiles(amounts, column, found)
    return clean.sparkSession.createDataFrame([values], _STATS_SCHEMA)


def _with_quartiles(clean: DataFrame, column: str, first_pass: dict) -> tuple:
    quartiles = exact_percentiles(clean, column, spread=Spread.of(first_pass))
    named = first_pass | dict(zip(("p25", "p50", "p75"), quartiles))
    return tuple(named[name] for name in _STATS)


def _far(x: Column, mean: float | None, std: float | None, sigmas: float) -> Column:
    """Further than ``sigmas`` deviations from the mean; null, hence not counted, without any."""
    limit = F.lit(None if std is None else sigmas * std).cast("double")
    return F.abs(x - F.lit(mean).cast("double")) > limit


def outlier_count(clean: DataFrame, column: str = "amount_clean", sigmas: float = 3.0) -> DataFrame:
    """One row: values further than ``sigmas`` standard deviations from the mean.

    Mean and deviation come from a first pass (two numbers); counting is a second one. With fewer
    than two rows the deviation is null and there are no outliers.
    """
    x = F.col(column).cast("double")
    mean, std = clean.agg(F.avg(x), F.stddev_samp(x)).first()
    return clean.agg(F.count_if(_far(x, mean, std, sigmas)).alias("amount_outliers"))


def rejection_report(clean: DataFrame) -> DataFrame:
    """Non-successful rows per status: rows, distinct accounts, sum and mean of the amount."""
    total = exact_sum(F.col("amount_clean")).cast("double")
    return (
        clean.filter(F.col("status_clean") != "SUCCESS")
        .groupBy("status_clean")
        .agg(
            F.count("txn_id").alias("txn_id_count"),
            F.count_distinct("account_id").alias("account_id_nunique"),
            half_even(total).alias("amount_clean_sum"),
            half_even(total / F.count("amount_clean")).alias("amount_clean_mean"),
        )
    )


def quality_metrics(raw: DataFrame, clean: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row with all metrics: nested structs, and a map for rows per status.

    The columns needed of ``clean`` are stored once. A pass over them counts everything that can be
    counted at once, one settles the quartiles, and the last one counts the outliers, with the
    duplicate ids (a shuffle on the id) and the sizes of the other two tables as scalar subqueries.
    """
    x = F.col("amount_clean").cast("double")
    nulls = [c for c in C.QUALITY_NULL_COLUMNS if c in clean.columns]
    clean = stored(clean.select(*dict.fromkeys(("txn_id", "amount_clean", "status_clean", "is_late", *nulls))), "quality")
    found = (
        clean.agg(
            *_moments(x),
            *Spread.columns(x),
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("status_clean") == "SUCCESS").alias("SUCCESS"),
            F.count_if(F.col("status_clean") == "FAILED").alias("FAILED"),
            *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in nulls],
            F.count_if("is_late").alias("late_arrivals"),
        )
        .first()
        .asDict()
    )
    stats = zip(_STATS, _with_quartiles(clean, "amount_clean", found))
    by_status = [F.lit(v) for s in ("SUCCESS", "FAILED") if found[s] for v in (s, found[s])]
    total, failed = found["total"], found["FAILED"]
    ledger_rows = ledger.agg(F.count(F.lit(1))).scalar()

    def number(name: str) -> Column:
        return F.lit(found[name]).cast("bigint").alias(name)

    return clean.agg(F.count_if(_far(x, found["mean"], found["std"], 3.0)).alias("outliers")).select(
        F.struct(
            raw.agg(F.count(F.lit(1))).scalar().alias("raw_total"),
            F.lit(total).cast("bigint").alias("transformed_total"),
            ledger_rows.alias("ledger_total"),
            (F.lit(total).cast("bigint") - ledger_rows).alias("skipped_total"),
        ).alias("row_counts"),
        F.struct(
            F.create_map(*by_status).cast("map<string,bigint>").alias("by_status"),
            F.lit(failed).cast("bigint").alias("total_failed"),
            F.lit(failed / total if total else 0.0).alias("failure_rate"),
        ).alias("rejection_reasons"),
        F.struct(
            *[number(f"{c}_missing") for c in nulls],
            duplicate_count(clean).scalar().alias("duplicate_txn_ids"),
            number("late_arrivals"),
            F.struct(
                *[F.lit(v).cast("bigint" if n == "count" else "double").alias(n) for n, v in stats]
            ).alias("amount_statistics"),
            F.col("outliers").alias("amount_outliers"),
        ).alias("data_quality_flags"),
    )
