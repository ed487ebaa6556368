"""From a raw feed to the clean set and the ledger of successful transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import day_start, lenient_timestamp, or_false, signed_amount, success_or_failed
from quaestor.operators.validate import check_columns, unreadable_dates
from quaestor.params import FeedParams


def parse_dates(raw: DataFrame, params: FeedParams = FeedParams()) -> DataFrame:
    """Dates as zone-free timestamps; ``ingestion_date`` at midnight. Unreadable -> null."""
    parsed = {
        c: lenient_timestamp(F.col(c), raw.schema[c].dataType, params.date_format)
        for c in ("txn_date", "ingestion_date")
    }
    parsed["ingestion_date"] = day_start(parsed["ingestion_date"])
    return raw.withColumns(parsed)


def clean_transactions(raw: DataFrame, params: FeedParams = FeedParams()) -> DataFrame:
    """All rows and columns of the feed plus ``status_clean``, ``amount_clean``, ``is_late``."""
    dated = parse_dates(raw, params)
    days_late = F.datediff(F.to_date("ingestion_date"), F.to_date("txn_date"))
    return dated.withColumns(
        {
            "status_clean": success_or_failed(F.col("status"), params.success_statuses),
            "amount_clean": signed_amount(
                F.col("amount"), raw.schema["amount"].dataType, F.col("txn_type"), params.refund_types
            ),
            "is_late": or_false(days_late > params.late_days),
        }
    )


def ledger_of(clean: DataFrame) -> DataFrame:
    """Successful rows, eight columns, ``amount_clean`` as ``amount``."""
    return (
        clean.filter(F.col("status_clean") == "SUCCESS")
        .drop("amount")
        .withColumnRenamed("amount_clean", "amount")
        .select(*C.LEDGER_COLUMNS)
    )


def transform_transactions(
    raw: DataFrame, params: FeedParams = FeedParams(), validate: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The lazy pair (clean, ledger). ``validate=True`` runs one pass that raises on bad dates;
    leave it off where :func:`quaestor.operators.validate.validate_feed` has run."""
    check_columns(raw, params.required_columns)
    if validate:
        bad = unreadable_dates(raw, params).first().asDict()
        for c in ("txn_date", "ingestion_date"):
            if bad[f"{c}_unreadable"]:
                raise ValueError(f"Invalid {c} in {bad[f'{c}_unreadable']} rows")
    clean = clean_transactions(raw, params)
    return clean, ledger_of(clean)
