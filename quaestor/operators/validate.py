"""Checks on a raw feed and on a ledger, as row-returning operators and as fail-fast calls."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import amount_number, lenient_timestamp
from quaestor.params import FeedParams

# How many offending values an error message quotes; the operators below return all of them.
MESSAGE_VALUES = 20


def check_columns(df: DataFrame, required: Iterable[str], what: str = "columns") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required {what}: {missing}")


def duplicate_ids(df: DataFrame, column: str = "txn_id") -> DataFrame:
    """Values that occur more than once, with their count. Nulls form one group."""
    return (
        df.groupBy(column).agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")
    )


def null_counts(df: DataFrame, columns: Iterable[str] = C.NOT_NULL_COLUMNS) -> DataFrame:
    """One row with ``<column>_nulls`` for each column."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns])


def _bad_type(valid: Iterable[str]):
    """A transaction type outside the list, ignoring case but not blanks."""
    upper_valid = [v.upper() for v in valid]
    return ~F.upper("txn_type").isin(*upper_valid)


def invalid_txn_types(df: DataFrame, valid: Iterable[str] = C.VALID_TXN_TYPES) -> DataFrame:
    return (
        df.filter(_bad_type(valid)).groupBy("txn_type").agg(F.count(F.lit(1)).alias("occurrences"))
    )


def violations(df: DataFrame, params: FeedParams = FeedParams()) -> DataFrame:
    """Rows ``(txn_id, check, detail)``: each duplicated id, and each row with a missing value
    or an unknown transaction type."""
    checks = [
        F.when(F.col(c).isNull(), F.struct(F.lit("not_null").alias("check"), F.lit(c).alias("detail")))
        for c in C.NOT_NULL_COLUMNS
    ]
    if params.valid_txn_types is not None:
        checks.append(
            F.when(
                _bad_type(params.valid_txn_types),
                F.struct(F.lit("txn_type").alias("check"), F.col("txn_type").alias("detail")),
            )
        )
    by_row = df.select("txn_id", F.inline(F.array_compact(F.array(*checks))))
    by_id = duplicate_ids(df).select(
        "txn_id", F.lit("duplicate_id").alias("check"), F.col("occurrences").cast("string").alias("detail")
    )
    return by_id.unionByName(by_row)


def unreadable_dates(df: DataFrame, params: FeedParams = FeedParams()) -> DataFrame:
    """One row: how many values of each date column are missing or not a date."""
    return df.agg(*_date_counts(df, params))


def _date_counts(df: DataFrame, params: FeedParams):
    return [
        F.count_if(
            lenient_timestamp(F.col(c), df.schema[c].dataType, params.date_format).isNull()
        ).alias(f"{c}_unreadable")
        for c in ("txn_date", "ingestion_date")
    ]


def unreadable_amounts(df: DataFrame) -> DataFrame:
    """One row: how many amounts are present but no finite number in range (the strict reading)."""
    return df.agg(_amount_count(df))


def _amount_count(df: DataFrame):
    amount = F.col("amount")
    number = amount_number(amount, df.schema["amount"].dataType)
    return F.count_if(amount.isNotNull() & number.isNull()).alias("amount_unreadable")


def _quoted(df: DataFrame, column: str) -> str:
    values = [r[0] for r in df.select(column).limit(MESSAGE_VALUES + 1).collect()]
    more = ", ..." if len(values) > MESSAGE_VALUES else ""
    return f"[{', '.join(map(repr, values[:MESSAGE_VALUES]))}{more}]"


def validate_feed(df: DataFrame, params: FeedParams = FeedParams(), strict_amounts: bool = False) -> DataFrame:
    """Raise on the first failing check: columns, duplicate ids, missing values, types, dates.

    Missing values, types, dates and amounts are counted in one pass over the feed; the
    duplicate check is one shuffle on the id.
    """
    check_columns(df, params.required_columns)
    duplicates = duplicate_ids(df)
    if not duplicates.isEmpty():
        raise ValueError(f"Duplicate txn_id values: {_quoted(duplicates, 'txn_id')}")
    counts = [F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in C.NOT_NULL_COLUMNS]
    if params.valid_txn_types is not None:
        counts.append(F.count_if(_bad_type(params.valid_txn_types)).alias("bad_types"))
    counts += _date_counts(df, params)
    counts.append(_amount_count(df))
    found = df.agg(*counts).first().asDict()
    for c in C.NOT_NULL_COLUMNS:
        if found[f"{c}_nulls"]:
            raise ValueError(f"Column {c} has {found[f'{c}_nulls']} null values")
    if found.get("bad_types"):
        bad = invalid_txn_types(df, params.valid_txn_types)
        raise ValueError(f"Invalid txn_type values: {_quoted(bad, 'txn_type')}")
    for c in ("txn_date", "ingestion_date"):
        if found[f"{c}_unreadable"]:
            raise ValueError(f"Invalid {c} in {found[f'{c}_unreadable']} rows")
    if strict_amounts and found["amount_unreadable"]:
        raise ValueError(f"Invalid amount in {found['amount_unreadable']} rows")
    return df


def validate_ledger_ids(ledger: DataFrame) -> DataFrame:
    """Raise if the ledger's ``txn_id`` is absent, null anywhere, or not unique."""
    check_columns(ledger, ["txn_id"], "ledger columns")
    nulls = null_counts(ledger, ["txn_id"]).first()[0]
    if nulls:
        raise ValueError(f"Ledger has {nulls} null txn_id values")
    duplicates = duplicate_ids(ledger)
    if not duplicates.isEmpty():
        raise ValueError(f"Duplicate txn_id values: {_quoted(duplicates, 'txn_id')}")
    return ledger
