"""Reading raw feeds and ledgers, and presenting other tables as a transaction feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor import constants as C
from quaestor.functions.columns import lenient_timestamp, na_to_null
from quaestor.operators.validate import check_columns
from quaestor.sources import fs


def feed_schema(columns=C.REQUIRED_COLUMNS) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_options(multi_line: bool = False) -> dict:
    """How batch and stream read CSV: the header is checked against the columns, quotes are doubled."""
    return {"header": True, "enforceSchema": False, "escape": '"', "multiLine": multi_line}


def read_feed_csv(
    spark: SparkSession, path: str, columns=C.REQUIRED_COLUMNS, multi_line: bool = False
) -> DataFrame:
    """Read a CSV feed with a header; every value stays text, NA words become null.

    Column names come from the header, so extra columns are kept and no schema is inferred
    from the values; every file's header must agree. Files are split by Spark, so there is no
    chunk size to choose. ``multi_line`` allows line breaks inside quotes, at the price of
    reading each file in one task.
    """
    if not fs.exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.options(**csv_options(multi_line)).csv(path)
    check_columns(df, columns)
    return df.withColumns({c: na_to_null(F.col(c)) for c in columns})


def read_ledger(spark: SparkSession, path: str, validate_schema: bool = True) -> DataFrame:
    """Read a Parquet ledger (file or folder) and check its eight columns."""
    if not fs.exists(spark, path):
        raise FileNotFoundError(path)
    if not fs.is_dir(spark, path) and not path.endswith(".parquet"):
        raise ValueError(f"not a Parquet file: {path}")
    df = spark.read.parquet(path)
    if validate_schema:
        check_columns(df, C.LEDGER_COLUMNS)
    dates = [c for c in ("txn_date", "ingestion_date") if c in df.columns]
    return df.withColumns({c: lenient_timestamp(F.col(c), df.schema[c].dataType) for c in dates})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recode(c: Column, mapping: dict[str, str]) -> Column:
    pairs = iter(mapping.items())
    key, value = next(pairs)
    out = F.when(c == key, value)
    for key, value in pairs:
        out = out.when(c == key, value)
    return out


def orders_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a feed: one transaction per line, account per customer, dates only."""
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("txn_id"),
        F.concat(F.lit("acc"), "o_custkey").alias("account_id"),
        F.col("o_orderdate").alias("txn_date"),
        F.col("l_shipdate").alias("ingestion_date"),
        F.col("l_extendedprice").alias("amount"),
        F.lit("EUR").alias("currency"),
        _recode(F.col("l_returnflag"), {"R": "REFUND", "A": "CARD", "N": "TRANSFER"}).alias("txn_type"),
        _recode(F.col("o_orderstatus"), {"F": "COMPLETED", "O": "SETTLED", "P": "PENDING"}).alias("status"),
    )


def events_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a feed with time of day, mixed-case words and round amounts."""
    return as_feed(table(spark, sf_dir, "events"))


def as_feed(events: DataFrame, *extra: str) -> DataFrame:
    """A batch or stream of events as a feed, with further event columns if named."""
    kind = F.col("event_type")
    amount = F.round("value") * 100
    day = F.to_date("ts")
    late_by = (F.col("event_id") % 3).cast("int")
    statuses = F.array(*[F.lit(s) for s in ("COMPLETED", "settled", "OK", "PENDING", "FAILED")])
    types = {
        "purchase": "CARD",
        "error": "refund",
        "click": "TRANSFER",
        "view": "DEPOSIT",
        "signup": "PAYMENT",
    }
    return events.select(
        F.concat(F.lit("e"), "event_id").alias("txn_id"),
        F.concat(F.lit("acc"), "user_id").alias("account_id"),
        F.col("ts").alias("txn_date"),
        F.date_add(day, late_by).cast("timestamp_ntz").alias("ingestion_date"),
        F.when(kind == "signup", -amount).otherwise(amount).alias("amount"),
        F.lit("EUR").alias("currency"),
        _recode(kind, types).alias("txn_type"),
        F.get(statuses, (F.col("event_id") % 5).cast("int")).alias("status"),
        *extra,
    )
