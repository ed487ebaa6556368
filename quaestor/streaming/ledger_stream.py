"""Incremental forms of the batch operators, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from quaestor.functions.columns import event_time, exact_sum, micros, na_to_null, zone_free
from quaestor.operators import events
from quaestor.operators.balance import daily_balance
from quaestor.operators.transform import clean_transactions, ledger_of
from quaestor.params import FeedParams, SkewParams, TrustParams
from quaestor.sources import fs
from quaestor.sources.feed import csv_options, feed_schema


def stream_feed(
    spark: SparkSession, folder: str, params: FeedParams = FeedParams(), max_files: int | None = None
) -> DataFrame:
    """New CSV files of a folder as a stream of text columns; NA words become null.

    Options are those of the batch reader. A stream has one schema, so a file whose header has other
    columns or another order is an error, never read by position.
    """
    reader = spark.readStream.schema(feed_schema(params.required_columns)).options(**csv_options())
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.csv(folder)
    return raw.withColumns({c: na_to_null(F.col(c)) for c in raw.columns})


def stream_ledger(raw: DataFrame, params: FeedParams = FeedParams()) -> DataFrame:
    """The ledger rows of a streamed feed: the same projections and filter as in batch."""
    return ledger_of(clean_transactions(raw, params))


def deduplicate(ledger: DataFrame, delay: str | None = None) -> DataFrame:
    """Keep the first row of each ``txn_id``, however late it or its copies arrive.

    The state holds every id seen, dealt over the shuffle partitions. Where that is too much, ``delay``
    bounds it: rows later than that are dropped then, and copies further apart both stay.
    """
    if delay is None:
        return ledger.dropDuplicates(["txn_id"])
    timed = ledger.withColumn("_at", event_time(F.col("txn_date"))).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(["txn_id"]).drop("_at")


def run_to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available now to a Parquet table, exactly once, and stop."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_to_versions(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what each batch has changed to a folder of its own (a retried batch replaces it), and stop.

    So groups are there from their first row on, not only once the watermark has closed them.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def newest_versions(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The last version of each group that :func:`run_to_versions` has written with ``schema``."""
    versioned = StructType([*schema.fields, StructField("batch", LongType())])
    stored = spark.read.option("basePath", path).schema(versioned).parquet(path)
    values = [f for f in stored.columns if f not in (*keys, "batch")]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_newest"))
    return newest.select(*keys, "_newest.*")


def repair_balances(ledger: DataFrame, ledger_path: str, balance_path: str, checkpoint: str) -> StreamingQuery:
    """Keep daily balances right under late data, recomputing only the days a batch touches.

    Each micro-batch writes its rows to a folder of its own (a retried batch replaces it), then
    the balances of the touched days are rebuilt from all rows of these days and replace just
    those day partitions.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("txn_day", F.to_date("txn_date"))
        dated.write.mode("overwrite").partitionBy("txn_day").parquet(f"{ledger_path}/batch={batch_id}")
        written = spark.read.schema(dated.schema).parquet(f"{ledger_path}/batch={batch_id}")
        # Days, not rows: as a list of constants they prune the partitions that are read.
        touched = [r.txn_day for r in written.select("txn_day").distinct().collect()]
        everything = spark.read.option("basePath", ledger_path).schema(dated.schema).parquet(ledger_path)
        balance = daily_balance(everything.filter(F.col("txn_day").isin(touched)))
        balance = balance.withColumn("txn_day", F.to_date("txn_date"))
        (
            balance.repartition("txn_day", F.pmod(F.xxhash64("account_id"), F.lit(16)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("txn_day")
            .parquet(balance_path)
        )

    return (
        ledger.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def event_time_velocity(
    ledger: DataFrame, length: str = "7 days", step: str = "1 day", delay: str = "7 days"
) -> DataFrame:
    """Count and sum per account over sliding event-time windows. Each row is combined with its
    account's window state before the shuffle."""
    return (
        ledger.withColumn("_at", event_time(F.col("txn_date")))
        .withWatermark("_at", delay)
        .groupBy(F.window("_at", length, step), "account_id")
        .agg(F.count("txn_id").alias("txn_count"), exact_sum(F.abs("amount")).alias("amount_sum"))
        .select(
            "account_id",
            zone_free(F.col("window.start")).alias("window_start"),
            zone_free(F.col("window.end")).alias("window_end"),
            "txn_count",
            F.col("amount_sum").cast("double").alias("amount_sum"),
        )
    )


def throttle_stream(
    alerts: DataFrame,
    tie: str,
    sent_path: str,
    state_path: str,
    checkpoint: str,
    params: TrustParams = TrustParams(),
    skew: SkewParams = SkewParams(),
) -> StreamingQuery:
    """Send the events of a stream: filter, throttle and number them batch by batch.

    Each micro-batch goes through the batch operator, so that a key of any size is split there
    too. What carries over is a table with the last sent time per key, one version per batch: a
    retried batch reads the version before it and writes the same rows again. An event that
    arrives in a later batch but is older than the last sent one can no longer take its place;
    those that pass the filter are kept in ``<sent_path>_late``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before, after = f"{state_path}/batch={batch_id - 1}", f"{state_path}/batch={batch_id}"
        known = spark.read.parquet(before) if fs.exists(spark, before) else None
        sent = events.send_events(batch, tie, params, skew, known)
        if known is not None:
            late = events.filter_severity(batch, params.severity_filter).withColumn("_key", events.throttle_key())
            late = late.join(known, (late["_key"] == known.key) & (micros(F.col("event_at")) < known.last_us), "left_semi")
            late.drop("_key").write.mode("overwrite").parquet(f"{sent_path}_late/batch={batch_id}")
        sent.write.mode("overwrite").parquet(f"{sent_path}/batch={batch_id}")
        written = spark.read.schema(sent.schema).parquet(f"{sent_path}/batch={batch_id}")
        latest = written.select(events.throttle_key().alias("key"), micros(F.col("event_at")).alias("last_us"))
        if known is not None:
            latest = latest.unionByName(known)
        latest.groupBy("key").agg(F.max("last_us").alias("last_us")).write.mode("overwrite").parquet(after)
        fs.remove(spark, f"{state_path}/batch={batch_id - 2}")

    return (
        alerts.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
