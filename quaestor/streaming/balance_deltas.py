"""Daily balances kept up to date from deltas: what a batch adds, not what all batches have left.

Each micro-batch is summed by day, account and date, and only these sums are written: one folder per touched day, named by
the commit that adds them (:mod:`quaestor.sources.commits`). A day with more than ``MAX_FOLDERS`` folders is compacted in the
same commit: its sums are merged into one folder, which replaces the others, day by day. So a batch reads nothing but its
own rows and the sums of the few days it compacts, and a day never has more than ``MAX_FOLDERS`` + 1 folders. Sums are
exact decimals and counts are whole, so merging them in any order gives the same result.

The manifest notes the last batch of the stream; a retried batch that was committed already changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaestor.functions.columns import exact_sum
from quaestor.sources import commits, fs

KEYS = ("txn_day", "account_id", "txn_date")
MAX_FOLDERS = 4
#: Files a day and commit, for days of very many accounts.
FILES = 4
MONEY = "decimal(38,10)"
SCHEMA = f"account_id string, txn_date timestamp_ntz, total_amount {MONEY}, txn_count long"


def deltas(ledger: DataFrame) -> DataFrame:
    """Sums and counts by day, account and date; rows without account or date are in no balance."""
    keyed = ledger.dropna(subset=["account_id", "txn_date"]).withColumn("txn_day", F.to_date("txn_date"))
    amount = exact_sum(F.col("amount")).cast(MONEY).alias("total_amount")
    return keyed.groupBy(*KEYS).agg(amount, F.count("txn_id").alias("txn_count"))


def _write_days(sums: DataFrame, path: str) -> tuple[str, list[str]]:
    """Write sums by day; returns the folder and the days in it."""
    spark, folder = sums.sparkSession, commits.new_folder()
    dealt = sums.repartition("txn_day", F.pmod(F.xxhash64("account_id"), F.lit(FILES)))
    dealt.write.partitionBy("txn_day").parquet(f"{path}/{folder}")
    found = fs.names(spark, f"{path}/{folder}")
    return folder, [n.removeprefix("txn_day=") for n in found if n.startswith("txn_day=")]


def _merged(spark: SparkSession, path: str, parts: dict[str, list[str]]) -> DataFrame:
    """All sums of some days."""
    pieces = [f"{path}/{folder}" for folders in parts.values() for folder in folders]
    sums = spark.read.schema(SCHEMA).parquet(*pieces)
    total = F.sum("total_amount").cast(MONEY).alias("total_amount")
    by_day = sums.withColumn("txn_day", F.to_date("txn_date")).groupBy(*KEYS)
    return by_day.agg(total, F.sum("txn_count").alias("txn_count"))


def add_batch(batch: DataFrame, batch_id: int, path: str, max_folders: int = MAX_FOLDERS) -> commits.Manifest:
    """Commit the deltas of a batch, and compact the days that have too many."""
    spark, path = batch.sparkSession, path.rstrip("/")
    base = commits.manifest(spark, path)
    if base is not None and base.notes["batch"] >= batch_id:
        return base
    folder, days = _write_days(deltas(batch), path)
    parts = {day: list(folders) for day, folders in (base.parts if base else {}).items()}
    for day in days:
        parts.setdefault(day, []).append(f"{folder}/txn_day={day}")
    full = {day: parts[day] for day in days if len(parts[day]) > max_folders}
    if full:
        folder, merged = _write_days(_merged(spark, path, full), path)
        parts.update({day: [f"{folder}/txn_day={day}"] for day in merged})
    schema = spark.createDataFrame([], SCHEMA).schema.json()
    return commits.publish(
        spark, path, commits.Manifest(base.version + 1 if base else 0, schema, parts, {"batch": batch_id})
    )


def run_balance_deltas(
    ledger: DataFrame, path: str, checkpoint: str, max_folders: int = MAX_FOLDERS
) -> StreamingQuery:
    """Add everything available now, batch by batch, and stop."""
    return (
        ledger.writeStream.foreachBatch(lambda batch, number: add_batch(batch, number, path, max_folders) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def balances(spark: SparkSession, path: str, version: int | None = None, days: list[str] | None = None) -> DataFrame:
    """account_id, txn_date, total_amount, txn_count at the newest or an older version, of some days if named."""
    sums = commits.read(spark, path, version, days)
    total = F.sum("total_amount").cast("double").alias("total_amount")
    return sums.groupBy("account_id", "txn_date").agg(total, F.sum("txn_count").alias("txn_count"))
