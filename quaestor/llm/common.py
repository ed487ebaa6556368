"""Helpers shared by the operators: the shared folder, stored tables, words, and running offsets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaestor.sources import fs

#: White space and words, as Java and Python patterns.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset (tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps survive lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` returned, once no later step reads them."""
    for table in tables:
        fs.remove(table.sparkSession, table.stored_path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(rows: int, rows_per_bucket: int = 50_000) -> int:
    """How many buckets a key is dealt over, so that a key with all rows still has small groups."""
    return max(256, -(-rows // rows_per_bucket))


def running_offsets(
    df: DataFrame, keys: list[str], order: list[str], value: Column, buckets: int, name: str
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the same ``keys`` that come earlier.

    The order is pseudorandom bucket by bucket (a hash of ``order``) and by ``order`` within a bucket.
    A key is dealt over ``buckets`` groups, whose totals are summed first; so no task holds all rows of
    a hot key. Null keys are a key of their own. ``df`` must not change between two reads.
    """
    dealt = df.withColumns({"_bucket": F.pmod(F.xxhash64(*order), F.lit(buckets)), "_value": value})
    totals = dealt.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"),
    )
    on = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = (
        Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    own = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return (
        own.join(starts, on)
        .withColumn(name, (F.col("_start") + F.col("_own")).cast("long"))
        .drop("_bucket", "_value", "_own", "_start", "_b", *[f"_k{i}" for i in range(len(keys))])
    )
