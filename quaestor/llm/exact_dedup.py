"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters range-partition the normalised bytes, an external sort places equal texts next to
each other, and a window over the sorted rows compares neighbouring texts in full and finds the
smallest identifier of each run.

The splitters cut between the first ``PREFIX`` bytes, then a hash of the text: equal texts are next to each
other in that order, and texts with one long beginning are still dealt over many tasks.

A text with more than 1 in ``HOT_SHARE`` of all rows is hot. Its rows carry a salt behind it in
the key, so the splitters can cut between them; the run of each salt is one row for the final
minimum. At most ``HOT_SHARE`` texts can be hot, which bounds the two broadcast tables.

Null text counts as empty. Rows with a null ``doc_id`` come last; ``keep_id`` is null only if no row of
the group has an id. Of repeated rows with one ``doc_id`` one stays. Other columns are only read if they are
to be carried along, as one struct, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestor.llm.common import SPACE, stored

HOT_SHARE = 20_000
#: Bytes of the text in the key of the splitters, so that their sample on the driver is small.
PREFIX = 64


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; single spaces need no replacement."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{SPACE}]{{2,}}|[\x09-\x0D]", " ")


def exact_groups(docs: DataFrame, hot_share: int = HOT_SHARE, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The columns named in ``carry`` stay with their row, in the struct ``document``; they also decide between
    equal texts under one ``doc_id``, or under none.
    """
    own = [F.struct(*carry).alias("document")] if carry else []
    with_own = ["document"] if carry else []
    rows = docs.select("doc_id", normalised(F.col("text")).cast("binary").alias("content"), *own)
    rows = rows.withColumn("fingerprint", F.xxhash64("content"))
    total = docs.count()
    hot = (
        rows.groupBy("fingerprint")
        .count()
        .where((F.col("count") > 1) & (F.col("count") * hot_share > total))
        .select("fingerprint", F.ceil(F.col("count") * hot_share / F.lit(max(total, 1))).alias("salts"))
    )
    keyed = rows.join(F.broadcast(hot), "fingerprint", "left").select(
        "doc_id",
        "content",
        F.substring("content", 1, PREFIX).alias("prefix"),
        "fingerprint",
        F.col("salts").isNotNull().alias("hot"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0)).alias("salt"),
        *with_own,
    )
    key = ["prefix", "fingerprint", "salt"]
    last = [F.col("doc_id").asc_nulls_last(), *with_own]
    ranged = keyed.repartitionByRange(*key).sortWithinPartitions(*key, "content", *last)
    run = Window.partitionBy(*key, "content")
    runs = ranged.select(
        "doc_id",
        "hot",
        F.sha2("content", 256).alias("text_sha256"),
        F.row_number().over(run.orderBy(*last)).alias("place"),
        F.min("doc_id").over(run).alias("run_min"),
        F.count(F.lit(1)).over(run).alias("run_rows"),
        *with_own,
    )
    runs = stored(runs, "runs")
    joined = (
        runs.where(F.col("hot") & (F.col("place") == 1))
        .groupBy("text_sha256")
        .agg(F.min("run_min").alias("hot_min"), F.sum("run_rows").alias("hot_rows"))
    )
    keep_id = F.coalesce("hot_min", "run_min")
    return runs.join(F.broadcast(joined), "text_sha256", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("hot_rows", "run_rows").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("place") == 1)).alias("kept"),
        "text_sha256",
        *with_own,
    )
