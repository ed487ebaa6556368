"""Contiguous numbers in a total order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor.session import cut_lineage


def number_in_order(df: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """Add ``name`` = 1, 2, 3, ... by ``order``, which must be unique per row.

    The rows are range-sorted once and checkpointed, so partitions stay as they are. A row's
    number is its place within its partition plus the sizes of the partitions before it; only
    the partition sizes (one row per partition) are summed up in one task.
    """
    ordered = cut_lineage(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        ordered.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + place + 1)
        .drop("_id", "_part", "_offset")
    )
