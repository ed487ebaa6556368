"""Finding keys that hold too many rows for one task."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.params import SkewParams
from quaestor.session import cut_lineage


@dataclass(frozen=True)
class HotKeys:
    """The hot keys (fewer than ``max_hot_keys`` rows by construction) and their total rows."""

    keys: DataFrame
    columns: tuple[str, ...]
    rows: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of other keys, rows of hot keys). Rows with a null key are never hot."""
        small = F.broadcast(self.keys)
        on = list(self.columns)
        return tuple(df.join(small, on, how).select(*df.columns) for how in ("left_anti", "left_semi"))


def find_hot_keys(df: DataFrame, columns: tuple[str, ...], params: SkewParams) -> HotKeys | None:
    """Count rows per key (combined before the shuffle) and return the keys over the limit."""
    per_key = (
        df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows"))
    )
    size = per_key.agg(F.sum("_rows").alias("total"), F.max("_rows").alias("largest")).first()
    if size.total is None:
        return None
    limit = max(params.min_hot_rows, math.ceil(size.total / params.max_hot_keys))
    if size.largest <= limit:
        return None
    hot = cut_lineage(per_key.filter(F.col("_rows") > limit))
    rows = hot.agg(F.sum("_rows")).first()[0]
    return HotKeys(hot.drop("_rows"), tuple(columns), rows)


def gather(df: DataFrame, *columns: str) -> DataFrame:
    """Shuffle so that rows with equal ``columns`` are in one partition, for certain.

    Operators that walk a partition (``mapInArrow``) state no requirement of their own. If the
    rows already came partitioned by these columns, the optimizer would drop a plain
    ``repartition`` and could still re-plan the join beneath it. Partitioning by a hash of the
    columns differs from what is beneath, so this shuffle stays.
    """
    return df.repartition(F.xxhash64(*columns))
