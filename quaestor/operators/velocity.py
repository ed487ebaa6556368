"""Rolling count, sum and mean per account.

Two readings of a window such as ``7D`` exist. ``rows`` takes the last 7 transactions of the
account and is the default; ``days`` takes the calendar days the name promises, where all
transactions of a day see the whole day.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.functions.columns import exact_sum
from quaestor.operators.skew import find_hot_keys
from quaestor.params import SkewParams
from quaestor.session import cut_lineage


def window_length(label: str) -> int:
    """``"7D"`` -> 7."""
    length = int(label.lower().removesuffix("d"))
    if length < 1:
        raise ValueError(f"window must be at least 1: {label}")
    return length


def velocity(
    ledger: DataFrame,
    windows: tuple[str, ...] = C.VELOCITY_WINDOWS,
    frame: str = "rows",
    skew: SkewParams | None = SkewParams(),
) -> DataFrame:
    """Add ``txn_count_<w>``, ``amount_sum_<w>``, ``amount_avg_<w>`` over ``abs(amount)``."""
    if frame == "days":
        return velocity_days(ledger, windows)
    return velocity_rows(ledger, windows, skew)


def _row_columns(spec: Window, windows: tuple[str, ...]) -> dict:
    magnitude = F.abs("amount")
    out = {}
    for label in windows:
        over = spec.rowsBetween(1 - window_length(label), Window.currentRow)
        name = label.lower()
        out[f"txn_count_{name}"] = F.count("txn_id").over(over)
        out[f"amount_sum_{name}"] = F.sum(magnitude).over(over)
        out[f"amount_avg_{name}"] = F.avg(magnitude).over(over)
    return out


def velocity_rows(
    ledger: DataFrame,
    windows: tuple[str, ...] = C.VELOCITY_WINDOWS,
    skew: SkewParams | None = SkewParams(),
) -> DataFrame:
    """Windows over the last N transactions by ``txn_date``, ties in order of ``txn_id``.

    All columns share one shuffle and sort by account. An account too large for one task is cut
    into slices (see :func:`_sliced_rows`); ``skew=None`` skips the count that looks for them.
    """
    by_account = Window.partitionBy("account_id").orderBy("txn_date", "txn_id")
    hot = find_hot_keys(ledger, ("account_id",), skew) if skew else None
    if hot is None:
        return ledger.withColumns(_row_columns(by_account, windows))
    cold_rows, hot_rows = hot.split(ledger)
    slices = max(2, math.ceil(hot.rows / skew.slice_rows))
    return cold_rows.withColumns(_row_columns(by_account, windows)).unionByName(
        _sliced_rows(hot_rows, windows, slices)
    )


def _sliced_rows(rows: DataFrame, windows: tuple[str, ...], slices: int) -> DataFrame:
    """The same windows for accounts of any size.

    The rows are range-partitioned by (account, date, id), so a slice is a contiguous run of an
    account. Within a slice, only its first N-1 rows look further back than the slice. Those
    are computed again over the seams: the first and last N-1 rows of every slice, which hold
    all that such a row can see. The slices are checkpointed because range bounds are sampled
    and both halves must see the same ones.
    """
    longest = max(map(window_length, windows))
    order = ["txn_date", "txn_id"]
    sliced = cut_lineage(
        rows.repartitionByRange(slices, "account_id", *order).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    in_slice = Window.partitionBy("account_id", "_slice").orderBy(*order)
    placed = sliced.withColumns(
        {
            "_place": F.row_number().over(in_slice),
            "_near_end": F.lead(F.lit(True), longest - 1, False).over(in_slice) == F.lit(False)
            if longest > 1
            else F.lit(False),
        }
    )
    inner = (
        placed.withColumns(_row_columns(in_slice, windows))
        .filter(F.col("_place") >= longest)
        .drop("_slice", "_place", "_near_end")
    )
    across = Window.partitionBy("account_id").orderBy(*order)
    seams = (
        placed.filter((F.col("_place") < longest) | F.col("_near_end"))
        .withColumns(_row_columns(across, windows))
        .filter(F.col("_place") < longest)
        .drop("_slice", "_place", "_near_end")
    )
    return inner.unionByName(seams)


def rolling_days(ledger: DataFrame, daily: dict, windows: tuple[str, ...]) -> DataFrame:
    """Per (account, day): each aggregate of ``daily`` and its sum over the last N days.

    ``daily`` maps a name to an aggregate column. Rows are combined to one per account and day
    before anything is ordered, so the window of an account never exceeds the calendar. The
    outputs are named ``<name>_<w>``.
    """
    per_day = ledger.groupBy("account_id", F.to_date("txn_date").alias("txn_day")).agg(
        *[agg.alias(name) for name, agg in daily.items()]
    )
    spec = Window.partitionBy("account_id").orderBy(F.unix_date("txn_day"))
    rolled = {}
    for label in windows:
        over = spec.rangeBetween(1 - window_length(label), Window.currentRow)
        rolled.update({f"{n}_{label.lower()}": F.sum(n).over(over) for n in daily})
    return per_day.select("account_id", "txn_day", *[c.alias(n) for n, c in rolled.items()])


def attach_days(ledger: DataFrame, per_day: DataFrame) -> DataFrame:
    """Join per-day values back to the transactions on (account, day).

    A plain equi-join on both keys: the adaptive join splits a hot account-day.
    """
    dated = ledger.withColumn("txn_day", F.to_date("txn_date"))
    added = [c for c in per_day.columns if c not in ("account_id", "txn_day")]
    return dated.join(per_day, ["account_id", "txn_day"], "left").select(*ledger.columns, *added)


def velocity_days(
    ledger: DataFrame, windows: tuple[str, ...] = C.VELOCITY_WINDOWS, flagged: tuple[str, str, str] | None = None
) -> DataFrame:
    """Windows over the last N calendar days, today included. Sums are exact.

    ``flagged`` (boolean column, window, output name) counts flagged rows in the same pass.
    """
    magnitude = F.abs("amount")
    daily = {
        "ids": F.count("txn_id"),
        "amounts": F.count("amount"),
        "total": exact_sum(magnitude),
    }
    columns, labels = [], windows
    if flagged:
        column, label, name = flagged
        daily["flagged"] = F.count_if(column)
        labels = tuple(dict.fromkeys((*windows, label)))
        columns.append(F.col(f"flagged_{label.lower()}").alias(name))
    rolled = rolling_days(ledger, daily, labels)
    for label in windows:
        w = label.lower()
        total = F.col(f"total_{w}").cast("double")
        columns += [
            F.col(f"ids_{w}").alias(f"txn_count_{w}"),
            total.alias(f"amount_sum_{w}"),
            (total / F.nullif(f"amounts_{w}", F.lit(0))).alias(f"amount_avg_{w}"),
        ]
    return attach_days(ledger, rolled.select("account_id", "txn_day", *columns))
