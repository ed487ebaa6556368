"""Throttling: drop an event that follows the last *sent* event of its key too closely.

The rule is greedy: whether an event is sent depends on the last one that was sent, which a
comparison with the previous row cannot tell. Rows are shuffled and sorted by Spark; a small
fold walks them in order and remembers one timestamp per key. Keys too large for one task are
cut, by number of rows, into stretches of time that are replayed in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestor.functions.columns import micros
from quaestor.operators.skew import find_hot_keys, gather
from quaestor.params import SkewParams
from quaestor.session import cut_lineage

ALWAYS = -(2**63)


def throttle(
    events: DataFrame,
    key: Column,
    at: str,
    tie: str,
    minutes: float,
    skew: SkewParams = SkewParams(),
    last_sent: DataFrame | None = None,
) -> DataFrame:
    """The events that are sent. Per key, the first is; then each one at least ``minutes`` after
    the last sent one. Equal timestamps are taken in order of ``tie``.

    ``last_sent`` ``(key, last_us)`` carries on from earlier events: one row per key with the
    time of its last sent event in microseconds.
    """
    wait = round(minutes * 60_000_000)
    if wait <= 0:
        return events
    keyed = events.withColumns({"_key": key.cast("string"), "_at": micros(F.col(at))})
    if last_sent is not None:
        known = last_sent.select(F.col("key").alias("_key"), (F.col("last_us") + wait).alias("_from"))
        due = keyed.join(known, "_key", "left").filter("_from IS NULL OR _at >= _from")
        keyed = due.select(*keyed.columns)
    hot = find_hot_keys(keyed, ("_key",), skew)
    if hot is None:
        return _replay(_whole(keyed), tie, wait)
    cold_rows, hot_rows = hot.split(keyed)
    stretches = _stretches(sliced(hot_rows, tie, max(2, math.ceil(hot.rows / skew.slice_rows))), wait)
    return _replay(_whole(cold_rows), tie, wait).unionByName(_replay(stretches, tie, wait))


def _whole(keyed: DataFrame) -> DataFrame:
    """Each key is one group that may send from the start."""
    return keyed.withColumns({"_group": F.lit(0).cast("bigint"), "_entry": F.lit(ALWAYS).cast("bigint")})


def sliced(hot_rows: DataFrame, tie: str, slices: int) -> DataFrame:
    """Rows of hot keys, cut by number of rows into runs of time (``_group``).

    Of rows at one time only the first by ``tie`` can be sent, so the others go before the cut. Range
    bounds are sampled, so the cut is checkpointed: every later read must see the same one.
    """
    first = hot_rows.groupBy("_key", "_at").agg(F.min_by(F.struct("*"), F.struct(tie)).alias("row"))
    cut = first.select("row.*").repartitionByRange(slices, "_key", "_at")
    return cut_lineage(cut.withColumn("_group", F.spark_partition_id().cast("bigint")))


def _replay(grouped: DataFrame, tie: str, wait: int) -> DataFrame:
    """Walk every ``(_key, _group)`` in time order; an event is sent from ``_entry`` on."""
    ordered = gather(grouped, "_key", "_group").sortWithinPartitions("_key", "_group", "_at", tie)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, allowed = None, ALWAYS
        for batch in batches:
            keys = batch.column("_key").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            groups, times, entries = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_group", "_at", "_entry"))
            sent = np.zeros(batch.num_rows, dtype=bool)
            turns = np.flatnonzero((keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])) + 1
            bounds = [0, *turns.tolist(), batch.num_rows]
            for at, end in zip(bounds, bounds[1:]) if batch.num_rows else ():
                run = (batch.column("_key")[at].as_py(), int(groups[at]))
                if run != current:
                    current, allowed = run, int(entries[at])
                # From one sent event to the next, over all that are too close.
                at += int(np.searchsorted(times[at:end], allowed))
                while at < end:
                    sent[at], allowed = True, int(times[at]) + wait
                    at += int(np.searchsorted(times[at:end], allowed))
            yield batch.filter(pa.array(sent, pa.bool_()))

    kept = ordered.mapInArrow(fold, ordered.schema)
    return kept.drop("_key", "_group", "_at", "_entry")


def _stretches(grouped: DataFrame, wait: int) -> DataFrame:
    """Adds to each stretch (``_group`` of a key, cut anywhere in time) the time from which it may send.

    What an earlier stretch does to a later one is a single time: from when on it may send, and
    that lies less than one interval after the first event of the later stretch. So each stretch first
    works out, in parallel, at which time it would hand over for every possible entry (equal
    results merged). Those few rows per stretch are then chained per key, which gives the actual
    entry of each stretch.
    """
    def handovers(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.unique(pdf["_at"].to_numpy(np.int64))
        n = len(times)
        following = np.append(np.searchsorted(times, times + wait), n)
        firsts = np.arange(min(n, int(np.searchsorted(times, times[0] + wait)) + 1))
        last = firsts.copy()
        while True:
            step = following[last]
            if (step >= n).all():
                break
            last = np.where(step < n, step, last)
        leaves = times[last] + wait
        final = np.append(leaves[1:] != leaves[:-1], True)
        return pd.DataFrame(
            {
                "_key": pdf["_key"].iloc[0],
                "_group": pdf["_group"].iloc[0],
                "upto": times[firsts][final],
                "leaves": leaves[final],
            }
        )

    maps = (
        grouped.select("_key", "_group", "_at")
        .groupBy("_key", "_group")
        .applyInPandas(handovers, "_key string, _group bigint, upto bigint, leaves bigint")
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = group = None
        allowed, resolved = ALWAYS, True
        for batch in batches:
            rows = {"_key": [], "_group": [], "_entry": []}
            columns = [batch.column(c).to_pylist() for c in ("_key", "_group", "upto", "leaves")]
            for next_key, next_group, upto, leaves in zip(*columns):
                if next_key != key:
                    key, group, allowed = next_key, None, ALWAYS
                if next_group != group:
                    group, resolved = next_group, False
                    rows["_key"].append(key)
                    rows["_group"].append(group)
                    rows["_entry"].append(allowed)
                if not resolved and upto >= allowed:
                    allowed, resolved = leaves, True
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["_key"], pa.string()),
                    pa.array(rows["_group"], pa.int64()),
                    pa.array(rows["_entry"], pa.int64()),
                ],
                names=list(rows),
            )

    entries = (
        gather(maps, "_key")
        .sortWithinPartitions("_key", "_group", "upto")
        .mapInArrow(chain, "_key string, _group bigint, _entry bigint")
    )
    return grouped.join(entries, ["_key", "_group"]).select(*grouped.columns, "_entry")
