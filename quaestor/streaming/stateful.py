"""Throttling as a stateful operator: one time per key in the state store, which forgets it by itself.

The batch form in :mod:`quaestor.streaming.ledger_stream` rewrites a table of all keys in every batch, and splits keys of
any size within a batch. Here Spark's state store holds the last sent time of each key, dealt over ``buckets`` groups; a batch
reads and writes the buckets it has events of, and a timer per bucket removes keys that have not sent for ``forget``. A
bucket, not a key, is what Python is called for: with a call, or a request to the store, for every key the work of a
batch was that of its keys, not of its rows. The events of one bucket in one micro-batch and the keys of one bucket are in
the memory of one task, so bound the batches by ``maxFilesPerTrigger``, give more ``buckets`` to streams of
very many keys, and use the batch form where one key has most of the events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from quaestor.functions.columns import micros
from quaestor.operators import events
from quaestor.params import TrustParams

#: Groups in which the keys are held. A stream keeps the number it began with.
BUCKETS = 1024
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sent_places(times: np.ndarray, wait: int, last: int | None) -> list[int]:
    """Which of the sorted ``times`` are sent: each at least ``wait`` after the last one sent before it."""
    sent, at = [], 0 if last is None else int(np.searchsorted(times, last + wait))
    while at < len(times):
        sent.append(at)
        at += int(np.searchsorted(times[at:], times[at] + wait))
    return sent


def throttle_bucket(columns: list[str], tie: str, wait: int, forget_ms: int):
    """The step of one bucket of keys: its rows of a batch, behind the time of the last event that each key sent.

    Emits the sent events, and with ``late`` set those that came after a later one had been sent. The state comes and goes
    with the rows, in one piece for the bucket: neither a key nor an event costs a request to the state store.
    """

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {key: (last, forget_at) for key, last, forget_at in zip(*state.get)} if state.exists else {}
        clock, out = state.getCurrentWatermarkMs(), None
        if not state.hasTimedOut:
            batch = pd.concat(list(parts), ignore_index=True)
            batch = batch.sort_values(["throttle_key", "throttle_us", tie], kind="stable", ignore_index=True)
            keys, times = batch["throttle_key"].to_numpy(object), batch["throttle_us"].to_numpy(np.int64)
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            forget_at = int(batch["seen_ms"].max()) + forget_ms
            kept, late = [], []
            for at, end in zip(bounds, bounds[1:]):
                last = held[keys[at]][0] if keys[at] in held else None
                older = 0 if last is None else int(np.searchsorted(times[at:end], last))
                sent = sent_places(times[at:end], wait, last)
                if sent:
                    held[keys[at]] = (int(times[at + sent[-1]]), forget_at)
                kept += range(at, at + older)
                kept += [at + k for k in sent]
                late += [True] * older + [False] * len(sent)
            out = batch.iloc[kept][columns]
            out["late"] = np.array(late, dtype=bool)
        held = {key: value for key, value in held.items() if value[1] > clock}
        if held:
            lasts, forgets = zip(*held.values())
            state.update((list(held), list(lasts), list(forgets)))
            state.setTimeoutTimestamp(min(forgets))
        elif state.exists:
            state.remove()
        if out is not None and len(out):
            yield out

    return step


def throttled(
    alerts: DataFrame,
    tie: str,
    params: TrustParams = TrustParams(),
    forget: str = "7 days",
    buckets: int = BUCKETS,
) -> DataFrame:
    """The events of a stream that pass the severity filter and the throttle, with ``alert_id`` and ``late``.

    The clock of the timers is the arrival of batches, as watermark, so no event is ever dropped as too late. ``forget``
    counts from the batch in which a key sent; it has to cover the wait and the delay with which events arrive. An event
    that arrives later than that counts as the first of its key. Late events, older than one already sent, cannot take
    its place; they are emitted with ``late`` true.
    """
    passing = events.filter_severity(alerts, params.severity_filter)
    wait = round(params.throttle_minutes * 60_000_000)
    if wait <= 0:
        return passing.withColumns({"alert_id": events.alert_id(), "late": F.lit(False)})
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    keyed = passing.withColumns(
        {"throttle_key": events.throttle_key(), "throttle_us": micros(F.col("event_at")), "seen": F.current_timestamp()}
    )
    keyed = keyed.withColumn("seen_ms", F.unix_millis("seen")).withWatermark("seen", "0 seconds")
    keyed = keyed.withColumn("throttle_bucket", F.pmod(F.xxhash64("throttle_key"), F.lit(buckets)))
    out = StructType([*alerts.schema.fields, StructField("late", BooleanType())])
    sent = keyed.groupBy("throttle_bucket").applyInPandasWithState(
        throttle_bucket(alerts.columns, tie, wait, forget_ms),
        outputStructType=out,
        stateStructType="keys array<string>, last_us array<long>, forget_at array<long>",
        outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout,
    )
    return sent.withColumn("alert_id", events.alert_id())


def run_throttle(
    alerts: DataFrame,
    tie: str,
    path: str,
    checkpoint: str,
    params: TrustParams = TrustParams(),
    forget: str = "7 days",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append what is sent to a Parquet table, exactly once, and stop; sets the state store of the session."""
    alerts.sparkSession.conf.set(STORE, ROCKSDB)
    return (
        throttled(alerts, tie, params, forget, buckets)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def held_keys(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key and last_us of the keys in the state of a stopped stream."""
    state = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    return state.select(F.inline(F.arrays_zip("keys", "last_us"))).toDF("key", "last_us")
