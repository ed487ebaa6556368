"""The throttle whose state is in the state store."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from quaestor.operators.throttle import throttle
from quaestor.params import TrustParams
from quaestor.streaming import stateful

SCHEMA = "id long, event_at timestamp_ntz, severity string, category string, title string, message string, source string"
START = datetime(2024, 5, 1)


def alerts(spark, *rows):
    """Rows of (id, minute, title)."""
    return spark.createDataFrame(
        [(i, START + timedelta(minutes=m), "error", "quality", title, "m", "s") for i, m, title in rows], SCHEMA
    )


def deliver(spark, tmp_path, rows, forget="7 days"):
    folder, sent, checkpoint = (str(tmp_path / n) for n in ("in", "sent", "checkpoint"))
    rows.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).parquet(folder)
    stateful.run_throttle(stream, "id", sent, checkpoint, TrustParams(throttle_minutes=10), forget).awaitTermination()
    return spark.read.parquet(sent), checkpoint


def test_deliveries_equal_the_batch_operator(spark, tmp_path):
    rng = np.random.default_rng(4)
    minutes = np.sort(rng.integers(0, 400, 120))
    rows = [(i, int(m), f"t{rng.integers(3)}") for i, m in enumerate(minutes)]
    for part in (rows[:50], rows[50:51], rows[51:]):
        out, _ = deliver(spark, tmp_path, alerts(spark, *part))
    got = {r.id for r in out.filter("not late").collect()}
    want = throttle(alerts(spark, *rows), F.col("title"), "event_at", "id", 10)
    assert got == {r.id for r in want.collect()}
    assert out.filter("late").filter(f"id in ({','.join(map(str, got))})").count() == 0


def test_late_events_are_kept_apart(spark, tmp_path):
    deliver(spark, tmp_path, alerts(spark, (1, 100, "a"), (2, 105, "a")))
    out, checkpoint = deliver(spark, tmp_path, alerts(spark, (3, 50, "a"), (4, 109, "a"), (5, 110, "a"), (6, 0, "b")))
    assert {(r.id, r.late) for r in out.collect()} == {(1, False), (3, True), (5, False), (6, False)}
    held = {r.key: r.last_us for r in stateful.held_keys(spark, checkpoint).collect()}
    assert set(held) == {"quality:a", "quality:b"}


def test_keys_leave_the_state(spark, tmp_path):
    """A key that has not sent for the given time is removed by its timer, with the next batch."""
    _, checkpoint = deliver(spark, tmp_path, alerts(spark, (1, 0, "old")), "2 seconds")
    assert {r.key for r in stateful.held_keys(spark, checkpoint).collect()} == {"quality:old"}
    time.sleep(3)
    deliver(spark, tmp_path, alerts(spark, (2, 1, "new")), "2 seconds")
    assert {r.key for r in stateful.held_keys(spark, checkpoint).collect()} == {"quality:new"}
    out, _ = deliver(spark, tmp_path, alerts(spark, (3, 5, "old")), "2 seconds")
    assert {r.id for r in out.filter("not late").collect()} == {1, 2, 3}  # minute 5 is the first of its key again


def test_sent_places():
    times = np.array([0, 5, 10, 10, 19, 20, 31])
    assert stateful.sent_places(times, 10, None) == [0, 2, 5, 6]
    assert stateful.sent_places(times, 10, 5) == [4, 6]
    assert stateful.sent_places(times, 10, 100) == []


def test_state_grows_by_buckets_not_keys(spark, tmp_path):
    """Keys that share a bucket are one call and one row of state, and are throttled and forgotten each on its own."""
    rows = [(100 * d + k, 6 * d, f"k{k}") for d in range(4) for k in range(40) if (d + k) % 3]
    folder, sent, checkpoint = (str(tmp_path / n) for n in ("in", "sent", "checkpoint"))
    for delivery in (rows[:55], rows[55:]):
        alerts(spark, *delivery).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        params = TrustParams(throttle_minutes=10)
        stateful.run_throttle(stream, "id", sent, checkpoint, params, buckets=3).awaitTermination()
    want = {r.id for r in throttle(alerts(spark, *rows), F.col("title"), "event_at", "id", 10).collect()}
    assert {r.id for r in spark.read.parquet(sent).filter("not late").collect()} == want
    assert stateful.held_keys(spark, checkpoint).count() == 40
    assert spark.read.format("statestore").load(checkpoint).count() <= 3
