"""Both jobs end to end, stage tables, and the streaming forms."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.operators.balance import daily_balance
from quaestor.operators.reconcile import ReconciliationError
from quaestor.operators.transform import transform_transactions
from quaestor.params import AmlParams, JobParams, ReconcileParams
from quaestor.plans import jobs
from quaestor.plans.stages import StageStore
from quaestor.sources.sinks import write_ledger
from quaestor.streaming import ledger_stream

from .conftest import collect, row

ROWS = [
    row("t1", amount="100"),
    row("t2", ingested="2024-01-02", amount="50", kind="REFUND"),
    row("t3", amount="-25"),
    row("t4", status="PENDING"),
    row("t5", "acc2", amount="9500"),
]


def write_csv(folder, rows, name="feed.csv"):
    folder.mkdir(exist_ok=True)
    lines = [",".join(C.REQUIRED_COLUMNS)] + [",".join(v or "" for v in r) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def json_rows(path):
    return [json.loads(line) for p in sorted(path.glob("*.json")) for line in p.read_text().splitlines()]


def test_ledger_job(spark, tmp_path):
    feed = write_csv(tmp_path / "in", ROWS)
    out = tmp_path / "out"
    paths = jobs.run_ledger_job(spark, feed, str(out))
    assert collect(spark.read.parquet(paths["ledger"]), "txn_id", "amount") == [
        ("t1", 100.0), ("t2", -50.0), ("t3", -25.0), ("t5", 9500.0),
    ]
    assert collect(spark.read.parquet(paths["daily_balance"]), "account_id", "total_amount", "txn_count") == [
        ("acc1", 25.0, 3), ("acc2", 9500.0, 1),
    ]
    quality = json_rows(out / "data_quality_metrics")
    assert quality[0]["row_counts"]["ledger_total"] == 4 and quality[0]["data_quality_flags"]["late_arrivals"] == 1
    nodes = {n["name"]: n for n in json_rows(out / "trust" / "lineage")}
    assert nodes["ledger"]["row_delta"] == -1 and len(nodes) == 5
    subjects = {m["subject"] for m in json_rows(out / "trust" / "sla_metrics")}
    assert {"raw_transactions", "extract_step", "load_step"} <= subjects
    assert json_rows(out / "trust" / "drift_summary")[0]["status"] == "healthy"
    assert not (out / "stages").exists() or not any((out / "stages").iterdir())
    # again: same tables, no leftovers
    jobs.run_ledger_job(spark, feed, str(out))
    assert spark.read.parquet(paths["ledger"]).count() == 4


def test_failed_run_reports_and_keeps_old_output(spark, tmp_path):
    out = tmp_path / "out"
    paths = jobs.run_ledger_job(spark, write_csv(tmp_path / "in", ROWS), str(out))
    for _ in range(2):  # the second failure comes within the throttle time
        with pytest.raises(ValueError, match="Duplicate"):
            jobs.run_ledger_job(spark, write_csv(tmp_path / "bad", [*ROWS, ROWS[0]]), str(out))
    assert spark.read.parquet(paths["ledger"]).count() == 4
    events = json_rows(out / "trust" / "events")
    assert [e["severity"] for e in events] == ["critical"]
    with pytest.raises(FileNotFoundError):
        jobs.run_ledger_job(spark, str(tmp_path / "nowhere"), str(out))


def test_resume_uses_finished_stages(spark, tmp_path, monkeypatch):
    feed, out = write_csv(tmp_path / "in", ROWS), str(tmp_path / "out")

    def broken(*_):
        raise ReconciliationError("stop here")

    monkeypatch.setattr(jobs, "raise_on_mismatch", broken)
    with pytest.raises(ReconciliationError):
        jobs.run_ledger_job(spark, feed, out)
    monkeypatch.undo()
    store = StageStore(spark, f"{out}/stages", JobParams(), [feed])
    assert [s for s in ("extract", "transform", "reconcile", "load") if store.is_done(s)] == ["extract", "transform", "reconcile"]

    def not_again(*_):
        raise AssertionError("finished stage was rebuilt")

    monkeypatch.setattr(jobs, "validate_feed", not_again)
    monkeypatch.setattr(jobs, "clean_transactions", not_again)
    paths = jobs.run_ledger_job(spark, feed, out, resume=True)
    assert spark.read.parquet(paths["ledger"]).count() == 4
    with pytest.raises(AssertionError):
        jobs.run_ledger_job(spark, feed, out, JobParams(reconcile=ReconcileParams(tolerance=1.0)), resume=True)


def test_run_key_follows_input_and_parameters(spark, tmp_path):
    feed = write_csv(tmp_path / "in", ROWS)
    key = lambda p: StageStore(spark, "/x", p, [feed]).run_key
    first = key(JobParams())
    assert first == key(JobParams()) != key(JobParams(aml=AmlParams(low=20)))
    write_csv(tmp_path / "in", ROWS[:2])
    assert key(JobParams()) != first


def test_unfinished_stage_is_not_loaded(spark, tmp_path, base_feed):
    store = StageStore(spark, str(tmp_path / "s"), JobParams(), [])
    store.save("transform", {"clean": base_feed}, {"rows": 3})
    assert store.load("transform")["clean"].count() == 3
    (tmp_path / "s" / store.run_key[:32] / "transform" / "_manifest" / "_SUCCESS").unlink()
    assert not store.is_done("transform") and store.load("transform") == {}
    store.clear()
    assert not any((tmp_path / "s").iterdir())


AML_LEDGER = [(f"t{i}", "acc1", "2024-01-01", a) for i, a in enumerate([10000, 9500, 9500, 5000, 1000], 1)] + [
    (f"t{i}", "acc2", f"2024-01-{i - 5:02d}", a) for i, a in enumerate([500, 600, 700, 800, 5000], 6)
]


def test_aml_job(spark, ledger_rows, tmp_path):
    ledger = write_ledger(ledger_rows(*AML_LEDGER), str(tmp_path / "l"))
    params = AmlParams(
        daily_txn_count_threshold=3, daily_amount_threshold=30000, seven_day_amount_threshold=30000,
        large_round_amounts=(5000, 10000),
    )
    result = jobs.run_aml_job(spark, ledger, str(tmp_path / "o"), params, datetime(2024, 2, 1))
    assert result["status"] == "success" and result["metrics"]["total_transactions"] == 10
    scored = spark.read.parquet(result["scored_transactions_path"])
    assert scored.count() == 10 and {"risk_score", "severity", "txn_count_30d"} <= set(scored.columns)
    alerts = spark.read.parquet(result["alerts_path"])
    assert alerts.columns == list(C.AML_ALERT_COLUMNS)
    parts = spark.read.parquet(result["alert_ids_path"])
    assert collect(parts, "ids_part", "triggering_txn_ids") == [(0, "t2,t3"), (0, "t4"), (0, "t4,t5")]
    assert collect(alerts, "rule_id", "triggering_txn_ids") == [
        ("round_number", "t4"), ("structuring", "t2,t3"), ("velocity_7d_amount", "t4,t5"),
    ]
    assert result["alert_count"] == 3 and result["rules"]["structuring"] == 2
    assert spark.read.parquet(result["alert_transactions_path"]).count() == 5


def test_aml_job_disabled_empty_and_bad(spark, ledger_rows, tmp_path):
    assert jobs.run_aml_job(spark, "x", "y", AmlParams(enabled=False)) == {"status": "disabled"}
    empty = write_ledger(ledger_rows(*AML_LEDGER).limit(0), str(tmp_path / "e"))
    result = jobs.run_aml_job(spark, empty, str(tmp_path / "o"))
    assert result["alert_count"] == 0
    assert spark.read.parquet(result["alerts_path"]).columns == list(C.AML_ALERT_COLUMNS)
    orphan = ledger_rows(("t1", "a", "2024-01-01", 1)).withColumn("account_id", F.lit(None).cast("string"))
    with pytest.raises(jobs.AmlDetectionError, match="account_id"):
        jobs.run_aml_job(spark, write_ledger(orphan, str(tmp_path / "n")), str(tmp_path / "o2"))


# --- Streaming ---


def test_stream_takes_new_files_once(spark, tmp_path):
    folder, table, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "c")
    run = lambda: ledger_stream.run_to_table(
        ledger_stream.stream_ledger(ledger_stream.stream_feed(spark, str(folder))), table, checkpoint
    ).awaitTermination()
    write_csv(folder, ROWS[:2], "a.csv")
    run()
    run()
    write_csv(folder, ROWS[2:], "b.csv")
    run()
    got = spark.read.parquet(table)
    assert collect(got, "txn_id") == [("t1",), ("t2",), ("t3",), ("t5",)]


def test_late_rows_repair_only_their_day(spark, tmp_path):
    folder = tmp_path / "in"
    ledger, balance, checkpoint = (str(tmp_path / n) for n in ("l", "b", "c"))

    def run():
        kept = ledger_stream.stream_ledger(ledger_stream.stream_feed(spark, str(folder)))
        ledger_stream.repair_balances(kept, ledger, balance, checkpoint).awaitTermination()

    write_csv(folder, [row("a"), row("b", txn_date="2024-01-02"), row("c", "acc2", txn_date="2024-01-02")], "1.csv")
    run()
    first_day = tmp_path / "b" / "txn_day=2024-01-01"
    untouched = sorted(p.name for p in first_day.iterdir())
    write_csv(folder, [row("late", txn_date="2024-01-02", amount="7")], "2.csv")
    run()
    got = spark.read.parquet(balance)
    assert collect(got, "account_id", "total_amount", "txn_count") == [
        ("acc1", 100.0, 1), ("acc1", 107.0, 2), ("acc2", 100.0, 1),
    ]
    assert sorted(p.name for p in first_day.iterdir()) == untouched


def test_stream_keeps_late_rows_once_and_all_windows(spark, tmp_path):
    folder, table, versions = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "v")
    write_csv(folder, [row("t1", txn_date="2024-03-01")], "1.csv")
    late = [row("t1", txn_date="2024-03-01"), row("t2", txn_date="2024-01-01"), row("t3", txn_date="2024-03-01")]
    for delivery in ([], late):
        if delivery:
            write_csv(folder, delivery, "2.csv")
        kept = ledger_stream.deduplicate(ledger_stream.stream_ledger(ledger_stream.stream_feed(spark, str(folder))))
        ledger_stream.run_to_table(kept, table, str(tmp_path / "c")).awaitTermination()
        windows = ledger_stream.event_time_velocity(
            ledger_stream.stream_ledger(ledger_stream.stream_feed(spark, str(folder))), delay="365 days"
        )
        ledger_stream.run_to_versions(windows, versions, str(tmp_path / "w")).awaitTermination()
    assert collect(spark.read.parquet(table), "txn_id") == [("t1",), ("t2",), ("t3",)]
    newest = ledger_stream.newest_versions(
        spark, versions, windows.schema, ["account_id", "window_start", "window_end"]
    )
    assert collect(newest, "txn_count") == [(1,)] * 7 + [(3,)] * 7


def test_stream_throttle_sets_late_events_aside(spark, tmp_path):
    schema = (
        "id int, event_at timestamp_ntz, severity string, category string, title string, message string, source string"
    )
    sent, checkpoint = str(tmp_path / "sent"), str(tmp_path / "c")
    for number, minute in ((1, 30), (2, 10), (3, 32), (4, 40)):
        rows = [(number, datetime(2024, 1, 1, 0, minute), "error", "sla", "x", "m", "s")]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ledger_stream.throttle_stream(stream, "id", sent, str(tmp_path / "s"), checkpoint).awaitTermination()
    assert collect(spark.read.parquet(sent), "id") == [(1,), (4,)]
    assert collect(spark.read.parquet(f"{sent}_late"), "id") == [(2,)]


def test_stream_balances_equal_batch(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [row(f"t{i}", f"a{i % 3}", f"2024-01-{1 + (i * 5) % 4:02d}", amount=str(i)) for i in range(40)]
    for i in range(4):
        write_csv(folder, rows[i::4], f"{i}.csv")
    raw = ledger_stream.stream_feed(spark, str(folder), max_files=1)
    ledger_stream.repair_balances(
        ledger_stream.stream_ledger(raw), str(tmp_path / "l"), str(tmp_path / "b"), str(tmp_path / "c")
    ).awaitTermination()
    batch = spark.read.option("header", True).csv(str(folder))
    expected = daily_balance(transform_transactions(batch)[1])
    assert collect(spark.read.parquet(str(tmp_path / "b")).drop("txn_day")) == collect(expected)
