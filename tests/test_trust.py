"""Contracts, drift, lineage, SLA and alert events."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quaestor.operators import contracts, drift, events, lineage, sla
from quaestor.operators.contracts import ColumnRule, Contract, Freshness, Reference
from quaestor.params import TrustParams
from quaestor.sources import sinks

from .conftest import collect

NOW = datetime(2024, 5, 1, 12)


# --- Contracts ---


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(
        [("t1", 100.0, "OK"), ("t2", -50.0, "INVALID_STATUS"), ("t2", None, None), (None, 7.0, "OK"), (None, 8.0, "OK")],
        "txn_id string, amount double, status string",
    )


def found(df, contract, **kw):
    rows = contracts.contract_violations(df, contract, **kw).collect()
    return sorted((r.constraint_type, r.column_name, r.violation_count) for r in rows)


def test_contract_kinds(table):
    contract = Contract(
        "c",
        (
            ColumnRule("txn_id", unique=True),
            ColumnRule("amount", nullable=True, min_value=0, max_value=50),
            ColumnRule("status", nullable=True, allowed_values=("OK",), regex_pattern="^[A-Z]+$"),
            ColumnRule("branch"),
        ),
        row_count_min=6,
        row_count_max=4,
    )
    assert found(table, contract) == [
        ("custom", "*", 1),
        ("custom", "*", 1),
        ("enum", "status", 1),
        ("not_null", "branch", 1),
        ("not_null", "txn_id", 2),
        ("range", "amount", 1),
        ("range", "amount", 1),
        ("regex", "status", 1),
        ("unique", "txn_id", 2),
    ]
    result = contracts.contract_result(table, contract, contracts.contract_violations(table, contract)).first()
    assert (result.status, result.error_count, result.row_count, result.column_count) == ("violated", 9, 5, 3)


def test_report_is_stored_with_result_and_violations(spark, table, tmp_path):
    def stored_report(contract, name):
        report = contracts.contract_report(table, contract, contracts.contract_violations(table, contract))
        path = sinks.write_contract_report(report, str(tmp_path / name))
        (row,) = sinks.read_contract_report(spark, path).collect()
        return row

    bad = stored_report(Contract("c", (ColumnRule("txn_id", unique=True), ColumnRule("branch")), version="3"), "bad")
    assert (bad.contract_name, bad.version, bad.status, bad.error_count, bad.row_count) == ("c", "3", "violated", 3, 5)
    assert [(v.constraint_type, v.column_name, v.violation_count) for v in bad.violations] == [
        ("not_null", "branch", 1),
        ("not_null", "txn_id", 2),
        ("unique", "txn_id", 2),
    ]
    good = stored_report(Contract("d", (ColumnRule("amount", nullable=True),)), "good")
    assert (good.status, good.error_count, good.violations) == ("valid", 0, [])


def test_valid_table_and_empty_table(table):
    contract = Contract("c", (ColumnRule("amount", nullable=True, dtype="double"),))
    assert found(table, contract) == []
    result = contracts.contract_result(table, contract, contracts.contract_violations(table, contract)).first()
    assert result.status == "valid"
    assert found(table.limit(0), Contract("c", (ColumnRule("txn_id", unique=True),), row_count_min=1)) == [("custom", "*", 1)]


def test_range_ignores_text_and_enum_compares_as_text(spark):
    df = spark.createDataFrame([("5", 1), ("x", 2), ("99", 3)], "a string, n int")
    contract = Contract("c", (ColumnRule("a", max_value=10), ColumnRule("n", allowed_values=("1", "2"))))
    assert found(df, contract) == [("enum", "n", 1), ("range", "a", 1)]
    assert collect(contracts.invalid_values(df, contract)) == [("n", "3", 1)]


def test_declared_type_reference_and_freshness(spark, table):
    known = spark.createDataFrame([("t1",), ("t9",)], "id string")
    contract = Contract(
        "c",
        (ColumnRule("amount", nullable=True, dtype="bigint"),),
        references=(Reference("txn_id", known, "id"),),
        freshness=Freshness("at", 2.0, NOW),
    )
    df = table.withColumn("at", F.lit("2024-05-01 09:30:00").cast("timestamp_ntz"))
    assert found(df, contract) == [("dtype", "amount", 1), ("freshness", "at", 1), ("referential", "txn_id", 2)]


def test_custom_validators(table):
    contract = Contract("c", (), custom_validators=("few_negative",))
    with pytest.raises(ValueError, match="few_negative"):
        contracts.contract_violations(table, contract)

    def few_negative(df):
        n = F.count_if(F.col("amount") < 0)
        return df.agg(
            F.lit("custom").alias("constraint_type"),
            F.lit("amount").alias("column_name"),
            F.lit("negative").alias("message"),
            F.lit("warning").alias("severity"),
            n.alias("violation_count"),
        )

    rows = contracts.contract_violations(table, contract, {"few_negative": few_negative})
    assert contracts.contract_result(table, contract, rows).first().status == "valid"
    assert rows.first().violation_count == 1


def test_contradictory_range():
    with pytest.raises(ValueError):
        ColumnRule("a", min_value=2, max_value=1)


# --- Drift ---


def test_schema_drift_events(spark, tmp_path):
    base = str(tmp_path / "baselines")
    params = TrustParams(critical_columns=("b", "c"))
    first = spark.createDataFrame([], "a bigint, b string, c string")
    assert drift.detect_drift(first, "s", base, NOW, params).count() == 0
    assert drift.detect_drift(first, "s", base, NOW, params).count() == 0
    second = spark.createDataFrame([], "a bigint, b int, d string")
    found_ = drift.detect_drift(second, "s", base, NOW, params)
    assert collect(found_, "event_type", "column_name", "severity", "expected", "actual") == [
        ("column_added", "d", "warning", None, "string"),
        ("column_removed", "c", "critical", "string", None),
        ("type_changed", "b", "critical", "string", "int"),
    ]
    summary = drift.drift_summary(found_).first()
    assert (summary.total_events, summary.critical_count, summary.status) == (3, 2, "degraded")
    assert drift.recent_events(found_, ("column_name",), 2).count() == 2


def test_drift_switches(spark):
    before = drift.schema_snapshot(spark.createDataFrame([], "a int, b int"), "s", NOW)
    after = drift.schema_snapshot(spark.createDataFrame([], "a string, c int"), "s", NOW)
    kinds = lambda p: [r.event_type for r in drift.schema_drift(before, after, p).collect()]
    assert sorted(kinds(TrustParams(allowed_new_columns=("c",)))) == ["column_removed", "type_changed"]
    assert kinds(TrustParams(track_additions=False, track_removals=False)) == ["type_changed"]
    assert sorted(kinds(TrustParams(track_type_changes=False))) == ["column_added", "column_removed"]


def test_baseline_is_kept_unless_forced(spark, tmp_path):
    base = str(tmp_path / "b")
    one = drift.schema_snapshot(spark.createDataFrame([], "a int"), "s", NOW)
    two = drift.schema_snapshot(spark.createDataFrame([], "a string"), "s", NOW)
    assert drift.load_baseline(spark, base, "s") is None
    assert drift.save_baseline(one, base, "s")
    assert not drift.save_baseline(two, base, "s")
    assert drift.load_baseline(spark, base, "s").first().dtype == "int"
    assert drift.save_baseline(two, base, "s", force=True)
    assert drift.load_baseline(spark, base, "s").first().dtype == "string"
    assert one.first().schema_hash != two.first().schema_hash


def test_observed_types(spark):
    df = spark.createDataFrame(
        [("1", "1", "1.5", "True", "x", None), ("-2", None, "2e3", "False", "1", None)],
        "i string, n string, f string, b string, o string, e string",
    )
    got = dict(collect(drift.observed_snapshot(df, "s"), "column_name", "dtype"))
    assert got == {"i": "int64", "n": "float64", "f": "float64", "b": "bool", "o": "object", "e": "float64"}


def test_null_share_and_categories(spark):
    before = spark.createDataFrame([("a", None), ("b", "x")], "k string, v string")
    after = spark.createDataFrame([("b", "x"), ("c", "x"), ("c", None), (None, None)], "k string, v string")
    assert collect(drift.null_share_drift(before, after, ("k", "v"))) == [("k", 0.0, 0.25)]
    assert collect(drift.null_share_drift(before, after, ("k", "v"), 0.3)) == []
    assert collect(drift.categorical_drift(before, after, "k")) == [
        ("k", "a", "value_removed", 1),
        ("k", "c", "value_added", 2),
    ]


# --- Lineage ---


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "node string, parent string")


def test_chain_and_impact(spark):
    edges = edges_of(spark, ("b", "a"), ("c", "b"), ("d", "b"))
    starts = spark.createDataFrame([("c",), ("a",)], "node string")
    assert collect(lineage.lineage_chain(edges, starts)) == [("a", "a", 0), ("c", "a", 2), ("c", "b", 1), ("c", "c", 0)]
    assert collect(lineage.lineage_impact(edges, starts)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 2)]


def test_cycles_end(spark):
    edges = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"))
    starts = spark.createDataFrame([("a",)], "node string")
    assert collect(lineage.lineage_chain(edges, starts)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]
    assert collect(lineage.lineage_impact(edges, starts)) == [("a", "b", 2), ("a", "c", 1)]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    edges = spark.range(3999).select((F.col("id") + 1).cast("string").alias("node"), F.col("id").cast("string").alias("parent"))
    starts = spark.createDataFrame([("3999",), ("5",)], "node string")
    rounds, write = [], lineage.stored
    monkeypatch.setattr(lineage, "stored", lambda df, name: rounds.append(name) or write(df, name))
    got = lineage.lineage_chain(edges, starts)
    assert rounds.count("reached") - 1 <= 13
    expected = [(s, str(int(s) - k), k) for s in ("3999", "5") for k in range(int(s) + 1)]
    assert collect(got) == sorted(expected, key=lambda t: tuple(map(str, t)))
    ring = edges.unionByName(spark.createDataFrame([("0", "20")], "node string, parent string")).where("int(node) <= 20")
    alone = collect(lineage.lineage_chain(ring, starts.where("node = '5'")))
    assert [t[2] for t in alone if t[1] == "0"] == [5] and len(alone) == len({t[1] for t in alone})


def test_nodes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "col1 bigint, col2 string")
    kept = df.filter("col1 > 1")
    nodes = (
        lineage.source_node(df, "r", "raw", "/in", "abc")
        .unionByName(lineage.transformation_node(df, kept, "r", "keep", "filter", "r_source_raw"))
        .unionByName(lineage.sink_node(kept, "r", "out", "/out", "r_transform_keep"))
    )
    got = {r.node_id: r for r in nodes.collect()}
    step = got["r_transform_keep"]
    assert (step.input_rows, step.row_count, step.row_delta) == (2, 1, -1)
    assert got["r_source_raw"].file_hash == "abc" and got["r_source_raw"].parent_nodes == []
    chain = lineage.lineage_chain(lineage.first_parents(nodes), nodes.filter("node_type = 'sink'").select(F.col("node_id").alias("node")))
    assert [r.node for r in chain.orderBy(F.desc("steps")).collect()] == ["r_source_raw", "r_transform_keep", "r_sink_out"]
    assert lineage.all_parents(nodes).count() == 2


def test_file_hash(spark, tmp_path):
    import hashlib

    (tmp_path / "f.csv").write_bytes(b"a,b\n1,2\n")
    got = lineage.file_hashes(spark, str(tmp_path), "*.csv").first()
    assert (got.file_name, got.length) == ("f.csv", 8)
    assert got.file_hash == hashlib.sha256(b"a,b\n1,2\n").hexdigest()[:32]


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, s string")
    print_ = lambda d: tuple(lineage.table_fingerprint(d, ("i", "s")).first())
    assert print_(df) == print_(df.orderBy(F.desc("i")).repartition(3))
    assert print_(df) != print_(df.fillna("x"))
    assert print_(df) != print_(df.fillna(""))


# --- SLA ---


def test_freshness(spark):
    ages = {"new": 1, "edge": 19.2, "warn": 20, "limit": 24, "old": 48}
    rows = [(k, NOW - timedelta(hours=h)) for k, h in ages.items()] + [("none", None), ("now", NOW)]
    updates = spark.createDataFrame(rows, "table_name string, last_updated timestamp_ntz")
    got = {r.table_name: (r.status, r.data_age_hours) for r in sla.freshness(updates, NOW).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        "new": "fresh", "edge": "fresh", "warn": "warning", "limit": "warning", "old": "stale", "none": "unknown", "now": "fresh",
    }
    assert got["now"][1] == 0.0
    metrics = sla.freshness_metrics(sla.freshness(updates, NOW), F.lit(NOW))
    assert {r.subject: r.value for r in metrics.collect()}["none"] == -1.0


def test_latency_and_reports(spark):
    rows = [(name, NOW, NOW + timedelta(minutes=m)) for name, m in (("a", 10), ("b", 24), ("c", 24.5), ("d", 30), ("e", 31))]
    runs = spark.createDataFrame(rows, "process string, started timestamp_ntz, ended timestamp_ntz")
    checked = sla.latency(runs)
    assert {r.process: r.status for r in checked.collect()} == {
        "a": "compliant", "b": "compliant", "c": "warning", "d": "warning", "e": "violated",
    }
    metrics = sla.latency_metrics(checked, 30.0)
    report = sla.sla_report(metrics).first()
    assert (report.compliant, report.warnings, report.violations, report.compliance_rate) == (2, 2, 1, 0.4)
    assert sla.sla_summary(metrics).first().status == "degraded"
    assert [r.subject for r in sla.recent_violations(metrics).collect()] == ["e"]
    empty = metrics.limit(0)
    assert sla.sla_report(empty).first().compliance_rate == 0.0
    assert sla.sla_summary(empty).first().status == "healthy"


# --- Events ---


def alert_rows(spark, *rows):
    full = [(i, NOW + timedelta(minutes=m), s, "quality", t, "m", "x") for i, (m, s, t) in enumerate(rows)]
    schema = "event_id int, event_at timestamp_ntz, severity string, category string, title string, message string, source string"
    return spark.createDataFrame(full, schema)


def test_send_events(spark):
    df = alert_rows(spark, (0, "warning", "a b"), (3, "error", "a b"), (5, "warning", "a b"), (1, "info", "a b"), (1, "error", "z"))
    sent = events.send_events(df, "event_id")
    assert collect(sent, "event_id", "alert_id") == [
        (0, "quality_a_b_202405011200"),
        (2, "quality_a_b_202405011205"),
        (4, "quality_z_202405011201"),
    ]


def test_acknowledge_takes_the_first_open_alert(spark):
    df = alert_rows(spark, (0, "error", "a"), (0.5, "error", "a"), (2, "critical", "b"))
    df = df.withColumn("alert_id", events.alert_id())
    acks = spark.createDataFrame([("quality_a_202405011200", "me", NOW)], "alert_id string, by string, at timestamp_ntz")
    assert collect(events.active_alerts(df, acks), "event_id") == [(1,), (2,)]
    assert collect(events.active_alerts(df, acks, "critical"), "event_id") == [(2,)]
    done = events.acknowledge(df, acks).filter("acknowledged").first()
    assert (done.event_id, done.acknowledged_by) == (0, "me")
    twice = acks.unionAll(acks)
    assert collect(events.active_alerts(df, twice), "event_id") == [(2,)]


def test_presets(spark):
    failed = events.run_event(spark, "Run Failed", "boom", NOW, failed=True).first()
    assert (failed.severity, failed.category) == ("critical", "pipeline")
    assert events.run_event(spark, "Done", "ok", NOW, failed=False).first().severity == "info"
    bad = spark.createDataFrame([(NOW, 1.0)], "txn_date timestamp_ntz, diff double")
    event = events.mismatch_events(bad, NOW).first()
    assert (event.category, event.severity) == ("quality", "error") and event.message.endswith("on 1 dates")
    assert events.mismatch_events(bad.limit(0), NOW).count() == 0
