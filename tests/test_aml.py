"""Features, rules and alerts."""

from collections import deque
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.operators import aml_alerts, features, rules, velocity
from quaestor.params import AmlParams

from .conftest import by_id, collect

LEDGER = [
    ("t1", "acc1", "2024-01-01", 1000),
    ("t2", "acc1", "2024-01-01", 2000),
    ("t3", "acc1", "2024-01-02", -500),
    ("t4", "acc2", "2024-01-01", 9500),
    ("t5", "acc2", "2024-01-15", 5000),
]


def test_last_n_rows(ledger_rows):
    got = by_id(velocity.velocity_rows(ledger_rows(*LEDGER)), "txn_count_1d", "amount_sum_7d", "amount_avg_30d")
    assert got == {
        "t1": (1, 1000.0, 1000.0),
        "t2": (1, 3000.0, 1500.0),
        "t3": (1, 3500.0, 3500 / 3),
        "t4": (1, 9500.0, 9500.0),
        "t5": (1, 14500.0, 7250.0),
    }


def test_last_n_days(ledger_rows):
    got = by_id(velocity.velocity_days(ledger_rows(*LEDGER)), "txn_count_1d", "amount_sum_7d", "txn_count_30d")
    assert got == {
        "t1": (2, 3000.0, 2),
        "t2": (2, 3000.0, 2),
        "t3": (1, 3500.0, 3),
        "t4": (1, 9500.0, 1),
        "t5": (1, 5000.0, 2),
    }


def test_rows_frame_against_brute_force(ledger_rows):
    rows = [(f"t{i:03d}", f"a{i % 3}", f"2024-01-{1 + (i * 7) % 28:02d}", (i * 37) % 101) for i in range(200)]
    got = by_id(velocity.velocity_rows(ledger_rows(*rows), ("5D",)), "txn_count_5d", "amount_sum_5d")
    recent = {}
    for txn, account, _, amount in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        window = recent.setdefault(account, deque(maxlen=5))
        window.append(amount)
        assert got[txn] == (len(window), float(sum(window)))


def test_null_id_is_not_counted(ledger_rows):
    df = velocity.velocity_rows(ledger_rows((None, "a", "2024-01-01", 5), ("t", "a", "2024-01-02", 5)))
    assert collect(df, "txn_count_7d", "amount_sum_7d") == [(0, 5.0), (1, 10.0)]


def test_time_features(ledger_rows):
    df = ledger_rows(("mon", "a", "2024-01-01", 1), ("sat", "a", "2024-01-06 04:59", 1), ("sun", "a", "2024-01-07 05:00", 1))
    got = by_id(features.time_features(df), "hour_of_day", "day_of_week", "is_weekend", "is_late_night")
    assert got == {"mon": (0, 0, False, True), "sat": (4, 5, True, True), "sun": (5, 6, True, False)}


def test_structuring_bounds_are_inclusive(ledger_rows):
    amounts = {"a": 9000, "b": 9900, "c": -9500, "d": 8999.99, "e": 9900.01, "f": 12.5}
    df = features.structuring_features(ledger_rows(*[(k, "x", "2024-01-01", v) for k, v in amounts.items()]))
    got = by_id(df, "is_near_threshold", "pct_of_threshold")
    assert {k: v[0] for k, v in got.items()} == {"a": True, "b": True, "c": True, "d": False, "e": False, "f": False}
    assert got["c"][1] == 95.0
    assert got["f"][1] == 0.12  # half to even


def test_round_numbers(ledger_rows):
    df = features.round_number_features(ledger_rows(("a", "x", "2024-01-01", -5000), ("b", "x", "2024-01-01", 4999)))
    assert by_id(df, "is_large_round", "round_number_match") == {"a": (True, 5000.0), "b": (False, None)}


RULES = AmlParams(daily_txn_count_threshold=2, daily_amount_threshold=5000.0, seven_day_amount_threshold=10000.0)


@pytest.fixture()
def featured(spark):
    return spark.createDataFrame(
        [
            ("t1", "acc1", 3, 6000.0, 15000.0, True, False),
            ("t2", "acc1", 3, 6000.0, 15000.0, False, True),
            ("t3", "acc2", 1, 1000.0, 1000.0, False, False),
        ],
        "txn_id string, account_id string, txn_count_1d bigint, amount_sum_1d double, amount_sum_7d double, "
        "is_near_threshold boolean, is_large_round boolean",
    )


def test_scores_are_capped(featured):
    got = by_id(rules.apply_rules(featured, RULES), "risk_score", "severity", "is_alert")
    assert got == {"t1": (100.0, "high", True), "t2": (100.0, "high", True), "t3": (0.0, "none", False)}


def test_thresholds_are_strict(featured):
    at = AmlParams(daily_txn_count_threshold=3, daily_amount_threshold=6000.0, seven_day_amount_threshold=15000.0)
    got = by_id(rules.rule_flags(featured, at), *[flag for flag, _ in C.AML_RULES.values()])
    assert got["t1"] == (False, False, False, True, False)


def test_weight_zero_and_disabled_rule(featured):
    params = AmlParams(
        daily_txn_count_threshold=2, daily_amount_threshold=1e9, seven_day_amount_threshold=1e9,
        round_numbers_enabled=False, weight_structuring=0,
    )
    got = by_id(rules.apply_rules(featured.drop("is_large_round"), params), "risk_score", "rule_round_number_flag")
    assert got == {"t1": (25.0, False), "t2": (25.0, False), "t3": (0.0, False)}


@pytest.mark.parametrize(("score", "expected"), [(10, "none"), (30, "low"), (55, "medium"), (80, "high"), (25, "low"), (75, "high")])
def test_severity_bands(spark, score, expected):
    df = spark.createDataFrame([(float(score),)], "s double")
    assert df.select(rules.severity(F.col("s"))).first()[0] == expected


def test_structuring_needs_a_pattern_when_asked(ledger_rows):
    df = ledger_rows(
        ("a1", "a", "2024-01-01", 9500), ("a2", "a", "2024-01-05", 9600), ("b1", "b", "2024-01-01", 9500),
        ("b2", "b", "2024-01-09", 9500),
    )
    params = AmlParams(min_structuring_txns=2)
    got = by_id(rules.apply_rules(features.aml_features(df, params), params), "rule_structuring_flag")
    assert got == {"a1": False, "a2": True, "b1": False, "b2": False}


@pytest.fixture()
def scored(spark):
    at = lambda day: datetime(2024, 1, day)
    return spark.createDataFrame(
        [
            ("t1", "acc1", at(1), 1000.0, 75.0, "high", True, True, True, False),
            ("t2", "acc1", at(1), -2000.0, 75.0, "high", True, True, False, True),
            ("t3", "acc1", at(2), 500.0, 30.0, "low", True, True, False, False),
            ("t4", "acc2", at(1), 5000.0, 50.0, "medium", True, False, False, True),
            ("t5", "acc3", at(1), 5000.0, 15.0, "none", False, False, False, True),
        ],
        "txn_id string, account_id string, txn_date timestamp_ntz, amount double, risk_score double, "
        "severity string, is_alert boolean, rule_velocity_count_flag boolean, rule_structuring_flag boolean, "
        "rule_round_number_flag boolean",
    )


def test_alerts(scored):
    alerts = aml_alerts.generate_alerts(aml_alerts.triggered(scored), datetime(2024, 3, 1, 12, 0, 5))
    assert tuple(alerts.columns) == (*C.AML_ALERT_COLUMNS, "ids_part")
    got = [
        (r.alert_id[-6:], r.account_id, r.rule_id, r.severity, r.risk_score, r.triggering_txn_ids, r.triggering_amount_sum)
        for r in alerts.orderBy("alert_id").collect()
    ]
    assert got == [
        ("000001", "acc1", "round_number", "high", 75.0, ["t2"], 2000.0),
        ("000002", "acc1", "structuring", "high", 75.0, ["t1"], 1000.0),
        ("000003", "acc1", "velocity_count", "high", 75.0, ["t1", "t2"], 3000.0),
        ("000004", "acc1", "velocity_count", "low", 30.0, ["t3"], 500.0),
        ("000005", "acc2", "round_number", "medium", 50.0, ["t4"], 5000.0),
    ]
    first = alerts.filter("rule_id = 'velocity_count' AND triggering_txn_count = 2").first()
    assert first.alert_id == "AML-20240301120005-000003"
    assert first.description == "Daily Transaction Count Exceeded: 2 transactions totaling 3,000.00"
    assert first.status == "open" and first.alert_timestamp == "2024-03-01T12:00:05"


def test_no_alerts_keep_the_layout(scored):
    none = aml_alerts.generate_alerts(aml_alerts.triggered(scored.limit(0)), datetime(2024, 3, 1))
    assert none.count() == 0 and tuple(none.columns) == (*C.AML_ALERT_COLUMNS, "ids_part")


@pytest.mark.parametrize("part_ids", [1, 3, 100])
def test_alerts_of_any_size_keep_all_ids(spark, part_ids):
    rows = [(f"t{i:03d}", "big" if i < 90 else f"a{i}") for i in range(100)]
    hits = spark.createDataFrame(rows, "txn_id string, account_id string").selectExpr(
        "account_id", "DATE'2024-01-01' AS alert_date", "'structuring' AS rule_id", "txn_id", "1.0D AS magnitude",
        "50.0D AS risk_score", "'medium' AS severity",
    )
    alerts = aml_alerts.generate_alerts(hits, datetime(2024, 3, 1), part_ids)
    listed = alerts.select("account_id", F.explode("triggering_txn_ids").alias("txn_id"))
    assert collect(listed, "account_id", "txn_id") == sorted((a, t) for t, a in rows)
    assert alerts.filter("size(triggering_txn_ids) > 6 * %d" % part_ids).count() == 0
    assert alerts.select("alert_id").distinct().count() == 11
    numbered = aml_alerts.numbered_alerts(hits, datetime(2024, 3, 1))
    members = aml_alerts.alert_transactions(hits, numbered)
    assert members.count() == 100 and members.filter("account_id = 'big'").select("alert_id").distinct().count() == 1


def test_alerts_are_unique_per_key_and_scores_bounded(ledger_rows):
    rows = [(f"t{i}", f"a{i % 4}", f"2024-01-{1 + i % 9:02d}", 500 * (i % 30)) for i in range(300)]
    params = AmlParams(daily_amount_threshold=9000, seven_day_amount_threshold=30000)
    out = rules.apply_rules(features.aml_features(ledger_rows(*rows), params), params)
    assert out.filter("risk_score < 0 OR risk_score > 100").count() == 0
    alerts = aml_alerts.alert_totals(aml_alerts.triggered(out))
    assert alerts.count() == alerts.select(*aml_alerts.KEY).distinct().count() > 0


def test_whole_alerts_have_one_row_each(scored):
    hits = aml_alerts.triggered(scored)
    numbered = aml_alerts.numbered_alerts(hits, datetime(2024, 3, 1))
    counts = {r.alert_id: r.triggering_txn_count for r in numbered.collect()}
    for limit in (1, 2, 10_000):
        rows = aml_alerts.whole_alerts(numbered, hits, limit).collect()
        assert tuple(rows[0].asDict()) == tuple(C.AML_ALERT_COLUMNS)
        assert sorted(r.alert_id for r in rows) == sorted(counts)
        for r in rows:
            assert len(r.triggering_txn_ids or ()) == (counts[r.alert_id] if counts[r.alert_id] <= limit else 0)
