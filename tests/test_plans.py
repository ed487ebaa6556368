"""What the physical plans must look like."""

import re

import pytest

from quaestor.operators import features, rules, velocity
from quaestor.params import AmlParams
from quaestor.plans import queries as q

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def stored(spark, tmp_path):
    q._ledger_b(spark, SF).write.parquet(str(tmp_path / "l"))
    return spark.read.parquet(str(tmp_path / "l"))


def test_scoring_has_one_exchange_and_one_sort(stored):
    params = AmlParams(skew=None)
    text = plan(rules.apply_rules(features.aml_features(stored, params), params))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"(?<!Take)Sort \[", text)) == 1
    assert "Python" not in text


def test_day_windows_run_over_daily_rows(stored):
    text = plan(velocity.velocity_days(stored))
    window = text.index("Window")
    assert "HashAggregate" in text[window:]
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_day_features_take_one_aggregation_and_one_join(stored):
    params = AmlParams(velocity_frame="days", min_structuring_txns=3)
    text = plan(features.aml_features(stored, params))
    assert len(re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join", text)) == 1
    assert text.count("HashAggregate") == 2 and text.count("FileScan") == 2


@pytest.mark.parametrize("name", ["daily_balance", "reconciliation", "transform_clean", "validation_violations",
                                  "rejection_report", "contract_violations", "sla_report", "aml_scored_days"])
def test_no_python_and_no_cross_join(spark, name):
    text = plan(q.QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scans_read_only_what_is_used(spark):
    text = plan(q.QUERIES["quality_late"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == ["l_orderkey:bigint,l_shipdate:timestamp_ntz", "o_orderkey:bigint,o_orderdate:timestamp_ntz"]


def test_filter_reaches_the_ledger_scan(stored):
    text = plan(stored.filter("account_id = 'acc1'").select("txn_id"))
    assert "EqualTo(account_id,acc1)" in text


def test_balance_combines_before_the_shuffle(stored):
    text = plan(q.balance.daily_balance(stored))
    assert text.count("HashAggregate") == 2 and "partial_sum" in text
