"""Scoring by deliveries against scoring everything at once."""

import random
from dataclasses import replace

import pytest

from quaestor.operators import features, incremental, rules
from quaestor.params import AmlParams, SkewParams
from quaestor.sources import commits

from .conftest import collect

ROWS = AmlParams(velocity_windows=("1D", "7D"), daily_txn_count_threshold=2, skew=None)
DAYS = replace(ROWS, velocity_frame="days", min_structuring_txns=2)
BOTH = replace(ROWS, min_structuring_txns=2, structuring_window_days=3)
HOT = replace(ROWS, skew=SkewParams(min_hot_rows=10, slice_rows=20))


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        account = "hot" if rng.random() < 0.4 else f"a{rng.randrange(6)}"
        at = f"2024-01-{rng.randrange(1, 20):02d} {rng.randrange(24):02d}:00"
        out.append((f"t{i:04d}", account, at, rng.choice([100, 9500.0, 9800, 10000, 0.25])))
    return out


def whole(ledger, params):
    return rules.apply_rules(features.aml_features(ledger, params), params)


def assert_same(spark, ledger_rows, path, deliveries, params):
    everything = ledger_rows(*[r for d in deliveries for r in d])
    for number, delivery in enumerate(deliveries):
        incremental.score_delivery(ledger_rows(*delivery) if delivery else everything.limit(0), number, path, params)
    want = whole(everything, params)
    got = incremental.scored(spark, path)
    assert got.columns == want.columns
    assert collect(got) == collect(want)


@pytest.mark.parametrize("params", [ROWS, DAYS, BOTH, HOT], ids=["rows", "days", "both", "hot"])
def test_deliveries_equal_one_run(spark, ledger_rows, tmp_path, params):
    """The second delivery is in order, the third and fourth are late, one is empty, one has a new account only."""
    rows = sorted(rows_of(150), key=lambda r: (r[2], r[0]))
    late = rows[5:60:7]
    rest = [r for r in rows if r not in late]
    fresh = [("z1", "new", "2023-12-01", 10000), ("z2", "new", "2023-12-01", 9500)]
    path = str(tmp_path / "t")
    assert_same(spark, ledger_rows, path, [rest[:70], rest[70:], late[:4], [], late[4:], fresh], params)
    base = commits.manifest(spark, path)
    assert len(base.parts["recent"]) <= incremental.MAX_FOLDERS + 1
    before = collect(incremental.scored(spark, path))
    merged = incremental.merge_restarts(spark, path)
    assert merged.parts["restarts"] == [] and len(merged.parts["scored"]) == 1
    assert collect(incremental.scored(spark, path)) == before


def test_in_order_delivery_scores_its_own_rows_only(spark, ledger_rows, tmp_path):
    rows = sorted(rows_of(120, seed=2), key=lambda r: (r[2], r[0]))
    path = str(tmp_path / "t")
    incremental.score_delivery(ledger_rows(*rows[:100]), 0, path, ROWS)
    second = incremental.score_delivery(ledger_rows(*rows[100:]), 1, path, ROWS)
    assert second.parts["restarts"] == []
    assert spark.read.parquet(f"{path}/{second.parts['scored'][-1]}").count() == 20
    carried = spark.read.parquet(f"{path}/{second.parts['recent'][-1]}").groupBy("account_id").count().collect()
    assert all(r["count"] <= 6 for r in carried)


def test_repeated_and_foreign_deliveries(spark, ledger_rows, tmp_path):
    path, ledger = str(tmp_path / "t"), ledger_rows(*rows_of(10))
    first = incremental.score_delivery(ledger, 3, path, ROWS)
    assert incremental.score_delivery(ledger, 3, path, ROWS) == first
    assert incremental.scored(spark, path).count() == 10
    with pytest.raises(ValueError):
        incremental.score_delivery(ledger, 4, path, DAYS)
    with pytest.raises(LookupError):
        incremental.scored(spark, str(tmp_path / "nothing"))


def test_null_account_and_old_versions(spark, ledger_rows, tmp_path):
    path = str(tmp_path / "t")
    one = [("t2", None, "2024-01-02", 5.0), ("t3", None, "2024-01-03", 6.0)]
    assert_same(spark, ledger_rows, path, [one, [("t1", None, "2024-01-01", 7.0)]], ROWS)
    assert incremental.scored(spark, path, 0).count() == 2
