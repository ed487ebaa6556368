"""Tables with a commit log, balances from deltas, and the drill-down of a reconciliation."""

from __future__ import annotations

import threading
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestor.operators import recon_tree
from quaestor.operators.balance import daily_balance
from quaestor.sources import commits, fs, sinks
from quaestor.streaming import balance_deltas


def ids(df):
    return sorted(r.txn_id for r in df.collect())


def test_versions(spark, ledger_rows, tmp_path):
    path = str(tmp_path / "t")
    assert commits.manifest(spark, path) is None and commits.versions(spark, path) == []
    one = sinks.commit_ledger(ledger_rows(("t1", "a", "2024-01-01", 1)), path, None)
    two = commits.commit(ledger_rows(("t2", "a", "2024-01-01", 2)), path, one, append=True, notes={"by": "test"})
    three = sinks.commit_ledger(ledger_rows(("t3", "a", "2024-01-01", 3)), path, two)
    assert [ids(commits.read(spark, path, v)) for v in (None, 0, 1, 2)] == [["t3"], ["t1"], ["t1", "t2"], ["t3"]]
    assert commits.manifest(spark, path, 1).notes == {"by": "test"}
    with pytest.raises(LookupError):
        commits.read(spark, path, 7)
    with pytest.raises(LookupError):
        commits.read(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="schema"):
        commits.commit(spark.range(1), path, three, append=True)
    with pytest.raises(ValueError):
        sinks.commit_ledger(ledger_rows((None, "a", "2024-01-01", 3)), path, three)
    assert len(commits.vacuum(spark, path)) == 2
    assert commits.versions(spark, path) == [2] and ids(commits.read(spark, path)) == ["t3"]
    empty = commits.commit(ledger_rows(("t3", "a", "2024-01-01", 3)).limit(0), path, three)
    assert commits.read(spark, path).count() == 0 and empty.version == 3


def test_outdated_base_fails(spark, tmp_path):
    path = str(tmp_path / "t")
    base = commits.commit(spark.range(3), path, None)
    commits.commit(spark.range(5), path, base)
    with pytest.raises(commits.OutdatedBase):
        commits.commit(spark.range(7), path, base)
    with pytest.raises(commits.OutdatedBase):
        commits.commit(spark.range(7), path, None)
    assert commits.read(spark, path).count() == 5


def test_one_of_two_writers_wins(spark, tmp_path):
    """Both have seen the same base and publish at once: the rename lets one through."""
    path = str(tmp_path / "t")
    base = commits.commit(spark.range(1), path, None)
    gate, results = threading.Barrier(4), []

    def publish(n):
        new = commits.Manifest(1, base.schema, base.parts, {"writer": n})
        gate.wait()
        try:
            results.append(commits.publish(spark, path, new).notes["writer"])
        except commits.OutdatedBase:
            results.append(None)

    threads = [threading.Thread(target=publish, args=(n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [r for r in results if r is not None]
    assert len(results) == 4 and len(winners) == 1
    assert commits.manifest(spark, path).notes == {"writer": winners[0]}
    assert not [n for n in fs.names(spark, f"{path}/_commits") if n.endswith(".json") and n.startswith(".")]


def test_readers_never_miss_the_table(spark, tmp_path):
    """A reader that runs while versions are replaced sees one whole version after the other."""
    path, seen, done = str(tmp_path / "t"), [], threading.Event()
    base = commits.commit(spark.range(10).coalesce(1), path, None)

    def look():
        while not done.is_set():
            seen.append(commits.read(spark, path).count())

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(2, 6):
        base = commits.commit(spark.range(10 * n).coalesce(1), path, base)
    done.set()
    reader.join()
    assert seen and seen == sorted(seen) and set(seen) <= {10, 20, 30, 40, 50}


def test_files_per_day_stay_bounded(spark, ledger_rows, tmp_path):
    """Twenty batches that all touch the same three days, replays included."""
    path, rng = str(tmp_path / "b"), np.random.default_rng(2)
    everything = []
    for number in range(20):
        rows = [
            (f"t{number}-{i}", f"a{rng.integers(4)}", f"2024-01-0{rng.integers(1, 4)} 0{rng.integers(3)}:00", round(rng.normal(), 2))
            for i in range(6)
        ]
        everything += rows
        batch = ledger_rows(*rows)
        made = balance_deltas.add_batch(batch, number, path)
        assert max(map(len, made.parts.values())) <= balance_deltas.MAX_FOLDERS
    assert made.version == 19 and balance_deltas.add_batch(batch, 19, path) == made
    want = daily_balance(ledger_rows(*everything))
    got = balance_deltas.balances(spark, path)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.select(*got.columns).collect()))
    early = Counter(map(tuple, balance_deltas.balances(spark, path, 0).collect()))
    assert early == Counter(map(tuple, daily_balance(ledger_rows(*everything[:6])).select(*got.columns).collect()))
    one_day = balance_deltas.balances(spark, path, days=["2024-01-02"])
    assert {str(r.txn_date.date()) for r in one_day.collect()} == {"2024-01-02"}
    commits.vacuum(spark, path)
    assert balance_deltas.balances(spark, path).count() == got.count()


def test_deltas_leave_out_rows_without_keys(spark, ledger_rows, tmp_path):
    path = str(tmp_path / "b")
    rows = ledger_rows(("t1", "a", "2024-01-01", 1), (None, "a", "2024-01-01", 2), ("t3", None, "2024-01-01", 4))
    balance_deltas.add_batch(rows, 0, path)
    balance_deltas.add_batch(rows.limit(0), 1, path)
    got = [(r.account_id, r.total_amount, r.txn_count) for r in balance_deltas.balances(spark, path).collect()]
    assert got == [("a", 3.0, 1)]


SIDES = "txn_date timestamp_ntz, txn_id string, amount_clean double, status_clean string"


def brute_offending(raw, kept):
    sides = []
    for rows in (raw, kept):
        side = {}
        for at, txn, amount in rows:
            if at is not None:
                side.setdefault((at, txn), []).append(amount)
        sides.append({k: (len(v), sum(x is not None for x in v), round(sum(x or 0 for x in v), 6)) for k, v in side.items()})
    left, right = sides
    kinds = {k: "missing" if k not in right else "extra" if k not in left else "changed" for k in left.keys() | right.keys()}
    return {(k, kind) for k, kind in kinds.items() if left.get(k) != right.get(k)}


@pytest.mark.parametrize("fan_out,levels", [(2, 1), (4, 3), (16, 3)])
def test_offending_rows(spark, fan_out, levels):
    rng = np.random.default_rng(fan_out)
    days = [datetime(2024, 1, 1) + timedelta(days=d) for d in range(5)] + [None]
    raw = [(days[rng.integers(6)], f"t{i}", float(rng.integers(9))) for i in range(300)]
    raw += [(days[0], None, 5.0), (days[0], None, 5.0), (days[1], "twice", 1.0), (days[1], "twice", 2.0), (days[2], "no", None)]
    kept = [r for r in raw if rng.random() > 0.03]
    kept = [(d, t, a + 1 if a is not None and rng.random() < 0.03 else a) for d, t, a in kept]
    kept += [(days[3], "new", 0.0), (days[0], None, 5.0), (days[1], "twice", 1.0), (days[4], "swap", 2.0)]
    clean = spark.createDataFrame([(*r, "SUCCESS") for r in raw] + [(days[0], "failed", 1.0, "FAILED")], SIDES)
    ledger = spark.createDataFrame(kept, "txn_date timestamp_ntz, txn_id string, amount double")
    out = recon_tree.offending_rows(clean, ledger, fan_out, levels).collect()
    assert {((r.txn_date, r.txn_id), r.kind) for r in out} == brute_offending(raw, kept)
    assert len(out) == len({(r.txn_date, r.txn_id) for r in out})


def test_equal_sides_offend_nothing(spark):
    rows = [(datetime(2024, 1, 1), f"t{i}", float(i), "SUCCESS") for i in range(50)]
    clean = spark.createDataFrame(rows, SIDES)
    ledger = clean.select("txn_date", "txn_id", F.col("amount_clean").alias("amount"))
    assert recon_tree.offending_rows(clean, ledger.repartition(7)).count() == 0
    assert recon_tree.differing_leaves(clean, ledger.filter("txn_id <> 't7'")).count() == 1
    assert recon_tree.offending_rows(clean.limit(0), ledger.limit(0)).count() == 0
