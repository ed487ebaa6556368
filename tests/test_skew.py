"""Hot keys: the split paths give the same results as the plain ones, whatever the sizes."""

import random

import pytest
from pyspark.sql import functions as F

from quaestor.operators import skew, velocity
from quaestor.operators.numbering import number_in_order
from quaestor.operators.throttle import sliced, throttle
from quaestor.params import SkewParams

from .conftest import collect


def test_params_bound_the_hot_list():
    with pytest.raises(ValueError):
        SkewParams(max_hot_keys=1_000_000)
    with pytest.raises(ValueError):
        SkewParams(min_hot_rows=0)


def test_find_hot_keys(spark):
    df = spark.createDataFrame([("a",)] * 50 + [("b",)] * 5 + [(None,)] * 80, "k string")
    assert skew.find_hot_keys(df, ("k",), SkewParams(min_hot_rows=50)) is None
    hot = skew.find_hot_keys(df, ("k",), SkewParams(min_hot_rows=10))
    assert collect(hot.keys) == [("a",)] and hot.rows == 50
    cold_rows, hot_rows = hot.split(df)
    assert (cold_rows.count(), hot_rows.count()) == (85, 50)


def test_limit_grows_with_the_total(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert skew.find_hot_keys(df, ("k",), SkewParams(min_hot_rows=1, max_hot_keys=9)) is None
    assert skew.find_hot_keys(df, ("k",), SkewParams(min_hot_rows=1, max_hot_keys=11)).keys.count() == 10
    assert skew.find_hot_keys(df.limit(0), ("k",), SkewParams(min_hot_rows=1)) is None


@pytest.fixture(scope="module")
def skewed_ledger(spark):
    """One account holds half of the rows, many of them at the same time; some ids are null."""
    rng = random.Random(11)
    rows = []
    for i in range(1500):
        account = "hot" if i % 2 else f"a{rng.randrange(60)}"
        rows.append((f"t{i:05d}", account, rng.randrange(12), float(rng.randrange(1, 9000))))
    df = spark.createDataFrame(rows, "txn_id string, account_id string, d int, amount double")
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(d)")
    return df.select("txn_id", "account_id", at.alias("txn_date"), "amount")


@pytest.mark.parametrize("slice_rows", [3, 29, 31, 200])
@pytest.mark.parametrize("windows", [("1D", "7D", "30D"), ("1D",), ("2D",)])
def test_sliced_velocity(skewed_ledger, slice_rows, windows):
    plain = velocity.velocity_rows(skewed_ledger, windows, skew=None)
    split = velocity.velocity_rows(skewed_ledger, windows, SkewParams(min_hot_rows=100, slice_rows=slice_rows))
    assert split.columns == plain.columns
    assert collect(split) == collect(plain)


def test_sliced_velocity_of_several_hot_accounts(skewed_ledger):
    two = skewed_ledger.withColumn("account_id", F.when(F.col("account_id") == "hot", "hot").otherwise("other"))
    split = velocity.velocity_rows(two, skew=SkewParams(min_hot_rows=1, slice_rows=40))
    assert collect(split) == collect(velocity.velocity_rows(two, skew=None))


def test_velocity_does_not_depend_on_partitions(skewed_ledger):
    expected = collect(velocity.velocity_rows(skewed_ledger, skew=None))
    assert collect(velocity.velocity_rows(skewed_ledger.repartition(7), skew=None)) == expected


def brute_force(rows, wait):
    last, sent = {}, set()
    for key, at, i in sorted(rows):
        if key not in last or at - last[key] >= wait:
            last[key] = at
            sent.add(i)
    return sent


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(1)
    rows = []
    gaps = {"sparse": [4000, 200, 9000], "mixed": [0, 1, 5, 60, 4000], "dense": [0, 1, 5, 20], "even": [7], "one": [1]}
    for key, size in (("sparse", 200), ("mixed", 800), ("dense", 2500), ("even", 1200), ("one", 1)):
        at = 0
        for _ in range(size):
            at += rng.choice(gaps[key])
            rows.append((key, at, len(rows)))
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    at = F.expr("timestamp_ntz'1969-12-31 22:00:00' + make_dt_interval(0, 0, 0, t)")
    return rows, df.select("k", "i", at.alias("at")).repartition(5)


@pytest.mark.parametrize("minutes", [0.5, 5, 90])
@pytest.mark.parametrize("hot", [10**6, 500, 1])
def test_throttle(noisy, minutes, hot):
    rows, df = noisy
    sent = throttle(df, F.col("k"), "at", "i", minutes, SkewParams(min_hot_rows=hot))
    assert sent.columns == df.columns
    got = [r.i for r in sent.select("i").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_force(rows, round(minutes * 60))


def test_stretches_are_cut_by_rows(spark):
    """A burst within an hour, one event ten years before, and many events at one time."""
    rows = [("k", 0, 0)] + [("k", 315_000_000 + i // 8, i + 1) for i in range(20_000)]
    rows += [("k", 315_003_000, 30_000 + i) for i in range(5_000)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint")
    at = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, t)").alias("at")
    keyed = df.select(F.col("k").alias("_key"), (F.col("t") * 1_000_000).alias("_at"), "i")
    sizes = [r["count"] for r in sliced(keyed, "i", 25).groupBy("_group").count().collect()]
    assert max(sizes) <= 3_000 and sum(sizes) == 2_501 + 1
    for slice_rows in (1_000, 100):
        sent = throttle(df.select("k", "i", at), F.col("k"), "at", "i", 5, SkewParams(min_hot_rows=10, slice_rows=slice_rows))
        assert {r.i for r in sent.collect()} == brute_force(rows, 300)


def test_no_throttle_keeps_all(noisy):
    rows, df = noisy
    assert throttle(df, F.col("k"), "at", "i", 0).count() == len(rows)


def test_numbering_is_contiguous(spark):
    df = spark.range(1000).select(F.col("id"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("x")).repartition(6)
    got = [(r.x, r.n) for r in number_in_order(df, ("x",), "n").collect()]
    assert sorted(got) == [(i, i + 1) for i in range(1000)]


def test_gather_is_not_optimized_away(noisy):
    """A plain repartition after a grouping by the same key is dropped, and then nothing keeps
    the rows of a key together when the join beneath is re-planned."""
    _, df = noisy
    grouped = df.groupBy("k").agg(F.max("i").alias("i"))
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(grouped.repartition("k")) == 1
    assert shuffles(skew.gather(grouped, "k")) == 2


@pytest.mark.parametrize("hot", [10**6, 500])
def test_throttle_goes_on_from_last_sent(spark, noisy, hot):
    """Throttling in two parts, with the state of the first, equals throttling at once."""
    rows, df = noisy
    params = SkewParams(min_hot_rows=hot, slice_rows=100)
    split = F.lit("1969-12-31 23:00:00").cast("timestamp_ntz")
    first = throttle(df.filter(F.col("at") < split), F.col("k"), "at", "i", 5, params)
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    state = first.groupBy(F.col("k").alias("key")).agg(
        F.timestamp_diff("MICROSECOND", epoch, F.max("at")).alias("last_us")
    )
    second = throttle(df.filter(F.col("at") >= split), F.col("k"), "at", "i", 5, params, state)
    got = [r.i for r in first.unionByName(second).select("i").collect()]
    assert sorted(got) == sorted(brute_force(rows, 300))
