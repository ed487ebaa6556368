"""Reading, validating and transforming a feed."""

import pytest
from pyspark.sql import functions as F

from quaestor import constants as C
from quaestor.operators import transform, validate
from quaestor.params import FeedParams
from quaestor.sources.feed import read_feed_csv, read_ledger
from quaestor.sources.sinks import write_ledger

from .conftest import by_id, collect, row

HEADER = ",".join(C.REQUIRED_COLUMNS)


def csv(tmp_path, *lines, header=HEADER, name="feed.csv"):
    path = tmp_path / name
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_csv_keeps_text_and_extra_columns(spark, tmp_path):
    path = csv(tmp_path, "t1,a,2024-01-01,2024-01-01,007,EUR,CARD,OK,x", header=HEADER + ",branch")
    df = read_feed_csv(spark, path)
    assert df.columns == [*C.REQUIRED_COLUMNS, "branch"]
    assert df.first().amount == "007"


def test_csv_missing_words_become_null(spark, tmp_path):
    path = csv(tmp_path, "t1,NA,2024-01-01,2024-01-01,nan,EUR,N/A,null", ",a,,,,,,")
    rows = read_feed_csv(spark, path).collect()
    assert (rows[0].account_id, rows[0].amount, rows[0].txn_type, rows[0].status) == (None,) * 4
    assert rows[1].txn_id is None


def test_csv_doubled_quotes(spark, tmp_path):
    path = csv(tmp_path, '"t""1",a,2024-01-01,2024-01-01,1,EUR,CARD,OK')
    assert read_feed_csv(spark, path).first().txn_id == 't"1'


def test_csv_header_only_and_missing_path(spark, tmp_path):
    df = read_feed_csv(spark, csv(tmp_path))
    assert df.count() == 0 and len(df.columns) == 8
    with pytest.raises(FileNotFoundError):
        read_feed_csv(spark, str(tmp_path / "absent.csv"))


def test_csv_missing_column(spark, tmp_path):
    path = csv(tmp_path, "t1,a", header="txn_id,account_id")
    with pytest.raises(ValueError, match="Missing required columns: \\['amount'"):
        read_feed_csv(spark, path)


def test_files_with_other_header_order_are_rejected(spark, tmp_path):
    csv(tmp_path, "t1,a,2024-01-01,2024-01-01,1,EUR,CARD,OK", name="a.csv")
    other = ",".join(reversed(C.REQUIRED_COLUMNS))
    csv(tmp_path, "OK,CARD,EUR,1,2024-01-01,2024-01-01,a,t2", header=other, name="b.csv")
    with pytest.raises(Exception, match="(?i)header"):
        read_feed_csv(spark, str(tmp_path)).collect()


def test_valid_feed_passes(base_feed):
    assert validate.validate_feed(base_feed) is base_feed


def test_duplicate_ids_fail_first(feed):
    with pytest.raises(ValueError, match="Duplicate txn_id.*t1"):
        validate.validate_feed(feed(row("t1"), row("t1", account=None)))


def test_null_ids_count_as_one_value(feed):
    validate.validate_feed(feed(row(None), row("t1")))
    with pytest.raises(ValueError, match="Duplicate txn_id"):
        validate.validate_feed(feed(row(None), row(None)))


def test_nulls_are_reported_in_order(feed):
    df = feed(row("b1"), row("b2", status=None), row("b4", account=None), row("b5", kind=None))
    with pytest.raises(ValueError, match="account_id has 1 null"):
        validate.validate_feed(df)


def test_types_ignore_case_but_not_blanks(feed):
    validate.validate_feed(feed(row("t1", kind="card")))
    with pytest.raises(ValueError, match="Invalid txn_type"):
        validate.validate_feed(feed(row("t1", kind=" CARD")))
    validate.validate_feed(feed(row("t1", kind="barter")), FeedParams(valid_txn_types=None))


def test_bad_dates(feed):
    with pytest.raises(ValueError, match="Invalid txn_date in 1"):
        validate.validate_feed(feed(row("t1", txn_date="not-a-date")))
    with pytest.raises(ValueError, match="Invalid ingestion_date"):
        transform.transform_transactions(feed(row("t1", ingested=None)), validate=True)


def test_strict_amounts(feed):
    df = feed(row("t1", amount="abc"), row("t2", amount=None))
    validate.validate_feed(df)
    with pytest.raises(ValueError, match="Invalid amount in 1"):
        validate.validate_feed(df, strict_amounts=True)


def test_violations_are_rows(feed):
    df = feed(row("t1"), row("t1"), row("t2", account=None, kind="x"))
    assert collect(validate.violations(df)) == [
        ("t1", "duplicate_id", "2"),
        ("t2", "not_null", "account_id"),
        ("t2", "txn_type", "x"),
    ]


@pytest.mark.parametrize(
    ("status", "expected"),
    [(s, "SUCCESS") for s in ("COMPLETED", "completed", "Settled", "OK", "ok")]
    + [(s, "FAILED") for s in ("FAILED", "PENDING", "CANCELLED", "", None, "123", "True", " OK")],
)
def test_status(feed, status, expected):
    clean, _ = transform.transform_transactions(feed(row("t1", status=status)))
    assert clean.first().status_clean == expected


def test_empty_success_list_means_default(feed):
    clean, _ = transform.transform_transactions(feed(row("t1")), FeedParams(success_statuses=()))
    assert clean.first().status_clean == "SUCCESS"


@pytest.mark.parametrize(
    ("amount", "kind", "expected"),
    [
        ("100", "CARD", 100.0),
        ("-20", "CARD", -20.0),
        ("50", "refund", -50.0),
        ("-50", "REFUND", -50.0),
        ("50", " REFUND", 50.0),
        ("1e3", "CARD", 1000.0),
        (" 7 ", "CARD", 7.0),
        ("abc", "CARD", 0.0),
        ("12d", "CARD", 0.0),
        ("1.5F", "CARD", 0.0),
        ("0x1f", "CARD", 0.0),
        ("nan", "CARD", 0.0),
        (None, "CARD", 0.0),
        ("5", None, 5.0),
    ],
)
def test_amount(feed, amount, kind, expected):
    assert transform.clean_transactions(feed(row("t1", amount=amount, kind=kind))).first().amount_clean == expected


def test_late_is_by_day(feed):
    df = feed(
        row("same", txn_date="2024-01-01 23:59:59", ingested="2024-01-01"),
        row("next", txn_date="2024-01-01 23:59:59", ingested="2024-01-02 00:00:01"),
        row("early", ingested="2023-12-31"),
        row("week", ingested="2024-01-08"),
    )
    late = by_id(transform.clean_transactions(df), "is_late")
    assert late == {"same": False, "next": True, "early": False, "week": True}
    lenient = by_id(transform.clean_transactions(df, FeedParams(late_days=1)), "is_late")
    assert lenient == {"same": False, "next": False, "early": False, "week": True}


def test_dates_keep_time_but_ingestion_does_not(feed):
    df = feed(row("t1", txn_date="2024-01-01T10:20:30.123456", ingested="2024-01-02 11:00:00"))
    got = transform.parse_dates(df).first()
    assert str(got.txn_date) == "2024-01-01 10:20:30.123456"
    assert str(got.ingestion_date) == "2024-01-02 00:00:00"


def test_explicit_date_format(feed):
    df = feed(row("t1", txn_date="31/12/2023", ingested="01/01/2024"))
    got = transform.parse_dates(df, FeedParams(date_format="dd/MM/yyyy")).first()
    assert str(got.txn_date) == "2023-12-31 00:00:00"


def test_ledger_layout_and_signs(base_feed):
    clean, ledger = transform.transform_transactions(base_feed)
    assert tuple(ledger.columns) == C.LEDGER_COLUMNS
    assert by_id(ledger, "amount", "is_late") == {
        "t1": (100.0, False),
        "t2": (-20.0, True),
        "t3": (50.0, False),
    }
    assert clean.count() == 3 and "amount" in clean.columns


def test_empty_feed(feed, base_feed):
    clean, ledger = transform.transform_transactions(base_feed.limit(0))
    assert clean.count() == ledger.count() == 0


def test_result_does_not_depend_on_session_zone(spark, feed):
    df = feed(row("t1", txn_date="2024-03-31 02:30:00", ingested="2024-03-31"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Vienna")
    try:
        got = transform.clean_transactions(df).select(F.col("txn_date").cast("string"), "is_late").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == ("2024-03-31 02:30:00", False)


def test_ledger_round_trip(spark, base_feed, tmp_path):
    _, ledger = transform.transform_transactions(base_feed)
    path = str(tmp_path / "ledger.parquet")
    write_ledger(ledger, path)
    write_ledger(ledger.filter("txn_id <> 't3'"), path)
    back = read_ledger(spark, path)
    assert collect(back, "txn_id") == [("t1",), ("t2",)]
    assert [p.name for p in tmp_path.iterdir()] == ["ledger.parquet"]


def test_ledger_reader_checks(spark, base_feed, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_ledger(spark, str(tmp_path / "none.parquet"))
    other = tmp_path / "x.txt"
    other.write_text("x")
    with pytest.raises(ValueError, match="not a Parquet"):
        read_ledger(spark, str(other))
    base_feed.write.parquet(str(tmp_path / "raw"))
    with pytest.raises(ValueError, match="is_late"):
        read_ledger(spark, str(tmp_path / "raw"))


@pytest.mark.parametrize(
    ("ids", "message"), [(["a", None], "1 null"), (["a", "a"], "Duplicate txn_id values: \\['a'\\]")]
)
def test_bad_ledger_ids(spark, tmp_path, ids, message):
    df = spark.createDataFrame([(i, 1.0) for i in ids], "txn_id string, amount double")
    with pytest.raises(ValueError, match=message):
        write_ledger(df, str(tmp_path / "l"))
    with pytest.raises(ValueError, match="txn_id"):
        write_ledger(df.drop("txn_id"), str(tmp_path / "l"))
    assert not (tmp_path / "l").exists()


def test_empty_ledger_keeps_schema(spark, base_feed, tmp_path):
    _, ledger = transform.transform_transactions(base_feed.limit(0))
    write_ledger(ledger, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).columns == list(C.LEDGER_COLUMNS)
