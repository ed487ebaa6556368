from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quaestor import constants as C  # noqa: E402
from quaestor.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def feed(spark):
    """Build a text feed from rows of the eight columns."""

    def build(*rows):
        schema = ", ".join(f"{c} string" for c in C.REQUIRED_COLUMNS)
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return build


def row(txn, account="acc1", txn_date="2024-01-01", ingested="2024-01-01", amount="100", kind="CARD", status="OK"):
    return (txn, account, txn_date, ingested, amount, "EUR", kind, status)


@pytest.fixture(scope="session")
def base_feed(feed):
    return feed(
        row("t1", amount="100", status="COMPLETED"),
        row("t2", ingested="2024-01-02", amount="-20", kind="REFUND"),
        row("t3", "acc2", "2024-01-02", "2024-01-02", "50", status="SETTLED"),
    )


@pytest.fixture(scope="session")
def ledger_rows(spark):
    """Build a ledger from (id, account, 'yyyy-mm-dd[ hh:mm]', amount)."""

    def build(*rows):
        out = []
        for txn, account, at, amount in rows:
            when = datetime.fromisoformat(at)
            out.append((txn, account, when, when, float(amount), "USD", "CARD", False))
        schema = (
            "txn_id string, account_id string, txn_date timestamp_ntz, ingestion_date timestamp_ntz, "
            "amount double, currency string, txn_type string, is_late boolean"
        )
        return spark.createDataFrame(out, schema)

    return build


def collect(df, *columns, order=None):
    """Rows as tuples, sorted."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=order or (lambda t: tuple(map(str, t))))


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("txn_id", *columns).collect()}
