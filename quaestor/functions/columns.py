"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaestor import constants as C

MONEY = "decimal(28,10)"
# Amounts of this size or more are unreadable; smaller ones fit MONEY, and 1e11 of them its sum.
MAX_AMOUNT = 1e17
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI]nf(inity)?)$"


def or_false(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(*C.NA_TOKENS), c)


def upper_in(c: Column, words: Iterable[str]) -> Column:
    """``upper(c)`` is one of ``words``; false for null. No trimming."""
    return or_false(F.upper(c.cast("string")).isin(*words))


def lenient_double(c: Column, dtype: T.DataType) -> Column:
    """A number, or null where the text is not one."""
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    text = F.trim(c.cast("string"))
    # The pattern goes first: a failing cast is far dearer, and Java would read "12d" as well.
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def amount_number(c: Column, dtype: T.DataType) -> Column:
    """An amount as a double; null where it is not a number, not finite, or does not fit a sum."""
    number = lenient_double(c, dtype)
    return F.when(F.abs(number) < MAX_AMOUNT, number)


def lenient_timestamp(c: Column, dtype: T.DataType, fmt: str | None = None) -> Column:
    """A zone-free timestamp per value (ISO date or timestamp unless ``fmt``), else null."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if fmt is not None:
        return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("timestamp_ntz")
    return F.trim(c.cast("string")).try_cast("timestamp_ntz")


def day_start(c: Column) -> Column:
    return F.to_date(c).cast("timestamp_ntz")


def success_or_failed(status: Column, success: Iterable[str] | None) -> Column:
    words = tuple(success or C.SUCCESS_STATUSES)
    return F.when(upper_in(status, words), "SUCCESS").otherwise("FAILED")


def signed_amount(amount: Column, dtype: T.DataType, txn_type: Column, refunds: Iterable[str]) -> Column:
    """The amount as a double: 0.0 where missing or unreadable (counted in validation), refunds negative."""
    value = F.coalesce(amount_number(amount, dtype), F.lit(0.0))
    return F.when(upper_in(txn_type, refunds), -F.abs(value)).otherwise(value)


def exact_sum(c: Column) -> Column:
    """Sum as decimal, so that the result does not depend on the order of the rows."""
    return F.sum(c.cast(MONEY))


def half_even(c: Column, digits: int = 2) -> Column:
    return F.bround(c, digits)


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)


def event_time(ts: Column) -> Column:
    """A zone-free timestamp as the instant that watermarks and event-time windows need."""
    return F.timestamp_micros(micros(ts))


def zone_free(instant: Column) -> Column:
    """The inverse of :func:`event_time`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), _epoch())


def minute_stamp(ts: Column) -> Column:
    """``yyyyMMddHHmm`` of a zone-free timestamp."""
    return F.regexp_replace(F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 16), "[^0-9]", "")
