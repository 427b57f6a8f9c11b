"""Instants: strict ISO parsing, nanosecond epochs, delayed local availability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400 * 1_000_000_000
MINUTE_NS = 60 * 1_000_000_000
SECOND_NS = 1_000_000_000
MILLI_NS = 1_000_000

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
_SUB_MICRO = r"\.\d{6}(\d{1,3})"


def event_ns(text: Column) -> Column:
    """ISO-8601 text with an explicit zone to epoch nanoseconds.

    NULL for anything else, naive timestamps included. Spark timestamps stop at
    microseconds, so digits seven to nine are carried separately.
    """
    micros = F.unix_micros(F.try_to_timestamp(text))
    extra = F.rpad(F.regexp_extract(text, _SUB_MICRO, 1), 3, "0").cast("bigint")
    return F.when(text.rlike(_ISO), micros * 1000 + extra)


def canonical_utc(text: Column) -> Column:
    """ISO text (explicit zone, at most six fraction digits) as UTC text; else NULL."""
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$")
    stamp = F.try_to_timestamp(text)
    return F.when(ok & stamp.isNotNull(), utc_text(stamp))


def utc_text(stamp: Column) -> Column:
    """Timestamp as ``yyyy-MM-ddTHH:mm:ss.ffffff+00:00`` (session zone is UTC)."""
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def timestamp_ns(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp")) * 1000


def after_local_date(day: Column, zone: str) -> Column:
    """Next local midnight after a date-only publication, as a UTC instant."""
    return F.to_utc_timestamp(F.date_add(day.cast("date"), 1).cast("timestamp"), zone)


def epoch_micros(stamp: Column) -> Column:
    return F.unix_micros(stamp.cast("timestamp"))


def utc_midnight(day: Column, plus_days: int = 0) -> Column:
    return F.date_add(day, plus_days).cast("timestamp")
