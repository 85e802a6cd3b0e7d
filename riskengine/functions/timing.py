"""Time expressions. Every window orders by a bigint of microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def epoch_seconds(ts: Column | str) -> Column:
    return F.unix_timestamp(col(ts).cast("timestamp"))


def event_date(ts: Column | str) -> Column:
    return F.to_date(col(ts))


def from_origin(seconds: Column | str, origin: str = "2025-01-01 00:00:00") -> Column:
    """Relative seconds to a timestamp, counted from a fixed origin."""
    us = F.unix_micros(F.lit(origin).cast("timestamp")) + F.round(col(seconds) * SECOND).cast("long")
    return F.timestamp_micros(us)


def plus_hours(ts: Column | str, hours: Column | int) -> Column:
    h = F.lit(hours) if isinstance(hours, (int, float)) else hours
    return F.timestamp_micros(F.unix_micros(col(ts)) + (h * HOUR).cast("long"))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(HOUR))


def is_night(ts: Column | str) -> Column:
    """02:00 up to and including 04:59."""
    return F.hour(col(ts)).between(2, 4)
