"""Column helpers for wall-clock (timestamp_ntz) bar times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_of_day(ts: str | Column) -> Column:
    """hour*3600 + minute*60 + second, keeping the fractional second."""
    t = col(ts)
    return (F.hour(t) * 3600 + F.minute(t) * 60).cast("double") + \
        F.extract(F.lit("SECOND"), t).cast("double")


def hm(h: int, m: int = 0, s: float = 0.0) -> float:
    return h * 3600 + m * 60 + s


def seconds_between(a: str | Column, b: str | Column) -> Column:
    """Elapsed seconds from ``a`` to ``b`` (double, microsecond precision)."""
    return F.timestamp_diff("MICROSECOND", col(a), col(b)).cast("double") / 1e6


def whole_days_between(a: str | Column, b: str | Column) -> Column:
    """Whole days of the elapsed time (floor), like ``timedelta.days``."""
    return F.floor(seconds_between(a, b) / 86400.0)


def day_start(ts: str | Column) -> Column:
    """Midnight of the bar's date as timestamp_ntz (no time-zone arithmetic)."""
    return F.to_date(col(ts)).cast("timestamp_ntz")


def minute_start(ts: str | Column) -> Column:
    t = col(ts)
    return F.timestamp_add("MINUTE", F.hour(t) * 60 + F.minute(t), day_start(t))


def week_start_sunday(ts: str | Column) -> Column:
    t = col(ts)
    return F.date_sub(F.to_date(t), F.dayofweek(t) - 1).cast("timestamp_ntz")


def month_start(ts: str | Column) -> Column:
    return F.trunc(F.to_date(col(ts)), "month").cast("timestamp_ntz")


_EPOCH = "1970-01-01 00:00:00"


def wall_to_instant(ts: str | Column) -> Column:
    """timestamp_ntz wall clock → timestamp read as if the wall clock were UTC
    (no session time zone involved); for event-time watermarks."""
    us = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), col(ts))
    return F.timestamp_micros(us)


def instant_to_wall(ts: str | Column) -> Column:
    """Inverse of :func:`wall_to_instant`."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(ts)), F.lit(_EPOCH).cast("timestamp_ntz"))
