"""Timestamps: signed milliseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.errors import InvalidArgument

#: Milliseconds that Spark's microseconds can hold.
LIMIT = 9_223_372_036_854_775


def from_millis(ms: Column) -> Column:
    """A timestamp column; rows that Spark cannot hold fail."""
    return F.when(F.abs(ms) <= LIMIT, F.timestamp_millis(ms)).when(ms.isNotNull(), F.raise_error(F.lit("a timestamp is out of range")).cast("timestamp"))


def iso_column(ts: Column) -> Column:
    """2024-01-01T00:00:00.000Z, in UTC (the session's zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_text(ms: int) -> str:
    """The same for one number; whole days are counted down from the epoch, so earlier times come out right."""
    days, rest = divmod(ms, 86_400_000)
    if abs(days) > 3_652_059 * 1_000:
        raise InvalidArgument("a timestamp is out of range")
    # civil date of a day number, by 400-year cycles from 1 March 0000
    z = days + 719_468
    era, doe = divmod(z, 146_097)
    yoe = (doe - doe // 1_460 + doe // 36_524 - doe // 146_096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    m = (5 * doy + 2) // 153
    day, month = doy - (153 * m + 2) // 5 + 1, m + 3 if m < 10 else m - 9
    year = yoe + era * 400 + (month <= 2)
    hour, rest = divmod(rest, 3_600_000)
    minute, rest = divmod(rest, 60_000)
    return f"{year:04d}-{month:02d}-{day:02d}T{hour:02d}:{minute:02d}:{rest // 1000:02d}.{rest % 1000:03d}Z"
