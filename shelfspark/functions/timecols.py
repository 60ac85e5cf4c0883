"""Time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_days(start: Column, end: Column) -> Column:
    """Whole elapsed 24-hour days from ``start`` to ``end``.

    Not a calendar-date difference: 02:00 to 01:00 two days later is 1.
    Requires the session time zone to be UTC (see ``shelfspark.session``).
    """
    return F.timestamp_diff("DAY", start, end)


def parse_timestamp(c: Column) -> Column:
    """Lenient timestamp parse: ISO date or timestamp strings, bad values become null.

    Already-typed timestamp columns pass through unchanged by the caller.
    """
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))
