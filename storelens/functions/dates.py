"""Date and time Column helpers (order times are TIMESTAMP_NTZ in UTC)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names, Monday first (weekday 0 = Monday).
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
# Month key and month name patterns, display time zone.
MONTH_KEY_PATTERN = "yyyy-MM"
MONTH_NAME_PATTERN = "MMMM"
DISPLAY_TZ = "America/Los_Angeles"


def year_start(year: int) -> Column:
    """Literal TIMESTAMP_NTZ of 1 January ``year``, 00:00."""
    return F.expr(f"TIMESTAMP_NTZ'{int(year):04d}-01-01 00:00:00'")


def in_years(ts: Column | str, years: Iterable[int]) -> Column:
    """``year(ts) IN years`` written as timestamp ranges.

    A range on the raw column reaches the Parquet reader as pushed filters
    (row-group skipping); ``year(ts)`` would push only ``IS NOT NULL``.
    Consecutive years become one range, gaps an OR of ranges.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    ys = sorted({int(y) for y in years})
    if not ys:
        return F.lit(False)
    runs, start, prev = [], ys[0], ys[0]
    for y in ys[1:]:
        if y != prev + 1:
            runs.append((start, prev))
            start = y
        prev = y
    runs.append((start, prev))
    cond = None
    for a, b in runs:
        r = (ts >= year_start(a)) & (ts < year_start(b + 1))
        cond = r if cond is None else cond | r
    return cond


def weekday(ts: Column | str) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(ts)


def weekday_name(day: Column | str) -> Column:
    """English name of a weekday number (0 = Monday)."""
    day = F.col(day) if isinstance(day, str) else day
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAY_NAMES]), day.cast("int") + 1)


def local_hour(ts: Column | str, tz: str = DISPLAY_TZ) -> Column:
    """Hour of day (0–23) of a UTC wall time seen in time zone ``tz``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts))


def month_key(ts: Column | str) -> Column:
    """``yyyy-MM`` text of the month."""
    return F.date_format(ts, MONTH_KEY_PATTERN)


def month_name(ts: Column | str) -> Column:
    """English month name."""
    return F.date_format(ts, MONTH_NAME_PATTERN)


def whole_days(start: Column | str, end: Column | str) -> Column:
    """Whole days from ``start`` to ``end``, rounded down (a timedelta's ``.days``)."""
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("DAY", start, end)
