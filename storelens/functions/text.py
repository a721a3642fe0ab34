"""Display text Column helpers for the dashboard-style outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_text(x: Column | str) -> Column:
    """``$1,234.56``."""
    return F.concat(F.lit("$"), F.format_number(_col(x).cast("double"), 2))


def fixed(x: Column | str, digits: int) -> Column:
    """Number with ``digits`` decimals and no grouping, rounded half-even on
    the exact binary value (as Python's ``format(x, '.2f')``)."""
    return F.regexp_replace(F.format_number(_col(x).cast("double"), digits), ",", "")


def short_money(x: Column | str) -> Column:
    """``1.2m`` from a million, ``3.4k`` from a thousand, the plain number below."""
    v = _col(x).cast("double")
    return (F.when(v >= 1e6, F.concat(fixed(v / 1e6, 1), F.lit("m")))
            .when(v >= 1e3, F.concat(fixed(v / 1e3, 1), F.lit("k")))
            .otherwise(v.cast("string")))


def percent_text(x: Column | str) -> Column:
    """``12.34%``; ``n/a`` for a missing value."""
    return F.coalesce(F.concat(fixed(x, 2), F.lit("%")), F.lit("n/a"))


def millions_text(x: Column | str) -> Column:
    """``$1,234.56 Mio`` for an amount in units (shown in millions)."""
    return F.concat(F.lit("$"), F.format_number(_col(x).cast("double") / 1e6, 2), F.lit(" Mio"))
