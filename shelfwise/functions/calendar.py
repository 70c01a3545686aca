"""Calendar expressions over a purchase timestamp.

All truncations go through ``to_date`` + ``trunc`` so the result is a DATE
whatever the timestamp flavour (``date_trunc`` on TIMESTAMP_NTZ would return a
zoned timestamp).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def purchase_date(ts: str | Column) -> Column:
    """Timestamp → date."""
    return F.to_date(_c(ts))


def iso_weekday(ts: str | Column) -> Column:
    """ISO weekday, 1 = Monday … 7 = Sunday (``dayofweek`` is Sunday-based)."""
    return F.weekday(_c(ts)) + F.lit(1)


def month_start(ts: str | Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(F.to_date(_c(ts)), "month")


def bucket(ts: str | Column, grain: str) -> Column:
    """Truncate to day, ISO week (Monday) or month; always a date."""
    d = F.to_date(_c(ts))
    if grain == "day":
        return d
    if grain == "week":
        return F.trunc(d, "week")
    if grain == "month":
        return F.trunc(d, "month")
    raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")


def calendar_columns(ts: str | Column = "purchase_ts") -> dict[str, Column]:
    """The six derived calendar columns of the transaction loader."""
    return {
        "purchase_date": purchase_date(ts),
        "year": F.year(_c(ts)),
        "month": F.month(_c(ts)),
        "weekday": iso_weekday(ts),
        "hour": F.hour(_c(ts)),
        "month_start": month_start(ts),
    }


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Whole days from ``earlier`` to ``later``."""
    return F.datediff(_c(later), _c(earlier))


def months_between_starts(later: str | Column, earlier: str | Column) -> Column:
    """(Δyear)·12 + Δmonth between two month starts."""
    later, earlier = _c(later), _c(earlier)
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))


def daily_range(start: str | Column, stop: str | Column) -> Column:
    """Every date from ``start`` to ``stop`` inclusive, as an array."""
    return F.sequence(_c(start), _c(stop), F.expr("INTERVAL 1 DAY"))
