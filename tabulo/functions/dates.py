"""Date cleaners.

Patterns are tried in order with ``try_to_timestamp`` (NULL, not an error,
on a mismatch or an impossible date such as 30 February), then cast to date.
Day-first patterns come before month-first ones (deviation D2).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c, strip_ws

# The five layouts of the basic cleaner, in order.
BASIC_PATTERNS = ["d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "d.M.yyyy"]

# The ten layouts of the extended cleaner, in order
# (ISO, d/m/Y, d-m-Y, m/d/Y, d.m.Y, Ymd, "d Mon Y", "d Month Y", "Mon d, Y", Y/m/d).
EXTENDED_PATTERNS = [
    "yyyy-M-d", "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "d.M.yyyy",
    "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "yyyy/M/d",
]


def _may_fit(s: Column, pattern: str) -> Column:
    """What a text must have for the layout to fit at all: its separator after one or two (day, month) or at least four (year)
    characters, or first (a year with a sign).  A failed parse costs an exception, so a text meets only the one or two layouts of its shape."""
    mark = next((m for m in " -/." if m in pattern), None)
    if mark is None:  # digits only
        return ~F.rlike(s, F.lit(r"[-/. ,]"))
    at = F.locate(mark, s)
    return (at >= 5) | (at == 1) if pattern.startswith("y") else (at >= 2) & (at <= 3) if pattern.startswith(("d", "M/")) else at >= 4


def _parse(s: Column, patterns) -> Column:
    return F.coalesce(*[F.when(_may_fit(s, p), F.try_to_timestamp(s, F.lit(p))) for p in patterns])


def clean_date_basic(col) -> Column:
    """Five day-first layouts -> date, else NULL."""
    s = strip_ws(_c(col).cast("string"))
    return _parse(s, BASIC_PATTERNS).cast("date")


def _iso(s: Column) -> Column:
    """The lenient ISO cast, for text that starts with a year (a bare time of day would become today's date)."""
    return F.when(s.rlike(r"^[+-]?\d{4}"), s.try_cast("timestamp"))


def clean_date_multi(col) -> Column:
    """Ten layouts, then a lenient ISO fallback (date with optional time)."""
    s = strip_ws(_c(col).cast("string"))
    return F.coalesce(_parse(s, EXTENDED_PATTERNS), _iso(s)).cast("date")


def to_datetime(col, source_type: str = "string") -> Column:
    """Column to timestamp, bad values NULL; native temporal types pass through."""
    c = _c(col)
    if source_type in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("timestamp")
    s = strip_ws(c.cast("string"))
    return F.coalesce(_iso(s), _parse(s, EXTENDED_PATTERNS))


def merge_day_month_year(day, month, year) -> Column:
    """Three numeric-ish columns -> one date; invalid -> NULL (never throws)."""
    d, m, y = (_c(x).cast("string").try_cast("int") for x in (day, month, year))
    return F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0)).cast("date")
