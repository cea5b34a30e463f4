"""Date and time column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the sentinel that stands for a missing approval time.
SENTINEL = "1453-05-29 00:00:00"
DEFAULT_ZONE = "Asia/Istanbul"


def sentinel(dtype: T.DataType | None = None) -> Column:
    """The sentinel timestamp as a literal of ``dtype`` (NTZ by default).

    For a time-zone-aware column the literal is read as UTC wall time.
    """
    if isinstance(dtype, T.TimestampType):
        return F.to_utc_timestamp(F.to_timestamp_ntz(F.lit(SENTINEL)), "UTC")
    return F.to_timestamp_ntz(F.lit(SENTINEL))


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    """Whole 24-hour units from start to end, truncated toward zero (bigint)."""
    return F.timestamp_diff("DAY", _c(start), _c(end))


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _c(start), _c(end))


def calendar_days(start: Column | str, end: Column | str) -> Column:
    """Calendar days between the dates of two times (int)."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def year_month(ts: Column | str) -> Column:
    """``YYYY-MM`` from the date parts (no session time zone involved)."""
    c = _c(ts)
    return F.concat(F.year(c).cast("string"), F.lit("-"),
                    F.lpad(F.month(c).cast("string"), 2, "0"))


def timestamp_text(ts: Column | str, dtype: T.DataType | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss``.  Zone-less timestamps are printed as stored
    (``date_format`` would pass them through the session zone and move
    wall times that fall in a daylight-saving gap)."""
    c = _c(ts)
    if isinstance(dtype, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return F.substring(c.cast("string"), 1, 19)


def week_label(ts: Column | str) -> Column:
    """``YYYY-WW`` with Monday weeks numbered 00-53, days before the first
    Monday of the year in week 00 (strftime ``%Y-%W``)."""
    d = F.to_date(_c(ts))
    week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return F.concat(F.year(d).cast("string"), F.lit("-"),
                    F.lpad(week.cast("string"), 2, "0"))


def local_date(ts: Column | str, zone: str = DEFAULT_ZONE,
               dtype: T.DataType | None = None) -> Column:
    """Date of a UTC time as seen in ``zone``.

    Zone-less timestamps are UTC wall time and need no session setting;
    zone-aware ones are instants shown in the session zone (UTC expected).
    """
    c = _c(ts)
    if isinstance(dtype, T.TimestampType):
        return F.to_date(F.from_utc_timestamp(c, zone))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), c))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
