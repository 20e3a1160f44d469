"""Dates, timestamps and times of day (milliseconds since midnight), in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Julian day of 1970-01-01. Fixed value.
JULIAN_EPOCH = 2440588
DAY_MS = 86_400_000


def date_of(*parts: Column) -> Column:
    """From text yyyy/mm/dd or a timestamp, from (year, month, day), or from (year, day of year)."""
    if len(parts) == 3:
        return F.make_date(*parts)
    if len(parts) == 2:
        return F.date_add(F.make_date(parts[0], F.lit(1), F.lit(1)), parts[1].cast("int") - 1)
    return parts[0].cast("date")


def date_of_text(text: Column) -> Column:
    return F.try_to_date(text, "yyyy/MM/dd")


def date_of_julian(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (day - JULIAN_EPOCH).cast("int"))


def julian_day(d: Column) -> Column:
    return F.date_diff(d, F.lit("1970-01-01").cast("date")) + JULIAN_EPOCH


def year(d: Column) -> Column:
    return F.year(d)


def quarter(d: Column) -> Column:
    return F.quarter(d)


def month(d: Column) -> Column:
    return F.month(d)


def day(d: Column) -> Column:
    return F.dayofmonth(d)


def day_of_year(d: Column) -> Column:
    return F.dayofyear(d)


def week_of_year(d: Column) -> Column:
    """ISO week."""
    return F.weekofyear(d)


def week_year(d: Column) -> Column:
    """Year that the ISO week belongs to."""
    return F.extract(F.lit("YEAROFWEEK"), d)


def day_of_week(d: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(d) + 1


def is_leap_year(d: Column) -> Column:
    return F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366


def is_dst(ts: Column, zone: str) -> Column:
    """Whether the zone's clock is ahead of its winter time at this moment."""
    offset = lambda t: F.unix_seconds(F.from_utc_timestamp(t, zone)) - F.unix_seconds(t.cast("timestamp"))
    at = lambda m: F.make_timestamp(F.year(ts), F.lit(m), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return offset(ts) > F.least(offset(at(1)), offset(at(7)))


def is_dst_boundary(ts: Column, zone: str) -> Column:
    """Whether daylight saving begins or ends between this second and the one before."""
    return is_dst(ts, zone) != is_dst(plus_seconds(ts, F.lit(-1)), zone)


def add_days(d: Column, n: Column) -> Column:
    return F.date_add(d, n.cast("int"))


def sub_days(d: Column, n: Column) -> Column:
    return F.date_sub(d, n.cast("int"))


def days_between(a: Column, b: Column) -> Column:
    """a - b in days."""
    return F.date_diff(a, b)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def minute(ts: Column) -> Column:
    return F.minute(ts)


def second(ts: Column) -> Column:
    return F.second(ts)


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def as_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def as_minutes(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 60)


def as_hours(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 3600)


def as_days(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / 86400)


def by_month(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def plus_seconds(ts: Column, n: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(ts.cast("timestamp")) + n)


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds."""
    return F.unix_seconds(a.cast("timestamp")) - F.unix_seconds(b.cast("timestamp"))


def datetime_of(d: Column, millis: Column | None = None) -> Column:
    """Midnight of a date, or the moment that many milliseconds later."""
    ts = d.cast("timestamp")
    return ts if millis is None else F.timestamp_millis(F.unix_millis(ts.cast("timestamp")) + millis)


def datetime_of_int(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def time_of(ts: Column) -> Column:
    return F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.second(ts) * 1000 + F.pmod(F.unix_millis(ts.cast("timestamp")), F.lit(1000)).cast("int")


def time_parts(millis: Column) -> dict[str, Column]:
    """hour, minute, second and millisecond of a time of day."""
    unit = lambda size, wrap: F.pmod(F.floor(millis / size), F.lit(wrap)).cast("int")
    return {"hour": unit(3_600_000, 24), "minute": unit(60_000, 60), "second": unit(1000, 60), "milli": unit(1, 1000)}


def time_as(millis: Column, unit: str) -> Column:
    """Whole hours, minutes, seconds or millis of a time of day."""
    return F.floor(millis / {"hours": 3_600_000, "minutes": 60_000, "seconds": 1000, "millis": 1}[unit]).cast("int")
