"""Dates, times and ages. Use a UTC session time zone so that days have 24 hours."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, functions as F

# Fixed value: the warehouse writes this time for a stay that has not ended.
OPEN_STAY = "0001-01-01 00:00:00"


def from_date_and_time(day: Column, time_of_day: Column) -> Column:
    """Timestamp from a date and an `HH:mm:ss` text."""
    return F.try_to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), time_of_day), F.lit("yyyy-MM-dd HH:mm:ss"))


def close_stay(ts: Column, sentinel: str = OPEN_STAY) -> Column:
    """Null for the sentinel time."""
    return F.when(ts != F.lit(sentinel).cast("timestamp"), ts)


def closed_time(day: Column, time_of_day: Column, sentinel: str = OPEN_STAY) -> Column:
    """Time a stay ended; null while it is open, which its date alone tells, whatever time of day stands beside it."""
    return F.when(F.to_date(day) != F.to_date(F.lit(sentinel)), from_date_and_time(day, time_of_day))


def stay_so_far(admit_day: Column, discharge_ts: Column, as_of: Column) -> Column:
    """Days from admission to discharge, or to the `as_of` date while the stay is open.

    `discharge_ts` is the cleaned time. The date is an argument, never the clock.
    """
    return F.datediff(F.coalesce(F.to_date(discharge_ts), F.to_date(as_of)), F.to_date(admit_day))


def presentation_time(admit: Column, arrival: Column) -> Column:
    """The earlier of admission and arrival; whichever is known if the other is missing."""
    return F.least(admit, arrival)


def age_years(at: Column, born: Column) -> Column:
    """Age with one decimal, from months with a 31-day month fraction."""
    return F.round(F.months_between(at, born) / 12, 1)


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour days between two times."""
    return F.timestamp_diff("DAY", start, end)


def hours_after(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def within_dates(ts: Column, first: str, last: str, slop_days: int = 0) -> Column:
    """Between two times, both included, each moved out by `slop_days`.

    The bounds stay texts, so Spark turns them into the type of the column and
    the filter reaches the files.
    """
    slop = timedelta(days=slop_days)
    low, high = datetime.fromisoformat(first) - slop, datetime.fromisoformat(last) + slop
    return ts.between(F.lit(str(low)), F.lit(str(high)))
