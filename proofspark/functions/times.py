"""Time arithmetic on ``timestamp_ntz`` columns that hold UTC wall-clock time."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = Column | datetime.datetime | str


def moment(value: Moment) -> Column:
    """A ``timestamp_ntz`` column from a column, a datetime or a text like ``2024-02-01 08:00``.

    An aware datetime is brought to UTC first; a naive one and a text are taken as UTC.
    """
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, datetime.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def now_utc() -> Column:
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())


def whole_seconds(start: Column, end: Column) -> Column:
    """Elapsed seconds as bigint, the fraction cut off."""
    return (end - start).cast("bigint")


def exact_seconds(start: Column, end: Column) -> Column:
    """Elapsed seconds as double, microseconds kept."""
    return (end - start).cast("decimal(20,6)").cast("double")


def whole_minutes(start: Column, end: Column) -> Column:
    return F.call_function("div", whole_seconds(start, end), F.lit(60))


def rounded_minutes(start: Column, end: Column) -> Column:
    return F.bround(exact_seconds(start, end) / 60, 0).cast("bigint")


def plus_seconds(start: Column, seconds: Column) -> Column:
    zero = F.lit(0)
    return start + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def utc_to_local(ts: Column, tz: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), tz, ts)


def local_to_utc(ts: Column, tz: Column) -> Column:
    return F.convert_timezone(tz, F.lit("UTC"), ts)


# Timestamp layouts of the reports.
LONG_STAMP = "yyyy-MM-dd EEE h:mm a"
SHORT_STAMP = "MM-dd EEE h:mm a"


def long_stamp(ts: Column, tz: Column) -> Column:
    return F.date_format(utc_to_local(ts, tz), LONG_STAMP)


def short_stamp(ts: Column, tz: Column) -> Column:
    return F.date_format(utc_to_local(ts, tz), SHORT_STAMP)


def hours_minutes(minutes: Column) -> Column:
    """``186`` -> ``3h6m``, ``180`` -> ``3h``; hours are floored for negative input."""
    hours = F.floor(minutes / 60).cast("bigint").cast("string")
    rest = F.pmod(minutes, F.lit(60))
    tail = F.when(rest == 0, F.lit("")).otherwise(F.concat(rest.cast("string"), F.lit("m")))
    return F.concat(hours, F.lit("h"), tail)


def age_text(minutes: Column) -> Column:
    """``45m ago``, and from one hour on ``3h 4m ago`` with the minutes padded to two places."""
    short = F.format_string("%dm ago", minutes)
    hours = F.floor(minutes / 60).cast("bigint")
    return F.when(
        minutes >= 60, F.format_string("%dh%2dm ago", hours, F.pmod(minutes, F.lit(60)))
    ).otherwise(short)
