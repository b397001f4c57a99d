"""Durations and end-of-session texts.

Written as steps over named columns: what a later step needs more than once stays a column, so
that a text is matched once per row and the generated code stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: days, hours and minutes in this order, each optional.
DURATION_PATTERN = "^(?:([0-9]+)D)?(?:([0-9]+)H)?(?:([0-9]+)M)?$"

# Fixed value: an optional date, then an optional clock time with an optional AM/PM mark.
END_PATTERN = (
    "^(?:([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[ T]+(?=[0-9])|$))?"
    "(?:([0-9]{1,2})(?::([0-9]{2})(?::([0-9]{2}))?)? *(AM|PM)?)?$"
)

# Longer durations lead beyond the last timestamp.
LONGEST_SECONDS = 9999 * 366 * 86400


def _groups(text: str, pattern: str, count: int) -> str:
    """All groups of a match as an array of texts, empty where absent; null without a match."""
    tidy = f"upper(trim({text}))"
    marks = "/".join(f"${i + 1}" for i in range(count))
    split = f"split(regexp_replace({tidy}, '{pattern}', '{marks}'), '/')"
    return f"case when {tidy} rlike '{pattern}' then {split} end"


def _number(group: str) -> str:
    """A group as int; null where it is absent or too long for an int.

    Absent groups are made null first, as a failing cast costs far more than one of null.
    """
    return f"try_cast(nullif({group}, '') as int)"


def with_duration(rows: DataFrame, text: str, name: str = "duration_s") -> DataFrame:
    """Adds the seconds in a text such as ``1D2H30M`` (any case); null where it is no such text."""
    # a number too long for an int makes the sum null, so the text counts as unreadable
    parts = [
        f"if(_d[{i}] = '', 0L, cast({_number(f'_d[{i}]')} as bigint) * {size})"
        for i, size in enumerate((86400, 3600, 60))
    ]
    total = f"case when array_join(_d, '') <> '' then {' + '.join(parts)} end"
    return (
        rows.withColumn("_d", F.expr(_groups(text, DURATION_PATTERN, 3)))
        .withColumn(name, F.expr(total))
        .drop("_d")
    )


def with_end(rows: DataFrame, text: str, start: str, tz: str, name: str = "end_ts") -> DataFrame:
    """Adds the UTC end of a session: a duration after ``start``, or a local time, date, or both.

    A clock time is on the start's local date. An end before the start moves on by exactly one
    local day, also when a full date was given. Null where the text cannot be read.
    """
    # a bare number is neither a clock time nor a date
    readable = "(_c[4] <> '' or _c[6] <> '' or (_c[3] = '' and _c[0] <> ''))"
    hour = (
        "case when _h is null then if(_c[3] = '', 0, null) when _c[6] = '' then _h"
        " when _h between 1 and 12 then _h % 12 + if(_c[6] = 'PM', 12, 0) end"
    )
    stamp = f"""try_make_timestamp_ntz(
        coalesce({_number("_c[0]")}, year(_local_start)),
        coalesce({_number("_c[1]")}, month(_local_start)),
        coalesce({_number("_c[2]")}, day(_local_start)),
        {hour},
        coalesce({_number("_c[4]")}, 0),
        cast(coalesce({_number("_c[5]")}, 0) as decimal(16, 6)))"""
    by_duration = f"{start} + make_dt_interval(0, 0, 0, cast(_secs as decimal(18, 6)))"
    return (
        with_duration(rows, text, "_secs")
        .withColumns(
            {
                "_c": F.expr(_groups(text, END_PATTERN, 7)),
                "_local_start": F.expr(f"convert_timezone('UTC', {tz}, {start})"),
            }
        )
        .withColumn("_h", F.expr(_number("_c[3]")))
        .withColumn("_local_end", F.expr(f"case when {readable} then {stamp} end"))
        .withColumn("_end", F.expr(f"convert_timezone({tz}, 'UTC', _local_end)"))
        .withColumn(
            name,
            F.expr(
                f"""case
                    when _secs <= {LONGEST_SECONDS} then {by_duration}
                    when _secs is not null then null
                    when _end < {start}
                        then convert_timezone({tz}, 'UTC', _local_end + interval '1' day)
                    else _end end"""
            ),
        )
        .drop("_secs", "_c", "_local_start", "_h", "_local_end", "_end")
    )
