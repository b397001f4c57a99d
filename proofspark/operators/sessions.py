"""The sessions table: what was started when, on which sensor, and until when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofspark.functions.durations import with_duration, with_end
from proofspark.sources.readings import readings_since

SESSION_COLUMNS = (
    "session_id",
    "sensor_id",
    "profile",
    "start_ts",
    "end_spec",
    "tz",
    "volume_ml",
)


def parse_durations(sessions: DataFrame) -> DataFrame:
    """``end_spec`` read as a duration, in seconds; null where it is none."""
    return with_duration(sessions.select("session_id", "end_spec"), "end_spec")


def resolve_session_bounds(sessions: DataFrame) -> DataFrame:
    """Adds ``end_ts`` (UTC) and ``status``: ``ok``, ``bad_end`` for an unreadable end, or ``bad_tz``.

    No or an empty ``end_spec`` is an open session, whose ``end_ts`` is null. A zone that isn't known
    makes the status ``bad_tz`` and no end; its ``tz`` becomes ``UTC``, so that later stamps can be made.
    """
    # the most common zone needs no test
    known = "tz = 'UTC' or try_to_timestamp(concat('2000-01-01 00 ', tz), 'yyyy-MM-dd HH VV') is not null"
    checked = sessions.withColumn("_bad", F.expr(f"tz is not null and not ({known})"))
    # an empty text matches neither a duration nor a time, so its end is null as well
    ended = with_end(
        checked.withColumn("tz", F.expr("if(_bad, 'UTC', tz)")), "end_spec", "start_ts", "tz"
    )
    return ended.withColumns(
        {
            "end_ts": F.expr("if(_bad, null, end_ts)"),
            "status": F.expr(
                "case when _bad then 'bad_tz'"
                " when end_spec <> '' and end_ts is null then 'bad_end' else 'ok' end"
            ),
        }
    ).drop("_bad")


def readings_of_sessions(readings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Readings from the first start to the last end of resolved sessions.

    The bounds are worked out at once, as one row, so that they reach the scan as literals and
    files outside of them are skipped. Progress is the same with or without this.
    """
    first, last, any_open = (
        sessions.filter("status = 'ok'")
        .agg(F.min("start_ts"), F.max("end_ts"), F.expr("bool_or(end_ts is null)"))
        .first()
    )
    if first is None:
        return readings.limit(0)
    return readings_since(readings, first, None if any_open else last, ordered=False)
