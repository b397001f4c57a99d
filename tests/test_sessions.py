from __future__ import annotations

import datetime

import pytest

from proofspark.functions.durations import with_duration
from proofspark.operators.sessions import parse_durations, resolve_session_bounds

DURATIONS = {
    "11h": 39600,
    "1d12h": 129600,
    "10h28m": 37680,
    "1D2H30M": 95400,
    " 0h ": 0,
    "30M": 1800,
    "": None,
    "h": None,
    "2h1d": None,
    "1.5h": None,
    "90s": None,
    "12": None,
    "99999999999999h": None,
}

START = datetime.datetime(2026, 1, 22, 11, 9)
ENDS = {
    "8pm": "2026-01-22 20:00",
    "9am": "2026-01-23 09:00",
    "2026-01-22 8pm": "2026-01-22 20:00",
    "10h28m": "2026-01-22 21:37",
    "2026-01-20 9am": "2026-01-21 09:00",
    "17:30": "2026-01-22 17:30",
    "17:30:15": "2026-01-22 17:30:15",
    "2026-01-22T20:00": "2026-01-22 20:00",
    "2026-01-23": "2026-01-23 00:00",
    "12am": "2026-01-23 00:00",
    "12:30 pm": "2026-01-22 12:30",
    "999999999d": None,
    "2026-02-30": None,
    "25:00": None,
    "13pm": None,
    "12": None,
    "2026-01-22T": None,
    "later": None,
    "   ": None,
}


def test_durations(spark):
    rows = spark.createDataFrame([(t,) for t in DURATIONS], "text string")
    found = {r.text: r.duration_s for r in with_duration(rows, "text").collect()}
    assert found == DURATIONS


def test_durations_of_sessions(sessions):
    found = parse_durations(sessions([(1, 1, 0, "2h"), (2, 1, 0, None)])).collect()
    assert {r.session_id: r.duration_s for r in found} == {1: 7200, 2: None}


def _resolved(sessions, spec, tz="UTC", start=START):
    minutes = (start - datetime.datetime(2026, 1, 22, 11, 0)).total_seconds() / 60
    return resolve_session_bounds(sessions([(1, 1, minutes, spec)], tz)).first()


@pytest.mark.parametrize("spec", ENDS)
def test_ends(sessions, spec):
    row = _resolved(sessions, spec)
    want = ENDS[spec] and datetime.datetime.fromisoformat(ENDS[spec])
    assert (row.end_ts, row.status) == (want, "ok" if want else "bad_end")


@pytest.mark.parametrize("spec", [None, ""])
def test_open_sessions(sessions, spec):
    row = _resolved(sessions, spec)
    assert (row.end_ts, row.status) == (None, "ok")


def test_clock_times_are_local(sessions):
    # 11:09 UTC is 06:09 in New York, so 5am has passed there and 8pm is 01:00 UTC
    late = _resolved(sessions, "8pm", "America/New_York")
    rolled = _resolved(sessions, "5am", "America/New_York")
    assert late.end_ts == datetime.datetime(2026, 1, 23, 1, 0)
    assert rolled.end_ts == datetime.datetime(2026, 1, 23, 10, 0)


def test_durations_are_elapsed_time_across_a_clock_change(sessions):
    start = datetime.datetime(2026, 3, 8, 6, 0)  # 01:00 in New York, one hour before the change
    row = _resolved(sessions, "24h", "America/New_York", start)
    assert row.end_ts - start == datetime.timedelta(hours=24)
