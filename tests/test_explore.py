from __future__ import annotations

import datetime

from conftest import at

from proofspark.operators import explore

DAY = 24 * 60


def _rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_counts_frequency_and_mode(series):
    readings = series({1: [(0, 70.4), (1, 70.5), (2, 71.5), (3, 72.2), (4, None), (5, 90.0)]})
    row = explore.reading_counts(readings).first()
    assert tuple(row) == (6, 1, 5, 1)
    # halves go to the even degree: 70.5 to 70, 71.5 to 72
    top = _rows(explore.top_temps(readings), "temp_rounded", "count")
    assert top == [(70, 2), (72, 2), (90, 1)]
    assert _rows(explore.top_temps(readings, 1), "temp_rounded") == [(70,)]
    mode = explore.temp_mode(readings).first()
    assert tuple(mode) == (70, 2, 40.0)


def test_mode_of_nothing(series):
    assert explore.temp_mode(series({1: [(0, None)]})).count() == 0


def test_modes_by_hour_and_month(series):
    readings = series({1: [(0, 71.0), (1, 70.0), (60, 75.0), (61, 75.0), (62, 70.0), (11 * DAY, 80.0)]})
    assert sorted(_rows(explore.hourly_mode(readings), "hour", "most_common_temp", "count")) == [
        (11, 70, 1), (12, 75, 2),
    ]
    assert sorted(_rows(explore.monthly_mode(readings), "year", "month", "most_common_temp")) == [
        (2026, 1, 70), (2026, 2, 80),
    ]


def test_zones_add_up_and_empty_ones_show(series):
    readings = series({1: [(0, 81.9), (1, 82.0), (2, 89.9), (3, None)]})
    found = {r.zone: (r["count"], r.pct) for r in explore.zone_breakdown(readings).collect()}
    assert found["elevated"][0] == 2 and found["oven"] == (0, 0.0)
    assert sum(n for n, _ in found.values()) == 3
    empty = explore.zone_breakdown(series({1: [(0, None)]})).collect()
    assert [(r["count"], r.pct) for r in empty] == [(0, None)] * 3


def test_elevated_histogram(series):
    readings = series({1: [(0, 82.0), (1, 82.5), (2, 83.5), (3, 89.9), (4, 90.0)]})
    found = sorted(_rows(explore.elevated_histogram(readings), "bucket", "count"))
    assert found == [(82, 2), (84, 1), (90, 1)]


def test_days(series):
    points = [(0, 86.0), (1, 90.0), (DAY, 85.0), (2 * DAY, 80.0), (2 * DAY + 1, 70.0)]
    readings = series({1: points})
    first = at(0).date()
    day = datetime.timedelta(days=1)
    assert _rows(explore.hot_days(readings), "date", "hot_readings", "peak_temp") == [
        (first, 2, 90.0), (first + day, 1, 85.0),
    ]
    assert _rows(explore.hot_days(readings, limit=1), "date") == [(first,)]
    assert _rows(explore.cool_days(readings), "date", "total_readings", "median_temp") == [
        (first + 2 * day, 2, 75.0)
    ]
    assert explore.daily_summary(readings, by=()).count() == 3
