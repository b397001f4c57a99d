from __future__ import annotations

import math
import random

import pytest
from conftest import SESSIONS, T0, at
from pyspark.sql import functions as F

from proofspark.functions.profile import DOUGH_KNOTS, DOUGH, Profile
from proofspark.operators.progress import PROGRESS_FIELDS, session_progress
from proofspark.operators.sessions import resolve_session_bounds


def _lookup(temp, field):
    temp = max(65.0, min(80.0, temp))
    for low, high in zip(DOUGH_KNOTS, DOUGH_KNOTS[1:]):
        if low[0] <= temp <= high[0]:
            share = (temp - low[0]) / (high[0] - low[0])
            return low[field] + share * (high[field] - low[field])


def _by_hand(points, start, end):
    """Progress of one session from its sorted points ``(minute, id, temp)``."""
    kept = [p for p in points if p[2] is not None and p[0] >= start and (end is None or p[0] <= end)]
    if not kept:
        return None
    secs = [0] + [int((b[0] - a[0]) * 60 + 1e-6) for a, b in zip(kept, kept[1:])]
    temps = [p[2] for p in kept]
    total = sum(secs)
    avg = temps[0] if total == 0 else sum(t * s for t, s in zip(temps, secs)) / total
    integral = sum(s / 3600 / _lookup(t, 1) for t, s in zip(temps, secs))
    target = _lookup(avg, 2)
    return {
        "elapsed_hours": total / 3600,
        "avg_temp_f": avg,
        "current_temp_f": temps[-1],
        "target_rise_pct": target,
        "est_rise_pct": min(integral * target, target),
        "reading_count": len(kept),
        "min_temp_f": min(temps),
        "max_temp_f": max(temps),
        "integral": integral,
        "last_reading_at": at(kept[-1][0]),
    }


def _run(readings, table, **kwargs):
    rows = session_progress(readings, resolve_session_bounds(table), **kwargs).collect()
    return {r.session_id: r for r in rows}


HAND_WORKED = {
    # span, average, integral, target, estimate, reference hours
    "A": ([(0, 70.0), (60, 72.0), (180, 75.0)], (3, 74, 1 / 10 + 2 / 7, 55, 21.214286, 8)),
    "B": ([(0, 71.3)], (0, 71.3, 0, 68.5, 0, 10.7)),
    "C": ([(0, 60.0), (600, 90.0), (1200, 90.0)], (20, 90, 3.636364, 30, 30, 5.5)),
    "D": ([(0, 70.0), (60, 72.0), (60, 74.0)], (1, 72, 0.1, 65, 6.5, 10)),
}


def test_hand_worked_sessions(series, sessions):
    names = list(HAND_WORKED)
    readings = series({i: HAND_WORKED[n][0] for i, n in enumerate(names)})
    found = _run(readings, sessions([(i, i, 0, None) for i in range(len(names))]))
    for i, n in enumerate(names):
        r = found[i]
        got = (
            r.elapsed_hours, r.avg_temp_f, r.integral, r.target_rise_pct, r.est_rise_pct,
            r.reference_hours,
        )
        assert got == pytest.approx(HAND_WORKED[n][1], abs=1e-6), n
    assert found[3].current_temp_f == 74.0


def test_whole_seconds_per_interval(series, sessions):
    readings = series({1: [(0.9 / 60, 70.0), (2.1 / 60, 70.0), (3.9 / 60, 70.0)]})
    assert _run(readings, sessions([(1, 1, 0, None)]))[1].elapsed_hours == 2 / 3600


def test_sessions_without_readings_and_bad_ends_stay(series, sessions):
    readings = series({1: [(0, 70.0), (10, None)]})
    found = _run(
        readings,
        sessions([(1, 1, 5, None), (2, 9, 0, "2h"), (3, 1, 0, "soon"), (4, 1, 0, "2026-01-20 9am")]),
    )
    assert [found[i].status for i in (1, 2, 3, 4)] == [
        "no_readings", "no_readings", "bad_end", "no_readings",
    ]
    for row in found.values():
        assert row.reading_count == 0
        assert all(row[f] is None for f in PROGRESS_FIELDS if f != "reading_count")


def test_nan_readings(series, sessions):
    nan = math.nan
    readings = series({1: [(0, nan), (60, 70.0)], 2: [(0, 70.0), (60, nan), (120, 72.0)]})
    found = _run(readings, sessions([(1, 1, 0, None), (2, 2, 0, None)]))
    # zero seconds of NaN are still NaN in the average; a later NaN is no minimum or maximum
    assert math.isnan(found[1].avg_temp_f) and math.isnan(found[1].min_temp_f)
    assert found[1].integral == pytest.approx(1 / 12)
    assert math.isnan(found[2].avg_temp_f)
    assert (found[2].min_temp_f, found[2].max_temp_f) == (70.0, 72.0)
    assert found[2].target_rise_pct == 30.0


def test_constant_temperature_completes_after_the_expected_hours(series, sessions):
    hours = _lookup(72.5, 1)
    points = [(m * hours * 60 / 19, 72.5) for m in range(20)]
    row = _run(series({1: points}), sessions([(1, 1, 0, None)]))[1]
    assert row.integral == pytest.approx(1, abs=1e-3)


def test_integral_adds_up_when_split_at_a_reading(series, sessions):
    rng = random.Random(5)
    readings = series({1: [(m * 7, rng.uniform(60, 90)) for m in range(60)]})
    found = _run(readings, sessions([(1, 1, 0, None), (2, 1, 0, "3h30m"), (3, 1, 210, None)]))
    assert found[1].integral == pytest.approx(found[2].integral + found[3].integral)


def test_profiles_are_picked_by_name(spark, series):
    fast = Profile("fast", ((60.0, 1.0, 80.0), (90.0, 1.0, 80.0)))
    table = spark.createDataFrame(
        [(1, 1, "fast", T0, None, "UTC", None), (2, 1, "dough", T0, None, "UTC", None),
         (3, 1, "none", T0, None, "UTC", None)],
        SESSIONS,
    )
    found = _run(series({1: [(0, 70.0), (60, 70.0)]}), table, profiles=(DOUGH, fast))
    assert found[1].integral == pytest.approx(1) and found[1].target_rise_pct == 80
    assert found[2].integral == pytest.approx(1 / 12)
    assert found[3].integral is None and found[3].est_rise_pct is None
    assert found[3].avg_temp_f == 70


@pytest.mark.parametrize("chunk_seconds", [60, 3600, 10**9])
def test_many_overlapping_sessions_equal_brute_force(spark, series, sessions, chunk_seconds):
    """One busy sensor with hundreds of open, nested and tied sessions, and some quiet ones."""
    rng = random.Random(chunk_seconds)
    points = {}
    for sensor, n in ((1, 400), (2, 30), (3, 1)):
        minutes = sorted(rng.randrange(0, 3000) for _ in range(n))
        points[sensor] = [
            (m, rng.choice([None, *[round(rng.uniform(60, 95), 2)] * 6])) for m in minutes
        ]
    rows = []
    for i in range(600):
        sensor = rng.choice([1, 1, 1, 1, 2, 3])
        start = rng.randrange(-50, 3000)
        end = rng.choice([None, 0, rng.randrange(0, 100), rng.randrange(0, 3000)])
        rows.append((i, sensor, start, None if end is None else f"{end}m"))
    # input order must not matter
    shuffled = series(points).orderBy(F.rand(3))
    found = _run(shuffled, sessions(rows), chunk_seconds=chunk_seconds)
    assert len(found) == len(rows)
    indexed = {s: [(m, i, t) for i, (m, t) in enumerate(p)] for s, p in points.items()}
    for i, sensor, start, spec in rows:
        end = None if spec is None else start + int(spec[:-1])
        want, got = _by_hand(indexed[sensor], start, end), found[i]
        if want is None:
            assert got.reading_count == 0
            continue
        for field, value in want.items():
            if isinstance(value, float):
                value = pytest.approx(value, rel=1e-9, abs=1e-9)
            assert got[field] == value, (i, field)
        assert got.min_temp_f - 1e-9 <= got.avg_temp_f <= got.max_temp_f + 1e-9
        assert got.est_rise_pct <= got.target_rise_pct
