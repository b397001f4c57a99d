from __future__ import annotations

import datetime
import random
import statistics

import pytest
from conftest import at
from pyspark.sql import functions as F

from proofspark.operators import episodes
from proofspark.operators.series import link_series

EPISODES = [
    (0, 80.0), (3, 86.0), (6, 88.0), (9, 84.0), (12, 86.0), (30, 87.0), (33, 70.0), (36, 86.0),
    (45, 89.0),
]
CHUNKS = [60, 10**9]


def _minutes(moment):
    return (moment - at(0)).total_seconds() / 60


def _random_series(seed, n=300):
    """Three sensors, the first with ties and long runs, so that islands span many chunks."""
    rng = random.Random(seed)
    out = {}
    for sensor, size in ((1, n), (2, 20), (3, 1)):
        temp, points, minute = 84.0, [], 0
        for _ in range(size):
            temp = min(95.0, max(70.0, temp + rng.uniform(-4, 4)))
            points.append((minute, round(temp, 2) if rng.random() > 0.05 else None))
            minute += rng.choice([0, 1, 1, 2, 3, 12])
        out[sensor] = points
    return out


def _present(points):
    return [(m, t) for m, t in points if t is not None]


@pytest.mark.parametrize("chunk_seconds", CHUNKS)
def test_links_and_deltas(series, chunk_seconds):
    points = _random_series(1)
    rows = episodes.temp_deltas(series(points), chunk_seconds).collect()
    found = {(r.sensor_id, r.reading_id): r for r in rows}
    assert len(rows) == sum(len(_present(p)) for p in points.values())
    for sensor, all_points in points.items():
        numbered = [(i, m, t) for i, (m, t) in enumerate(all_points) if t is not None]
        assert found[sensor, numbered[0][0]].temp_delta is None
        for (_, m0, t0), (i, m1, t1) in zip(numbered, numbered[1:]):
            row = found[sensor, i]
            assert row.temp_delta == t1 - t0
            assert row.time_delta == datetime.timedelta(minutes=m1 - m0)


def test_transitions_of_the_hand_worked_series(series):
    row = episodes.hot_transitions(series({1: EPISODES})).first()
    assert (row.episodes_starting, row.episodes_ending) == (3, 2)


def test_a_series_that_opens_hot_ends_without_a_start(series):
    row = episodes.hot_transitions(series({1: [(0, 90.0), (1, 70.0)]})).first()
    assert (row.episodes_starting, row.episodes_ending) == (0, 1)


def _listed(df):
    return [
        (_minutes(r.start), r.peak_temp, r.duration_min, r.readings)
        for r in df.orderBy("sensor_id", "start").collect()
    ]


@pytest.mark.parametrize("chunk_seconds", CHUNKS)
def test_hand_worked_hot_episodes(series, chunk_seconds):
    readings = series({1: EPISODES})
    assert _listed(episodes.hot_episodes(readings, chunk_seconds=chunk_seconds)) == [
        (3, 88, 3, 2), (12, 86, 0, 1), (36, 89, 9, 2),
    ]
    assert _listed(episodes.hot_suffix_summary(readings, chunk_seconds=chunk_seconds)) == [
        (3, 89, 42, 5), (12, 89, 33, 3), (36, 89, 9, 2),
    ]
    first = episodes.hot_suffix_summary(readings, limit=1, chunk_seconds=chunk_seconds)
    assert _listed(first) == [(3, 89, 42, 5)]


@pytest.mark.parametrize("chunk_seconds", CHUNKS)
def test_hand_worked_sustained_sessions(series, chunk_seconds):
    readings = series({1: EPISODES})
    assert episodes.sustained_sessions(readings, chunk_seconds=chunk_seconds).count() == 0
    row = episodes.sustained_sessions(
        readings, min_duration_minutes=9, chunk_seconds=chunk_seconds
    ).collect()
    assert [
        (_minutes(r.start), r.duration_min, r.readings, r.peak_temp, r.median_temp, r["class"])
        for r in row
    ] == [(3, 9, 4, 88.0, 86.0, "proofing")]


def _runs(points, threshold, gap):
    """Runs of rows at or above the threshold without a gap before any but the first."""
    runs, before = [], None
    for m, t in points:
        if t >= threshold:
            if before is None or before[1] < threshold or m - before[0] > gap:
                runs.append([])
            runs[-1].append((m, t))
        before = (m, t)
    return runs


@pytest.mark.parametrize("chunk_seconds", CHUNKS)
@pytest.mark.parametrize("gap", [2, 10])
def test_sustained_sessions_equal_brute_force(series, chunk_seconds, gap):
    points = _random_series(gap)
    rows = episodes.sustained_sessions(
        series(points), max_gap_minutes=gap, min_duration_minutes=4, chunk_seconds=chunk_seconds
    ).collect()
    found = sorted(
        (r.sensor_id, _minutes(r.start), _minutes(r.end), r.duration_min, r.readings,
         r.peak_temp, round(r.median_temp, 6), r["class"])
        for r in rows
    )
    want = []
    for sensor, p in points.items():
        for run in _runs(_present(p), 82, gap):
            temps = [t for _, t in run]
            length = run[-1][0] - run[0][0]
            if length >= 4:
                want.append(
                    (sensor, run[0][0], run[-1][0], length, len(run), max(temps),
                     round(statistics.median(temps), 6),
                     "proofing" if max(temps) < 90 else "oven")
                )
    assert found == sorted(want) and want


@pytest.mark.parametrize("chunk_seconds", CHUNKS)
def test_hot_suffixes_equal_a_literal_loop(series, chunk_seconds):
    # distinct times, as a literal loop over equal times would reach back before the start
    rng = random.Random(9)
    points = {1: [(m, round(rng.uniform(80, 92), 2)) for m in sorted(rng.sample(range(2000), 200))]}
    found = _listed(
        episodes.hot_suffix_summary(series(points), limit=None, chunk_seconds=chunk_seconds)
    )
    want, p = [], points[1]
    for before, start in zip(p, p[1:]):
        if before[1] < 85 <= start[1]:
            hot = [x for x in p if x[0] >= start[0] and x[1] >= 85]
            kept = [hot[0]] + [b for a, b in zip(hot, hot[1:]) if b[0] - a[0] <= 10]
            want.append(
                (start[0], max(t for _, t in kept), kept[-1][0] - kept[0][0], len(kept))
            )
    assert found == want and len(want) > 20


def test_sustained_sessions_without_a_gap_limit_are_plain_runs(series):
    points = _random_series(4)
    rows = episodes.sustained_sessions(
        series(points), max_gap_minutes=10**6, min_duration_minutes=0
    )
    runs = sum(len(_runs(_present(p), 82, 10**6)) for p in points.values())
    assert rows.count() == runs


def test_spikes_and_histogram(series):
    deltas = episodes.temp_deltas(series({1: [(0, 70.0), (1, 75.0), (2, 77.5), (3, 79.0), (4, 90.0)]}))
    assert [r.temp_delta for r in episodes.spikes(deltas).orderBy("datetime").collect()] == [5, 11]
    assert [r.temperature_f for r in episodes.hot_readings(deltas).collect()] == [90]
    assert [r.datetime for r in episodes.earliest(deltas, 2).collect()] == [at(0), at(1)]
    found = {r.delta_bucket: r["count"] for r in episodes.spike_histogram(deltas).collect()}
    assert found == {5: 1, 2: 1, 11: 1}  # 2.5 goes to the even 2


def test_sample_day(series):
    points = {1: [(m, 85.0 + m / 100) for m in range(0, 30, 5)], 2: [(0, 70.0), (5, 71.0)]}
    readings = series(points)
    sessions = episodes.sustained_sessions(readings)
    rows = episodes.sample_days(readings, sessions).orderBy("bucket").collect()
    assert [(r.sensor_id, _minutes(r.bucket), round(r.temp_f, 3)) for r in rows] == [
        (1, 0, 85.025), (1, 10, 85.125), (1, 20, 85.225),
    ]


def test_links_stay_within_a_sensor(series):
    linked = link_series(series({1: [(0, 1.0)], 2: [(1, 2.0)]}))
    assert linked.filter(F.col("prev_datetime").isNotNull()).count() == 0
