"""One sensor, and one instant of it, with most of the readings: same results, small chunks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proofspark.operators import episodes
from proofspark.operators.progress import session_progress
from proofspark.operators.series import heavy_cells, with_chunk
from proofspark.operators.sessions import resolve_session_bounds

LIMIT = 20


@pytest.fixture(scope="module")
def readings(series):
    rng = random.Random(11)
    minutes = sorted(
        [rng.uniform(0, 600) for _ in range(150)]  # a few an hour
        + [rng.uniform(120, 121) for _ in range(100)]  # many in a minute
        + [240 + rng.randrange(1000) / 60e6 for _ in range(60)]  # many in a millisecond
        + [300.0] * 150  # many at one instant
    )
    return series({1: [(m, round(rng.uniform(78, 92), 2)) for m in minutes], 2: [(0, 83.0)]}).cache()


@pytest.fixture(scope="module")
def heavy(readings):
    return heavy_cells(readings, LIMIT)


def test_heavy_chunks_are_cut_down(readings, heavy):
    assert heavy.hours is not None and heavy.seconds is not None and heavy.instants is not None
    cells = with_chunk(readings, heavy=heavy).groupBy("sensor_id", "chunk", "part").count()
    assert cells.agg(F.max("count")).first()[0] <= LIMIT
    assert cells.agg(F.sum("count")).first()[0] == readings.count()


def test_nothing_is_heavy_below_the_limit(readings):
    assert heavy_cells(readings, 10_000) is None


@pytest.mark.parametrize(
    "operator",
    [
        lambda r, **k: episodes.temp_deltas(r, **k),
        lambda r, **k: episodes.hot_transitions(r, **k),
        lambda r, **k: episodes.hot_episodes(r, **k),
        lambda r, **k: episodes.hot_suffix_summary(r, limit=None, **k),
        lambda r, **k: episodes.sustained_sessions(r, min_duration_minutes=0, **k),
    ],
    ids=["temp_deltas", "hot_transitions", "hot_episodes", "hot_suffix_summary", "sustained"],
)
def test_series_operators_agree(readings, heavy, operator):
    plain = operator(readings).toPandas()
    split = operator(readings, heavy=heavy).toPandas()
    order = list(plain.columns)
    a, b = (df.sort_values(order).reset_index(drop=True) for df in (plain, split))
    assert a.equals(b) and len(a)


def test_progress_agrees(readings, heavy, sessions):
    rng = random.Random(12)
    specs = [(i, 1, rng.choice([300, rng.randrange(600)]), rng.choice([None, "0m", "3h", "60m"]))
             for i in range(80)]
    bounds = resolve_session_bounds(sessions(specs))
    plain = {r.session_id: r for r in session_progress(readings, bounds).collect()}
    split = {r.session_id: r for r in session_progress(readings, bounds, heavy=heavy).collect()}
    for i, row in plain.items():
        for name, value in row.asDict().items():
            if isinstance(value, float):
                value = pytest.approx(value, rel=1e-9)
            assert split[i][name] == value
