from __future__ import annotations

import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from proofspark.session import local_session  # noqa: E402

T0 = datetime.datetime(2026, 1, 22, 11, 0)
READINGS = "sensor_id bigint, reading_id bigint, datetime timestamp_ntz, temperature_f double"
SESSIONS = (
    "session_id bigint, sensor_id bigint, profile string, start_ts timestamp_ntz, "
    "end_spec string, tz string, volume_ml double"
)


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(minutes: float) -> datetime.datetime:
    return T0 + datetime.timedelta(minutes=minutes)


@pytest.fixture(scope="session")
def series(spark):
    """Readings from ``{sensor: [(minute, temperature), ...]}``."""

    def make(by_sensor: dict[int, list[tuple[float, float | None]]]):
        rows = [
            (sensor, i, at(minute), temp)
            for sensor, points in by_sensor.items()
            for i, (minute, temp) in enumerate(points)
        ]
        return spark.createDataFrame(rows, READINGS)

    return make


@pytest.fixture(scope="session")
def sessions(spark):
    """Sessions from ``[(id, sensor, start minute, end spec), ...]``."""

    def make(rows, tz: str = "UTC", volume: float | None = None):
        return spark.createDataFrame(
            [(i, sensor, "dough", at(start), end, tz, volume) for i, sensor, start, end in rows],
            SESSIONS,
        )

    return make
