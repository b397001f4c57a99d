"""What the plans must not contain, and what must reach the scan."""

from __future__ import annotations

import datetime
import os
import re

import pytest

from proofspark.operators.sessions import readings_of_sessions, resolve_session_bounds
from proofspark.plans.catalog import QUERIES, fixture_readings
from proofspark.sources.readings import load_readings, on_date, readings_since, with_temperature

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    path = str(tmp_path_factory.mktemp("readings") / "r")
    fixture_readings(spark, FOLDER).selectExpr("*", "'x' as note").write.parquet(path)
    return path


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_pair_joins_no_python_no_whole_table_windows(spark, name):
    plan = _plan(QUERIES[name](spark, FOLDER))
    for word in ("BroadcastNestedLoopJoin", "CartesianProduct", "Python", "Pandas"):
        assert word not in plan
    # windowspecdefinition(sensor_id, chunk, datetime ASC ...) begins with its partition keys
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert " ASC" not in spec.split(",")[0] and "specifiedwindowframe" not in spec.split(",")[0]


def test_row_windows_are_partitioned_by_chunk(spark):
    """Windows over readings never have a whole sensor as their partition."""
    for name in ("temp_deltas", "session_progress", "sustained_sessions", "hot_suffix_summary"):
        plan = _plan(QUERIES[name](spark, FOLDER))
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan):
            if "datetime" in spec and "row_number" not in plan:
                assert "chunk" in spec


def test_no_window_frame_shrinks(spark):
    """Frames that end at the partition's end take quadratic time unless they cover all of it."""
    for name in ("hot_suffix_summary", "session_progress", "sustained_sessions"):
        plan = _plan(QUERIES[name](spark, FOLDER))
        for start in re.findall(r"specifiedwindowframe\(RowFrame, ([^,]*), unboundedfollowing", plan):
            assert start.strip() == "unboundedpreceding$()"


def test_rows_are_shuffled_once(spark):
    deltas = QUERIES["temp_deltas"](spark, FOLDER)
    deltas.collect()  # adaptive execution finds equal exchanges while it runs
    assert "ReusedExchange" in _plan(deltas)


def test_only_needed_columns_are_read(spark, stored):
    plan = _plan(load_readings(spark, stored))
    assert "note" not in re.search(r"ReadSchema: (\S+)", plan).group(1)


def test_bounds_reach_the_scan(spark, stored):
    plan = _plan(readings_since(load_readings(spark, stored), "2024-01-05", "2024-01-06"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(datetime" in pushed and "LessThanOrEqual(datetime" in pushed
    assert "IsNotNull(temperature_f)" in pushed
    day = _plan(on_date(load_readings(spark, stored), datetime.date(2024, 1, 5)))
    assert "LessThan(datetime" in day


def test_session_bounds_reach_the_scan(spark, stored, sessions):
    bounds = resolve_session_bounds(sessions([(1, 1, 0, "2h"), (2, 1, 30, "9pm"), (3, 1, 0, "x")]))
    plan = _plan(readings_of_sessions(load_readings(spark, stored), bounds))
    assert "GreaterThanOrEqual(datetime,2026-01-22T11:00" in plan
    assert "LessThanOrEqual(datetime,2026-01-22T21:00" in plan
    still_open = resolve_session_bounds(sessions([(1, 1, 0, "2h"), (2, 1, 0, None)]))
    assert "LessThan" not in _plan(readings_of_sessions(load_readings(spark, stored), still_open))
    none = resolve_session_bounds(sessions([(1, 1, 0, "x")]))
    assert readings_of_sessions(load_readings(spark, stored), none).count() == 0


def test_readings_without_ids_and_with_zoned_times(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.sql(
        "select timestamp'2024-01-05 10:00:00+02:00' as datetime, 70.5f as temperature_f, 1 as x"
    ).write.parquet(path)
    readings = load_readings(spark, path)
    row = readings.first()
    assert row.datetime == datetime.datetime(2024, 1, 5, 8, 0)
    assert (row.sensor_id, row.temperature_f) == (0, 70.5)
    assert with_temperature(readings).count() == 1


def test_sums_are_partial_before_the_shuffle(spark):
    for name in ("temp_frequency", "daily_summary", "session_progress"):
        assert "partial_" in _plan(QUERIES[name](spark, FOLDER))
