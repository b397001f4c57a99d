"""Readings stored with a time zone, tables without ids, ordered results, ends without a separator."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import T0
from proofspark.functions.durations import with_end
from proofspark.operators.explore import hourly_mode, monthly_mode
from proofspark.operators.sessions import resolve_session_bounds
from proofspark.operators.series import heavy_cells, with_chunk
from proofspark.sources.readings import as_readings, load_readings


@pytest.fixture
def new_york(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


def test_instants_across_clock_changes(new_york):
    utc = ["2025-11-02 05:30:00", "2025-11-02 06:30:00", "2025-03-09 06:59:59.5", "2025-03-09 07:00:00", "1969-12-31 23:59:59.25"]
    rows = new_york.createDataFrame([(u,) for u in utc], "u string")
    table = rows.select(F.to_timestamp(F.concat("u", F.lit(" UTC")), "yyyy-MM-dd HH:mm:ss[.SSS][.SS][.S] VV").alias("datetime"), F.lit(1.0).alias("temperature_f"))
    got = sorted(r.datetime for r in as_readings(table).collect())
    assert got == sorted(datetime.datetime.fromisoformat(u) for u in utc)


def test_bounds_of_zoned_files_reach_the_scan(new_york, tmp_path, capsys):
    path = str(tmp_path / "readings")
    hours = new_york.range(48).select(F.timestamp_seconds(F.lit(1762041600) + F.col("id") * 3600).alias("datetime"), F.lit(1.0).alias("temperature_f"))
    hours.write.parquet(path)
    start, end = datetime.datetime(2025, 11, 2, 5), datetime.datetime(2025, 11, 2, 7)
    got = load_readings(new_york, path, start, end)
    assert [r.datetime.hour for r in got.orderBy("datetime").collect()] == [5, 6, 7]
    got.explain("formatted")
    pushed = next(x for x in capsys.readouterr().out.splitlines() if "PushedFilters" in x)
    assert "GreaterThanOrEqual(datetime" in pushed and "LessThanOrEqual(datetime" in pushed


def test_heavy_instants_without_ids(spark):
    table = spark.range(2000).select(F.lit(T0).cast("timestamp_ntz").alias("datetime"), F.col("id").cast("double").alias("temperature_f"))
    readings = as_readings(table)
    heavy = heavy_cells(readings, limit=100)
    parts = with_chunk(readings, heavy=heavy).groupBy("chunk", "part").count()
    assert parts.agg(F.max("count")).first()[0] < 300 and parts.count() > 10


def test_ids_over_the_whole_range(spark):
    table = spark.range(300).select(
        F.lit(T0).cast("timestamp_ntz").alias("datetime"), F.lit(1.0).alias("temperature_f"), F.lit(1).alias("sensor_id"),
        F.when(F.col("id") == 0, -(2**63)).when(F.col("id") == 1, 2**63 - 1).otherwise(F.col("id")).alias("reading_id"),
    )
    readings = as_readings(table)
    assert with_chunk(readings, heavy=heavy_cells(readings, limit=100)).count() == 300


def test_modes_in_order(spark, series):
    readings = series({1: [(60 * i, 70.0 + i % 3) for i in range(24 * 70)]})
    hours = [r.hour for r in hourly_mode(readings, ordered=True).collect()]
    months = [(r.year, r.month) for r in monthly_mode(readings, ordered=True).collect()]
    assert hours == sorted(hours) and len(hours) == 24 and months == sorted(months) and len(months) > 2


@pytest.mark.parametrize("text", ["2026-01-228pm", "2026-01-2211:00"])
def test_date_and_time_need_a_separator(spark, text):
    rows = spark.createDataFrame([(text, T0, "UTC"), (text[:10] + " " + text[10:], T0, "UTC")], "e string, s timestamp_ntz, z string")
    ends = [r.end_ts for r in with_end(rows, "e", "s", "z").collect()]
    assert ends[0] is None and ends[1] is not None


def test_zones(spark):
    rows = [("5H", "Nowhere/City"), ("8pm", "Nowhere/City"), ("8pm", "America/New_York"), ("8pm", "UTC"), ("junk", "Asia/Tokyo"), (None, "Europe/Berlin")]
    table = spark.createDataFrame([(i, e, T0, z) for i, (e, z) in enumerate(rows)], "session_id long, end_spec string, start_ts timestamp_ntz, tz string")
    got = resolve_session_bounds(table).orderBy("session_id").collect()
    assert [r.status for r in got] == ["bad_tz", "bad_tz", "ok", "ok", "bad_end", "ok"]
    assert (got[2].end_ts, got[3].end_ts) == (datetime.datetime(2026, 1, 23, 1), datetime.datetime(2026, 1, 22, 20))
