"""Chunk trees, ranks of ids, runtime filters and lookups in large tables: results and plans."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from conftest import T0
from pyspark.sql import functions as F

from proofspark.functions.profile import Profile, interpolate_by_table, reference_profile, with_profile_values
from proofspark.operators import episodes
from proofspark.operators import series as series_module
from proofspark.operators.explore import cool_day_count, cool_days, daily_summary, elevated_histogram
from proofspark.operators.progress import session_progress
from proofspark.operators.series import carried, heavy_cells, tree_shifts, with_chunk
from proofspark.operators.sessions import resolve_session_bounds
from proofspark.sources.readings import load_readings, on_date, readings_since, with_temperature


@pytest.fixture(autouse=True)
def whole_filters(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seconds", [1, 3600, 864_000])
def test_levels_of_a_tree_are_narrow(seconds):
    shifts = tree_shifts(seconds, None)
    finest = (seconds * 1_000_000).bit_length() - 1
    assert shifts[-1] == series_module.TOP_BITS and shifts == sorted(shifts)
    assert all(b - a <= series_module.LEVEL_BITS for a, b in zip([finest, *shifts], shifts))


def test_carried_equals_a_running_sum(spark):
    rng = random.Random(4)
    cells = sorted({(s, rng.choice([rng.randrange(-(2**57), 2**57), rng.randrange(10**6)]), p) for s in (1, 2) for p in (0, 1) for _ in range(150)})
    rows = [(*c, rng.randrange(100), rng.choice([None, rng.randrange(100)])) for c in cells]
    df = spark.createDataFrame(rows, "sensor_id long, chunk long, part long, a long, b long")
    for shifts in ([12, 24, 35, 47, 59], [45, 59], [59]):
        for backwards in (False, True):
            got = {tuple(r)[:3]: (r.before_a, r.before_b) for r in carried(df, shifts, ["a"], ["b"], backwards).collect()}
            for sensor in (1, 2):
                total, most = 0, None
                for s, c, p, a, b in sorted((r for r in rows if r[0] == sensor), reverse=backwards):
                    assert got[s, c, p] == (total, most)
                    total += a
                    most = b if most is None else most if b is None else max(most, b)


def test_one_sensor_in_second_wide_chunks(spark, series):
    """Windows over edges are partitioned by blocks; results are those of one chunk."""
    rng = random.Random(9)
    minutes = sorted(rng.sample(range(60 * 24 * 400), 2500))
    readings = series({1: [(m, round(rng.uniform(70, 95), 1)) for m in minutes]}).cache()
    for operator in (
        lambda r, **k: episodes.temp_deltas(r, **k),
        lambda r, **k: episodes.hot_episodes(r, max_gap_minutes=400, **k),
        lambda r, **k: episodes.hot_suffix_summary(r, max_gap_minutes=400, **k),
    ):
        fine, wide = operator(readings, chunk_seconds=1, heavy=None), operator(readings, chunk_seconds=10**8)
        assert sorted(map(tuple, fine.collect()), key=str) == sorted(map(tuple, wide.collect()), key=str)
        for spec in re.findall(r"windowspecdefinition\(([^)]*)", _plan(fine)):
            keys = re.split(r" ASC| DESC", spec)[0].split(", ")[:-1]
            assert len(keys) >= 2, spec


@pytest.mark.parametrize("heavy", ["find", None])
def test_hot_suffix_reads_the_readings_once(spark, series, tmp_path, heavy):
    """One exchange by chunk, reused, so that readings are scanned and dealt once."""
    path = str(tmp_path / "readings")
    series({s: [(i, 80.0 + i % 9) for i in range(50)] for s in (1, 2)}).write.parquet(path)
    found = episodes.hot_suffix_summary(load_readings(spark, path), heavy=heavy)
    found.collect()
    plan = _plan(found).split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_clustered_ids_are_cut_evenly(spark):
    """Ids in a few dense clusters far apart, at one instant."""
    ids = [c + i for c in (0, 10**9, 2**61) for i in range(400)] + [2**62]
    rows = [(1, i, T0, 80.0) for i in ids] + [(1, i, T0 + datetime.timedelta(minutes=1), 81.0) for i in range(150)]
    df = spark.createDataFrame(rows, "sensor_id long, reading_id long, datetime timestamp_ntz, temperature_f double")
    cells = with_chunk(df, heavy=heavy_cells(df, 100)).groupBy("chunk", "part").count()
    assert cells.agg(F.max("count")).first()[0] <= 100 and cells.count() >= 24


def test_heavy_chunks_are_found_without_a_call(spark, series, monkeypatch):
    rng = random.Random(3)
    points = [(rng.uniform(0, 60), round(rng.uniform(70, 95), 1)) for _ in range(200)] + [(30.0, 90.0)] * 80
    readings = series({1: sorted(points)}).cache()
    plain = episodes.temp_deltas(readings)
    assert "bounds" not in plain._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(series_module, "HEAVY_ROWS", 20)
    cut = episodes.temp_deltas(readings)
    assert "bounds" in cut._jdf.queryExecution().logical().toString()
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_readings_of_other_sensors_are_not_exchanged(spark, series, sessions, tmp_path):
    path = str(tmp_path / "readings")
    series({s: [(m, 70.0 + m % 5) for m in range(0, 600, 10)] for s in range(1, 30)}).write.parquet(path)
    bounds = resolve_session_bounds(sessions([(1, 1, 100, "2h"), (2, 2, 50, "1h"), (3, 2, 300, "1h")]))
    progress = session_progress(load_readings(spark, path), bounds)
    found = {r.session_id: r.reading_count for r in progress.collect()}
    assert found == {1: 13, 2: 7, 3: 7}
    plan = _plan(progress)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(datetime,2026-01-22T11:50" in pushed and "LessThanOrEqual(datetime,2026-01-22T17:00" in pushed
    kept = progress.sparkSession  # the filter by sensor is a broadcast below the first exchange
    assert kept is not None and re.search(r"BroadcastHashJoin \[sensor_id#\d+L\], \[sensor_id#\d+L\], Inner", plan)


@pytest.mark.parametrize("count", [1, 20, 700])
def test_many_sessions_of_one_sensor_on_all_levels(spark, series, sessions, count):
    """Blocks on one, two and three levels give the sums of a plain join."""
    rng = random.Random(count)
    readings = series({1: [(m, round(rng.uniform(60, 90), 1)) for m in sorted(rng.sample(range(5000), 600))]})
    specs = [(i, 1, rng.randrange(4000), rng.choice([None, "30m", "9h", "40h"])) for i in range(count)]
    bounds = resolve_session_bounds(sessions(specs)).cache()
    got = {r.session_id: (r.reading_count, r.min_temp_f, r.max_temp_f) for r in session_progress(readings, bounds).collect()}
    joined = bounds.join(readings, "sensor_id").filter("datetime >= start_ts and (end_ts is null or datetime <= end_ts)")
    want = joined.groupBy("session_id").agg(F.count("*").alias("n"), F.min("temperature_f").alias("a"), F.max("temperature_f").alias("b"))
    for r in want.collect():
        assert got[r.session_id] == (r.n, r.a, r.b)


def test_bounds_pass_the_conversion_of_instants(spark, tmp_path):
    path = str(tmp_path / "zoned")
    spark.range(96).select(
        F.timestamp_seconds(F.lit(1768996800) + F.col("id") * 3600).alias("datetime"), F.col("id").cast("double").alias("temperature_f")
    ).write.parquet(path)
    readings = load_readings(spark, path)
    day = on_date(with_temperature(readings), datetime.date(2026, 1, 22))
    since = readings_since(readings, "2026-01-22 00:00:00", "2026-01-22 23:00:00")
    for found in (day, since):
        pushed = re.search(r"PushedFilters: \[(.*?)\]", _plan(found)).group(1)
        assert "GreaterThanOrEqual(datetime" in pushed and "LessThanOrEqual(datetime" in pushed
        assert sorted(r.datetime.hour for r in found.collect()) == list(range(24))


def test_lookup_in_a_large_table_with_a_hot_profile(spark):
    rng = random.Random(6)
    profiles = []
    for i in range(300):
        temps = sorted({round(rng.uniform(55, 95), 2) for _ in range(rng.choice([1, 2, 9]))})
        profiles.append(Profile(f"p{i}", tuple((t, rng.uniform(1, 20), rng.uniform(1, 100)) for t in temps)))
    names = ["p7"] * 2000 + [f"p{rng.randrange(310)}" for _ in range(3000)] + [None] * 5
    temps = [rng.choice([rng.uniform(50, 100), 70.0, None, float("nan")]) if rng.random() < 0.3 else rng.uniform(70, 71) for _ in names]
    rows = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(zip(temps, names))], "i int, temperature_f double, profile string")
    table = reference_profile(spark, profiles)
    small = interpolate_by_table(rows, table)
    large = interpolate_by_table(rows, table, broadcast_limit=0)
    key = lambda r: r.i
    for a, b in zip(sorted(small.collect(), key=key), sorted(large.collect(), key=key), strict=True):
        assert (a.i, str(a.expected_hours), str(a.target_rise_pct)) == (b.i, str(b.expected_hours), str(b.target_rise_pct))
    some = [p for p in profiles if p.name in ("p7", "p8", "p9")]
    want = with_profile_values(rows.filter("profile in ('p7', 'p8', 'p9')"), some, "temperature_f", "h", "r")
    got = {r.i: r for r in large.collect()}
    for r in want.collect():
        assert (got[r.i].expected_hours, got[r.i].target_rise_pct) == (pytest.approx(r.h, nan_ok=True), pytest.approx(r.r, nan_ok=True))


def test_sample_day_reads_days_as_ranges(spark, series, tmp_path):
    path = str(tmp_path / "readings")
    points = [(m, 84.0 if 1500 <= m <= 1560 else 70.0) for m in range(0, 9000, 2)]
    series({1: points, 2: [(m + 1, t) for m, t in points]}).write.parquet(path)
    readings = load_readings(spark, path)
    found = episodes.sample_days(readings, episodes.sustained_sessions(readings))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", _plan(found)).group(1)
    assert "GreaterThanOrEqual(datetime,2026-01-23T00:00" in pushed and "LessThan(datetime,2026-01-24T00:00" in pushed
    rows = found.collect()
    assert {(r.sensor_id, r.bucket.date()) for r in rows} == {(s, datetime.date(2026, 1, 23)) for s in (1, 2)}
    assert len(rows) == 288


def test_many_days_become_few_ranges():
    days = [datetime.date(2026, 1, 1) + datetime.timedelta(days=3 * i + (i // 10) * 20) for i in range(100)]
    text = str(episodes._on_days(days, 10))
    assert text.count(">=") == 10


def test_ordered_outputs(spark, series):
    rng = random.Random(8)
    readings = series({s: [(m, rng.uniform(60, 95)) for m in range(0, 6000, 7)] for s in (1, 2)})
    dates = [r.date for r in daily_summary(readings, ordered=True).collect()]
    degrees = [r.bucket for r in elevated_histogram(readings, ordered=True).collect()]
    rises = [r.delta_bucket for r in episodes.spike_histogram(episodes.temp_deltas(readings), ordered=True).collect()]
    starts = [r.start for r in episodes.sustained_sessions(readings, min_duration_minutes=0, ordered=True).collect()]
    for found in (dates, degrees, rises, starts):
        assert found == sorted(found) and len(found) > 1
    cool = series({1: [(m, 70.0 if m < 2000 else 90.0) for m in range(0, 6000, 60)]})
    (counts,) = cool_day_count(cool).collect()
    assert counts.cool_days == cool_days(cool).count() == 1 and counts.days == daily_summary(cool).count()
