from __future__ import annotations

import json
import random

import pytest
from conftest import T0

from proofspark.functions.rounding import fixed_text, round_places
from proofspark.operators.progress import session_progress
from proofspark.operators.sessions import resolve_session_bounds
from proofspark.plans import report
from proofspark.sources.sinks import write_json_lines, write_text
from pyspark.sql import functions as F


@pytest.mark.parametrize("places", [0, 1, 4])
def test_rounding_agrees_with_python(spark, places):
    rng = random.Random(places)
    values = [rng.uniform(-200, 200) for _ in range(500)]
    values += [round(rng.uniform(0, 200), places + 1) for _ in range(500)]  # decimal ties
    values += [n / 4 for n in range(-20, 20)] + [n + 0.5 for n in range(6)] + [0.00005, 0.05, -0.05, -0.5, 0.00015, 70.35, 70.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(
        "v", round_places(F.col("v"), places).alias("r"),
        fixed_text(F.col("v"), places).alias("t"),
    ).collect()
    for r in rows:
        assert r.r == float(f"{r.v:.{places}f}"), r.v
        assert r.t == f"{r.v:.{places}f}", r.v


@pytest.fixture(scope="module")
def offsets(series, sessions):
    readings = series({1: [(0, 67.0), (300, 67.25), (693, 67.5)], 2: [(5, 70.25)]})
    table = sessions([(1, 1, 0, None), (2, 2, 0, "2h"), (3, 3, 0, None)], "America/New_York", 1500.0)
    progress = session_progress(readings, resolve_session_bounds(table))
    return report.with_offsets(progress, "2026-01-23 01:47:00").cache()


def test_offsets(offsets):
    rows = {r.session_id: r for r in offsets.collect()}
    one, two, none = rows[1], rows[2], rows[3]
    assert (one.wall_minutes, one.data_minutes, one.span_minutes, one.age_minutes) == (
        887, 693, 693, 194,
    )
    ref = one.reference_hours * 60
    assert one.reference_minutes == round(ref)
    assert (one.data_offset_minutes, one.data_offset_direction) == (abs(round(ref - 693)), "under")
    assert (one.wall_offset_minutes, one.wall_offset_direction) == (abs(round(ref - 887)), "over")
    assert (one.reference_end - T0).total_seconds() == pytest.approx(ref * 60, abs=1e-5)
    # the session has ended, but its last reading ages on
    assert (two.wall_minutes, two.data_minutes, two.span_minutes, two.age_minutes) == (
        120, 5, 0, 882,
    )
    assert two.target_volume_ml == pytest.approx(1500 * (1 + 73.75 / 100))
    assert (none.wall_minutes, none.data_minutes, none.data_offset_direction) == (887, None, None)


def test_json(offsets, tmp_path):
    rows = {r.session_id: json.loads(r.json) for r in report.progress_json(offsets).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[3] == {
        "bulk_start": "2026-01-22 Thu 6:00 AM",
        "message": "no sensor readings found since 2026-01-22 Thu 6:00 AM America/New_York",
    }
    assert list(rows[1]) == [
        "bulk_start", "elapsed_minutes", "last_temp_f", "last_temp_age_minutes", "avg_temp_f",
        "estimated_rise_pct", "target_rise_pct", "meta",
    ]
    assert rows[2]["bulk_start"] == "2026-01-22 Thu 6:00 AM"
    assert rows[2]["avg_temp_f"] == 70.2 and rows[2]["target_rise_pct"] == 74
    assert rows[1]["meta"]["temperature_reading_count"] == 3
    assert rows[1]["meta"]["run_at"] == "2026-01-22 Thu 8:47 PM"
    assert rows[1]["meta"]["reference_offset_direction"] == "under"
    plain = report.progress_json(offsets, meta=False)
    assert all("meta" not in json.loads(r.json) for r in plain.collect())
    write_json_lines(plain, str(tmp_path / "out"))
    lines = [l for f in (tmp_path / "out").glob("part-*") for l in f.read_text().splitlines()]
    assert sorted(json.loads(l).get("last_temp_f", 0) for l in lines) == [0, 67.5, 70.25]


def test_text(offsets, spark, tmp_path):
    rows = {r.session_id: r.text for r in report.report_text(offsets).collect()}
    one = rows[1].split("\n")
    assert one[0] == "bulk start:        2026-01-22 Thu 6:00 AM America/New_York"
    assert one[1] == "elapsed:           14h47m"
    assert one[2] == "data elapsed:      11h33m"
    assert one[3] == "temp (3h14m ago):  67.5°F"
    assert one[5] == "temp range:        67.0–67.5°F (0.5°F)"
    assert one[8] == "target volume:     1500 rises to 2821 mL"  # 1500 * 1.88041 at 67.3918
    assert one[9] == "" and len(one) == 20
    assert "temp (14h42m ago):  70.2°F" in rows[2]
    assert rows[3] == "no sensor readings found since 2026-01-22 Thu 6:00 AM America/New_York"
    lines = report.report_rows(offsets).filter("session_id = 3").collect()
    assert [(r.section, r.ord, r.label, r.line) for r in lines] == [("message", 1, "message", rows[3])]
    assert rows[2].split("\n")[1] == "elapsed:            2h"
    primary = report.report_rows(offsets.withColumn("volume_ml", F.lit(None).cast("double")), False)
    assert primary.filter("session_id = 1").count() == 8
    write_text(report.report_text(offsets), str(tmp_path / "text"))
    texts = "".join(f.read_text() for f in (tmp_path / "text").glob("part-*"))
    assert texts.count("bulk start:") == 4


def test_padding_of_single_digit_minutes(spark):
    from proofspark.functions.times import age_text, hours_minutes

    df = spark.createDataFrame([(59,), (60,), (125,), (-5,)], "m bigint")
    rows = df.select(age_text(F.col("m")), hours_minutes(F.col("m"))).collect()
    assert [tuple(r) for r in rows] == [
        ("59m ago", "0h59m"), ("1h 0m ago", "1h"), ("2h 5m ago", "2h5m"),
        ("-5m ago", "-1h55m"),
    ]
