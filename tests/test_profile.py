from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from proofspark.functions.profile import (
    DOUGH,
    DOUGH_KNOTS,
    Profile,
    interpolate_by_table,
    reference_profile,
    with_profile_values,
)

VECTOR = {
    60.0: (16, 100),
    65.0: (16, 100),
    65.5: (16, 97.5),
    67.4: (14.6, 88),
    70.25: (11.75, 73.75),
    75.5: (7, 50),
    76.5: (6.5, 45),
    78.5: (5.75, 35),
    80.0: (5.5, 30),
    95.0: (5.5, 30),
    math.nan: (5.5, 30),
}


def _temps(spark, temps):
    rows = [(i, t, "dough") for i, t in enumerate(temps)]
    return spark.createDataFrame(rows, "i int, temperature_f double, profile string")


def _pairs(df):
    return [(r.expected_hours, r.target_rise_pct) for r in df.orderBy("i").collect()]


def test_interpolation_vector(spark):
    rows = _temps(spark, VECTOR)
    found = _pairs(
        rows.select(
            "i",
            DOUGH.expected_hours("temperature_f").alias("expected_hours"),
            DOUGH.target_rise_pct("temperature_f").alias("target_rise_pct"),
        )
    )
    for got, want in zip(found, VECTOR.values()):
        assert got == pytest.approx(want, abs=1e-9)


def test_knots_are_exact_and_null_stays_null(spark):
    rows = _temps(spark, [k[0] for k in DOUGH_KNOTS] + [None])
    found = _pairs(
        with_profile_values(
            rows, (DOUGH,), "temperature_f", "expected_hours", "target_rise_pct"
        )
    )
    assert found == [(h, r) for _, h, r in DOUGH_KNOTS] + [(None, None)]


@pytest.mark.parametrize("limit", [10_000, 0])
def test_table_lookup_equals_expressions(spark, limit):
    """Both with the knots broadcast and, beyond the limit, by a shuffle join."""
    rows = _temps(spark, [*VECTOR, None, 79.999999, 72.0])
    by_table = interpolate_by_table(rows, reference_profile(spark), broadcast_limit=limit)
    want = with_profile_values(
        rows, (DOUGH,), "temperature_f", "expected_hours", "target_rise_pct"
    )
    assert _pairs(by_table) == _pairs(want)


def test_uneven_profile_and_unknown_name(spark):
    starter = Profile("uneven", ((60.0, 10.0, 50.0), (61.5, 8.0, 40.0), (70.0, 3.0, 10.0)))
    rows = spark.createDataFrame(
        [(0, 59.0, "uneven"), (1, 60.75, "uneven"), (2, 65.75, "uneven"), (3, 99.0, "uneven"),
         (4, 70.0, "dough"), (5, 70.0, "other"), (6, None, "uneven")],
        "i int, temperature_f double, profile string",
    )
    found = _pairs(
        with_profile_values(
            rows, (DOUGH, starter), "temperature_f", "expected_hours", "target_rise_pct"
        )
    )
    assert found == [(10, 50), (9, 45), (5.5, 25), (3, 10), (12, 75), (None, None), (None, None)]
    table = reference_profile(spark, (DOUGH, starter, Profile("flat", ((70.0, 2.0, 9.0),))))
    assert _pairs(interpolate_by_table(rows, table)) == found
    flat = rows.withColumn("profile", F.lit("flat")).filter("i < 4")
    assert _pairs(interpolate_by_table(flat, table)) == [(2, 9)] * 4


def test_profiles_need_rising_knots():
    with pytest.raises(ValueError):
        Profile("bad", ((70.0, 1.0, 1.0), (60.0, 1.0, 1.0)))


def test_reference_profile_rows(spark):
    table = reference_profile(spark)
    assert table.count() == 16
    assert table.agg(F.sum("hours")).first()[0] == sum(k[1] for k in DOUGH_KNOTS)
