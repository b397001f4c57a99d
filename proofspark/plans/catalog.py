"""The registered queries: every operator over the ``events`` table seen as readings.

An event is a reading of the sensor ``user_id``; ``error`` events are faults without a
temperature; every ``signup`` event starts a session. Doubles are rounded to six places, since
sums of doubles depend on their order.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofspark.functions.profile import DOUGH, interpolate_by_table, reference_profile
from proofspark.functions.times import utc_to_local
from proofspark.operators import episodes, explore
from proofspark.operators.progress import session_progress
from proofspark.operators.quantiles import describe
from proofspark.operators.series import heavy_cells
from proofspark.operators.sessions import parse_durations, resolve_session_bounds
from proofspark.plans import report
from proofspark.session import pin_utc
from proofspark.sources.readings import as_readings, on_date, readings_since, with_temperature

AS_OF = "2024-02-01 00:00:00"
SINCE, UNTIL = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
SAMPLE_DATE = "2024-01-10"
# sensors report a few times a day, so runs are allowed gaps of a day
GAP_MINUTES = 1440

Query = Callable[[SparkSession, str], DataFrame]


def fixture_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = pin_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    return as_readings(
        events.selectExpr(
            "user_id as sensor_id",
            "event_id as reading_id",
            "ts as datetime",
            "if(event_type = 'error', null, 62.0D + value / 5.0D) as temperature_f",
        )
    )


def fixture_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = pin_utc(spark).read.parquet(f"{sf_dir}/events.parquet")
    return events.filter("event_type = 'signup'").selectExpr(
        "event_id as session_id",
        "user_id as sensor_id",
        "'dough' as profile",
        "ts as start_ts",
        """case cast(event_id % 5 as int) when 0 then null when 1 then '84h' when 2 then '3D12H'
           when 3 then '5pm' else '2024-01-20 20:00' end as end_spec""",
        "'UTC' as tz",
        "1000.0D as volume_ml",
    )


def fixture_zoned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in four zones that end at a time of day."""
    return fixture_sessions(spark, sf_dir).withColumns(
        {
            "tz": F.expr(
                """case cast(session_id % 4 as int) when 0 then 'America/New_York'
                   when 1 then 'Asia/Kolkata' when 2 then 'Australia/Lord_Howe' else 'UTC' end"""
            ),
            "end_spec": F.expr(
                """case cast(session_id % 3 as int) when 0 then '5:30 pm' when 1 then '02:15'
                   else '23:59' end"""
            ),
        }
    )


def _zoned_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = resolve_session_bounds(fixture_zoned_sessions(spark, sf_dir))
    return bounds.select(
        "session_id",
        F.col("tz").alias("zone"),
        "start_ts",
        utc_to_local(F.col("start_ts"), F.col("tz")).alias("local_start"),
        "end_ts",
    )


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, and dates as text, which engines hand over in different types."""

    def plain(name: str, kind: str) -> Column:
        if kind == "double":
            return F.round(name, 6).alias(name)
        return F.col(name).cast("string") if kind == "date" else F.col(name)

    return df.select(*[plain(c, t) for c, t in df.dtypes])


def _on_readings(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _rounded(op(fixture_readings(spark, sf_dir)))


def _on_progress(op: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounds = resolve_session_bounds(fixture_sessions(spark, sf_dir))
        return _rounded(op(session_progress(fixture_readings(spark, sf_dir), bounds)))

    return run


def _on_offsets(op: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_progress(lambda p: op(report.with_offsets(p, AS_OF)))


def _interpolated(readings: DataFrame) -> DataFrame:
    return with_temperature(readings).select(
        "reading_id",
        "temperature_f",
        DOUGH.expected_hours("temperature_f").alias("expected_hours"),
        DOUGH.target_rise_pct("temperature_f").alias("target_rise_pct"),
    )


def _interpolated_by_table(readings: DataFrame) -> DataFrame:
    rows = with_temperature(readings).select(
        "reading_id", "temperature_f", F.lit("dough").alias("profile")
    )
    return interpolate_by_table(rows, reference_profile(readings.sparkSession)).drop("profile")


# chunks of ten days hold some twenty readings of a sensor; more than ten count as heavy
WIDE_CHUNK_SECONDS, FEW_ROWS = 864_000, 10


def _deltas(readings: DataFrame) -> DataFrame:
    return _seconds_apart(episodes.temp_deltas(readings))


def _deltas_of_heavy_chunks(readings: DataFrame) -> DataFrame:
    heavy = heavy_cells(readings, FEW_ROWS, WIDE_CHUNK_SECONDS)
    return _seconds_apart(episodes.temp_deltas(readings, WIDE_CHUNK_SECONDS, heavy))


def _seconds_apart(deltas: DataFrame) -> DataFrame:
    return deltas.select(
        "*", F.col("time_delta").cast("bigint").alias("time_delta_s")
    ).drop("time_delta")


def _progress_columns(progress: DataFrame) -> DataFrame:
    return progress.drop("profile", "tz", "volume_ml", "end_spec")


def _offset_columns(offsets: DataFrame) -> DataFrame:
    return offsets.select(
        "session_id",
        "wall_minutes",
        "data_minutes",
        "span_minutes",
        "age_minutes",
        "reference_minutes",
        F.date_format("reference_end", "yyyy-MM-dd HH:mm").alias("reference_end"),
        "target_volume_ml",
        "data_offset_minutes",
        "data_offset_direction",
        "wall_offset_minutes",
        "wall_offset_direction",
    )


def _json_fields(offsets: DataFrame) -> DataFrame:
    """The JSON texts read back, one column per field."""
    schema = report.payload(offsets).schema["payload"].dataType
    texts = report.progress_json(offsets)
    parsed = texts.select("session_id", F.from_json("json", schema).alias("p"))
    flat = parsed.select("session_id", "p.*")
    return flat.select(*[c for c in flat.columns if c != "meta"], "meta.*")


def _sustained(readings: DataFrame) -> DataFrame:
    return episodes.sustained_sessions(readings, max_gap_minutes=GAP_MINUTES)


def _of_class(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda r: _sustained(r).filter(F.col("class") == name).drop("class")


def _describe_sessions(readings: DataFrame) -> DataFrame:
    proofing = _of_class("proofing")(readings)
    return describe(proofing, ["duration_min", "median_temp"], within=readings)


QUERIES: dict[str, Query] = {
    "readings_since": _on_readings(lambda r: readings_since(r, SINCE, UNTIL)),
    "interpolate_profile": _on_readings(_interpolated),
    "interpolate_profile_table": _on_readings(_interpolated_by_table),
    "duration_parse": lambda s, d: parse_durations(fixture_sessions(s, d)),
    "session_bounds": lambda s, d: resolve_session_bounds(fixture_sessions(s, d)).select(
        "session_id", "sensor_id", "start_ts", "end_ts", "status"
    ),
    "session_bounds_zoned": _zoned_bounds,
    "sample_dates": _on_readings(
        lambda r: on_date(with_temperature(r), datetime.date.fromisoformat(SAMPLE_DATE))
    ),
    "session_progress": _on_progress(_progress_columns),
    "progress_elapsed_offsets": _on_offsets(_offset_columns),
    "progress_json": _on_offsets(_json_fields),
    "progress_report": _on_offsets(report.report_rows),
    "progress_report_text": _on_offsets(report.report_text),
    "reading_counts": _on_readings(explore.reading_counts),
    "temp_frequency": _on_readings(explore.temp_frequency),
    "top_temps": _on_readings(explore.top_temps),
    "temp_mode": _on_readings(explore.temp_mode),
    "hourly_mode": _on_readings(lambda r: explore.hourly_mode(r, ordered=True)),
    "monthly_mode": _on_readings(lambda r: explore.monthly_mode(r, ordered=True)),
    "describe_temps": _on_readings(lambda r: describe(with_temperature(r), ["temperature_f"])),
    "describe_temps_linear": _on_readings(
        lambda r: describe(with_temperature(r), ["temperature_f"], "linear", within=r)
    ),
    "describe_deltas": _on_readings(
        lambda r: describe(
            episodes.temp_deltas(r).filter("temp_delta is not null"), ["temp_delta"], within=r
        )
    ),
    "describe_sessions": _on_readings(_describe_sessions),
    "temp_deltas": _on_readings(_deltas),
    "temp_deltas_heavy_chunks": _on_readings(_deltas_of_heavy_chunks),
    "spikes": _on_readings(lambda r: episodes.spikes(_deltas(r))),
    "first_spikes": _on_readings(lambda r: episodes.earliest(episodes.spikes(_deltas(r)), 30)),
    "hot_readings": _on_readings(lambda r: episodes.hot_readings(_deltas(r))),
    "first_hot_readings": _on_readings(
        lambda r: episodes.earliest(episodes.hot_readings(_deltas(r)), 30)
    ),
    "spike_histogram": _on_readings(
        lambda r: episodes.spike_histogram(episodes.temp_deltas(r), ordered=True)
    ),
    "hot_transitions": _on_readings(episodes.hot_transitions),
    "hot_episodes": _on_readings(
        lambda r: episodes.hot_episodes(r, max_gap_minutes=GAP_MINUTES)
    ),
    "hot_suffix_summary": _on_readings(
        lambda r: episodes.hot_suffix_summary(r, max_gap_minutes=GAP_MINUTES)
    ),
    "hot_days": _on_readings(explore.hot_days),
    "daily_summary": _on_readings(explore.daily_summary),
    "cool_days": _on_readings(lambda r: explore.cool_days(r, ordered=True)),
    "cool_day_count": _on_readings(explore.cool_day_count),
    "zone_breakdown": _on_readings(explore.zone_breakdown),
    "elevated_histogram": _on_readings(lambda r: explore.elevated_histogram(r, ordered=True)),
    "sustained_sessions": _on_readings(_sustained),
    "proofing_sessions": _on_readings(_of_class("proofing")),
    "oven_sessions": _on_readings(_of_class("oven")),
    "sample_day_10min": _on_readings(lambda r: episodes.sample_days(r, _sustained(r))),
}
