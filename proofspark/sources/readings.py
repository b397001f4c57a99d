"""The readings table: one row per sensor reading."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofspark.functions.times import Moment, moment

READING_COLUMNS = ("sensor_id", "reading_id", "datetime", "temperature_f")


def load_readings(
    spark: SparkSession, path: str, start: Moment | None = None, end: Moment | None = None
) -> DataFrame:
    """Readings in a parquet file or folder; other columns are never read.

    ``sensor_id`` and ``reading_id`` are optional. A table without them is one sensor's series;
    ``reading_id`` then is a hash of the row, which orders equal timestamps repeatably. Bounds in UTC,
    both included, reach the scan whether ``datetime`` is stored with or without a zone.
    """
    return as_readings(spark.read.parquet(path), start, end)


def as_readings(
    table: DataFrame, start: Moment | None = None, end: Moment | None = None
) -> DataFrame:
    """Brings a table with at least ``datetime`` and ``temperature_f`` to the readings schema.

    Instants become UTC wall-clock times by their microseconds since 1970, in any session time zone. The
    result remembers the table, so that bounds of ``readings_since`` and ``on_date`` go to the stored column.
    """
    whole, when = table, F.col("datetime")
    zoned = dict(table.dtypes)["datetime"] == "timestamp"
    for bound, inside in ((start, when.__ge__), (end, when.__le__)):
        if bound is not None:
            limit = moment(bound)
            if zoned:
                seconds = F.date_diff(limit, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400
                of_day = F.hour(limit) * 3600 + F.minute(limit) * 60 + F.extract(F.lit("SECOND"), limit)
                limit = F.timestamp_micros(((seconds + of_day) * 1_000_000).cast("bigint"))
            table = table.filter(inside(limit))
    if zoned:
        second = (F.unix_micros(when) / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")
        zero = F.lit(0)
        when = F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(zero, zero, zero, second)
    temp = F.col("temperature_f").cast("double")
    sensor = F.col("sensor_id") if "sensor_id" in table.columns else F.lit(0)
    reading = (
        F.col("reading_id")
        if "reading_id" in table.columns
        else F.shiftright(F.xxhash64("datetime", temp), 2)
    )
    readings = table.select(
        sensor.cast("bigint").alias("sensor_id"),
        reading.cast("bigint").alias("reading_id"),
        when.cast("timestamp_ntz").alias("datetime"),
        temp.alias("temperature_f"),
    )
    if start is None and end is None:
        readings._between = lambda low, high: as_readings(whole, low, high)
    return readings


def _between(readings: DataFrame, start: Moment | None, end: Moment | None) -> DataFrame:
    """The same readings with bounds, given to the column as it is stored where that is known.

    A filter on a converted column does not pass the conversion, so files of instants would be read whole.
    Bounds that are columns are left to the filters.
    """
    again = vars(readings).get("_between")
    if again is None or isinstance(start, Column) or isinstance(end, Column):
        return readings
    return again(start, end)


def with_temperature(readings: DataFrame) -> DataFrame:
    kept = readings.filter(F.col("temperature_f").isNotNull())
    if again := vars(readings).get("_between"):
        kept._between = lambda low, high: with_temperature(again(low, high))
    return kept


def readings_since(
    readings: DataFrame, start: Moment, end: Moment | None = None, ordered: bool = True
) -> DataFrame:
    """Readings with a temperature from ``start`` to ``end``, both included."""
    kept = with_temperature(_between(readings, start, end)).filter(F.col("datetime") >= moment(start))
    if end is not None:
        kept = kept.filter(F.col("datetime") <= moment(end))
    return kept.orderBy("datetime", "sensor_id", "reading_id") if ordered else kept


def on_date(readings: DataFrame, day: datetime.date) -> DataFrame:
    """One UTC day as a range of ``datetime``, which reaches the parquet scan."""
    first = datetime.datetime.combine(day, datetime.time())
    after = first + datetime.timedelta(days=1)
    return _between(readings, first, after - datetime.timedelta(microseconds=1)).filter(
        (F.col("datetime") >= moment(first)) & (F.col("datetime") < moment(after))
    )


def zone_of(
    temp: Column, ambient_below: float = 82.0, oven_from: float = 90.0
) -> Column:
    """``ambient`` below the first bound, ``elevated`` up to the second, then ``oven``."""
    return (
        F.when(temp < ambient_below, "ambient")
        .when(temp < oven_from, "elevated")
        .when(temp >= oven_from, "oven")
    )
