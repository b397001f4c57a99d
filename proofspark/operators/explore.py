"""Counts, modes and daily summaries over whole series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofspark.functions.rounding import whole_degree
from proofspark.operators.episodes import ELEVATED_FROM, HOT_FROM, OVEN_FROM
from proofspark.operators.quantiles import grouped_quantiles
from proofspark.sources.readings import with_temperature


def reading_counts(readings: DataFrame, hot_from: float = HOT_FROM) -> DataFrame:
    """One row: all readings, those without and with a temperature, and the hot ones."""
    temp = F.col("temperature_f")
    return readings.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(temp.isNull()).alias("null_temps"),
        F.count(temp).alias("non_null_temps"),
        F.count_if(temp >= hot_from).alias("hot_readings"),
    )


def temp_frequency(readings: DataFrame) -> DataFrame:
    """Readings per whole degree."""
    return (
        with_temperature(readings)
        .groupBy(whole_degree(F.col("temperature_f")).alias("temp_rounded"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_temps(readings: DataFrame, limit: int = 20) -> DataFrame:
    """The most common whole degrees, the lower one first among equals."""
    return temp_frequency(readings).orderBy(F.desc("count"), "temp_rounded").limit(limit)


def _most_common() -> Column:
    """The (count, degree) of the highest count, the lowest degree among equals."""
    return F.max(
        F.struct(F.col("count"), (-F.col("temp_rounded")).alias("negated"))
    )


def temp_mode(readings: DataFrame) -> DataFrame:
    """The most common whole degree, its count and its share of all temperatures in percent."""
    top = temp_frequency(readings).agg(
        _most_common().alias("top"), F.sum("count").alias("total")
    )
    # no readings, no mode
    return top.filter(F.col("total").isNotNull()).select(
        (-F.col("top.negated")).alias("mode_temp"),
        F.col("top.count").alias("mode_count"),
        (F.lit(100.0) * F.col("top.count") / F.col("total")).alias("mode_pct"),
    )


def _mode_per(readings: DataFrame, parts: dict[str, Column]) -> DataFrame:
    counted = (
        with_temperature(readings)
        .groupBy(
            *[part.cast("bigint").alias(name) for name, part in parts.items()],
            whole_degree(F.col("temperature_f")).alias("temp_rounded"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return (
        counted.groupBy(*parts)
        .agg(_most_common().alias("top"))
        .select(
            *parts,
            (-F.col("top.negated")).alias("most_common_temp"),
            F.col("top.count").alias("count"),
        )
    )


def hourly_mode(readings: DataFrame, ordered: bool = False) -> DataFrame:
    """The most common whole degree by UTC hour of the day; ``ordered`` by the hour."""
    modes = _mode_per(readings, {"hour": F.hour("datetime")})
    return modes.orderBy("hour") if ordered else modes


def monthly_mode(readings: DataFrame, ordered: bool = False) -> DataFrame:
    """The most common whole degree by UTC year and month; ``ordered`` by both."""
    modes = _mode_per(readings, {"year": F.year("datetime"), "month": F.month("datetime")})
    return modes.orderBy("year", "month") if ordered else modes


def zone_breakdown(
    readings: DataFrame, ambient_below: float = ELEVATED_FROM, oven_from: float = OVEN_FROM
) -> DataFrame:
    """Count and percentage of the three temperature zones, empty zones included."""
    temp = F.col("temperature_f")
    counts = with_temperature(readings).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(temp < ambient_below).alias("ambient"),
        F.count_if((temp >= ambient_below) & (temp < oven_from)).alias("elevated"),
        F.count_if(temp >= oven_from).alias("oven"),
    )
    zones = counts.unpivot("total", ["ambient", "elevated", "oven"], "zone", "count")
    share = F.when(F.col("total") > 0, F.lit(100.0) * F.col("count") / F.col("total"))
    return zones.select("zone", "count", share.alias("pct"))


def elevated_histogram(
    readings: DataFrame,
    low: float = ELEVATED_FROM,
    high: float = OVEN_FROM,
    ordered: bool = False,
) -> DataFrame:
    """Readings per whole degree inside the elevated zone; ``ordered`` by the degree."""
    temp = F.col("temperature_f")
    buckets = (
        readings.filter((temp >= low) & (temp < high))
        .groupBy(whole_degree(temp).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return buckets.orderBy("bucket") if ordered else buckets


def hot_days(
    readings: DataFrame,
    threshold: float = HOT_FROM,
    limit: int | None = 20,
    by: Sequence[str] = (),
) -> DataFrame:
    """Days (per ``by``) with the most hot readings, and their peaks."""
    days = (
        readings.filter(F.col("temperature_f") >= threshold)
        .groupBy(*by, F.to_date("datetime").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("hot_readings"),
            F.max("temperature_f").alias("peak_temp"),
        )
    )
    if limit is None:
        return days
    return days.orderBy(F.desc("hot_readings"), "date", *by).limit(limit)


def daily_summary(
    readings: DataFrame,
    by: Sequence[str] = ("sensor_id",),
    peak_below: float | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Readings, peak and median per day (per ``by``); with ``peak_below`` only cooler days.

    ``ordered`` by the date, then by ``by``.
    """
    dated = with_temperature(readings).select(
        *by, F.to_date("datetime").alias("date"), "temperature_f"
    )
    days = grouped_quantiles(
        dated,
        [*by, "date"],
        "temperature_f",
        {"median_temp": 0.5},
        extras={"peak_temp": (F.max, "temperature_f")},
        having=None if peak_below is None else lambda: F.col("peak_temp") < peak_below,
        within=(readings, list(by)) if by else None,
    ).select(*by, "date", F.col("n").alias("total_readings"), "peak_temp", "median_temp")
    return days.orderBy("date", *by) if ordered else days


def cool_days(
    readings: DataFrame,
    threshold: float = HOT_FROM,
    by: Sequence[str] = ("sensor_id",),
    ordered: bool = False,
) -> DataFrame:
    """Days without a hot reading; ``ordered`` as in :func:`daily_summary`."""
    return daily_summary(readings, by, peak_below=threshold, ordered=ordered)


def cool_day_count(
    readings: DataFrame, threshold: float = HOT_FROM, by: Sequence[str] = ("sensor_id",)
) -> DataFrame:
    """One row: days with readings, and those without a hot one. Needs no medians."""
    days = (
        with_temperature(readings)
        .groupBy(*by, F.to_date("datetime").alias("date"))
        .agg(F.max("temperature_f").alias("peak_temp"))
    )
    return days.agg(
        F.count(F.lit(1)).alias("days"),
        F.count_if(F.col("peak_temp") < threshold).alias("cool_days"),
    )
