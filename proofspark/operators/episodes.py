"""Runs of readings above a threshold, and steps between readings."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofspark.functions.rounding import whole_degree
from proofspark.functions.times import moment, rounded_minutes, whole_minutes
from proofspark.operators.quantiles import grouped_quantiles
from proofspark.operators.series import (
    BROADCAST_CELLS,
    CELL,
    CHUNK_SECONDS,
    FIND,
    ORDER,
    HeavyCells,
    carried,
    found_heavy,
    link_series,
    with_chunk,
)
from proofspark.sources.readings import with_temperature

# Thresholds in °F and minutes.
ELEVATED_FROM = 82.0
OVEN_FROM = 90.0
HOT_FROM = 85.0
SPIKE_RISE = 5.0
NOTABLE_RISE = 2.0
SUSTAINED_GAP_MINUTES = 5
HOT_GAP_MINUTES = 10
SUSTAINED_MINUTES = 10


def _longer(start: Column, end: Column, minutes: float) -> Column:
    return (end - start) > F.lit(datetime.timedelta(minutes=minutes))


def temp_deltas(
    readings: DataFrame, chunk_seconds: int = CHUNK_SECONDS, heavy: HeavyCells | None | str = FIND
) -> DataFrame:
    """Each reading with its rise and its time since the sensor's previous one."""
    linked = link_series(with_temperature(readings), None, chunk_seconds, heavy)
    return linked.select(
        "sensor_id",
        "reading_id",
        "datetime",
        "temperature_f",
        (F.col("temperature_f") - F.col("prev_temperature_f")).alias("temp_delta"),
        (F.col("datetime") - F.col("prev_datetime")).alias("time_delta"),
    )


def spikes(deltas: DataFrame, min_rise: float = SPIKE_RISE) -> DataFrame:
    """Rows of :func:`temp_deltas` that rose by at least ``min_rise``."""
    return deltas.filter(F.col("temp_delta") >= min_rise)


def hot_readings(deltas: DataFrame, threshold: float = HOT_FROM) -> DataFrame:
    return deltas.filter(F.col("temperature_f") >= threshold)


def earliest(rows: DataFrame, limit: int) -> DataFrame:
    """The first rows by time, as a report lists them."""
    return rows.orderBy("datetime", "sensor_id", "reading_id").limit(limit)


def spike_histogram(
    deltas: DataFrame, min_rise: float = NOTABLE_RISE, ordered: bool = False
) -> DataFrame:
    """Number of rises per whole degree; ``ordered`` by the degree."""
    buckets = (
        deltas.filter(F.col("temp_delta") >= min_rise)
        .groupBy(whole_degree(F.col("temp_delta")).alias("delta_bucket"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return buckets.orderBy("delta_bucket") if ordered else buckets


def _turn(threshold: float) -> Column:
    """+1 on entering the hot range, -1 on leaving, 0 between, null on a sensor's first reading."""
    hot = (F.col("temperature_f") >= threshold).cast("int")
    return hot - (F.col("prev_temperature_f") >= threshold).cast("int")


def hot_transitions(
    readings: DataFrame,
    threshold: float = HOT_FROM,
    chunk_seconds: int = CHUNK_SECONDS,
    heavy: HeavyCells | None | str = FIND,
) -> DataFrame:
    """Per sensor, how often the temperature entered and left the hot range.

    A series that opens hot has an end without a start.
    """
    linked = link_series(with_temperature(readings), None, chunk_seconds, heavy)
    turned = linked.select("sensor_id", _turn(threshold).alias("turn"))
    return turned.groupBy("sensor_id").agg(
        F.count_if(F.col("turn") == 1).alias("episodes_starting"),
        F.count_if(F.col("turn") == -1).alias("episodes_ending"),
    )


def hot_episodes(
    readings: DataFrame,
    threshold: float = HOT_FROM,
    max_gap_minutes: float = HOT_GAP_MINUTES,
    chunk_seconds: int = CHUNK_SECONDS,
    heavy: HeavyCells | None | str = FIND,
) -> DataFrame:
    """Contiguous hot runs that begin by entering the hot range, up to the first drop or gap."""

    def starts(dt: Column, temp: Column, prev_dt: Column, prev_temp: Column) -> Column:
        opens = prev_temp.isNull() | (prev_temp < threshold)
        return (temp >= threshold) & (opens | _longer(prev_dt, dt, max_gap_minutes))

    linked = link_series(with_temperature(readings), starts, chunk_seconds, heavy)
    runs = (
        linked.filter(F.col("temperature_f") >= threshold)
        .groupBy("sensor_id", "island")
        .agg(
            F.min("datetime").alias("start"),
            F.max("datetime").alias("end"),
            F.max("temperature_f").alias("peak_temp"),
            F.count(F.lit(1)).alias("readings"),
            F.bool_or(_turn(threshold) == 1).alias("entered"),
        )
    )
    return runs.filter("entered").select(
        "sensor_id",
        "start",
        "peak_temp",
        rounded_minutes(F.col("start"), F.col("end")).alias("duration_min"),
        "readings",
    )


def hot_suffix_summary(
    readings: DataFrame,
    threshold: float = HOT_FROM,
    max_gap_minutes: float = HOT_GAP_MINUTES,
    limit: int | None = 10,
    chunk_seconds: int = CHUNK_SECONDS,
    heavy: HeavyCells | None | str = FIND,
) -> DataFrame:
    """For each entry into the hot range, a summary of all hot readings from there to the end.

    Hot readings that follow the hot reading before them by more than the gap are left out, the
    entry itself never is. ``limit`` keeps each sensor's first entries; ``None`` keeps all.
    :func:`hot_episodes` is the one that stops at the first drop or gap.

    The suffix of a hot reading is the rest of its own chunk plus all later chunks. Inside a chunk, only
    its first reading and its first hot reading need to know what came before; so chunks are summed up
    without these two, the tree of chunks is scanned forwards for them, then backwards for what follows.
    """
    heavy, shifts = found_heavy(readings, heavy, chunk_seconds)
    hot = F.col("temperature_f") >= threshold
    inside = Window.partitionBy(*CELL).orderBy(*ORDER)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = with_chunk(with_temperature(readings), chunk_seconds, heavy).select(
        *CELL,
        "reading_id",
        "datetime",
        "temperature_f",
        F.lag("temperature_f").over(inside).alias("_temp"),
        F.lag("datetime").over(inside).isNull().alias("_first"),
        F.max(F.when(hot, F.col("datetime"))).over(earlier).alias("_hot_at"),
    )
    near = hot & ~_longer(F.col("_hot_at"), F.col("datetime"), max_gap_minutes)
    local = local.withColumns(
        {
            "kept": F.coalesce(near, F.lit(False)),
            "entry": F.coalesce(hot & (F.col("_temp") < threshold), F.lit(False)),
        }
    )
    edges = local.groupBy(*CELL).agg(
        F.max(F.struct("chunk", "part", *ORDER, "temperature_f")).alias("tail"),
        F.max(F.when(hot, F.col("datetime"))).alias("hot_at"),
        F.min(F.when(hot, F.struct(*ORDER, "temperature_f"))).alias("first_hot"),
        F.max(F.when(F.col("_first"), hot)).alias("head_hot"),
        F.count_if("entry").alias("inner_entries"),
        F.count_if("kept").alias("inner_n"),
        F.max(F.when(F.col("kept"), F.col("datetime"))).alias("inner_last"),
        F.max(F.when(F.col("kept"), F.col("temperature_f"))).alias("inner_peak"),
    )
    edges = carried(edges, shifts, maxima=["tail", "hot_at"])
    joins = F.col("before_hot_at").isNull() | ~_longer(
        F.col("before_hot_at"), F.col("first_hot.datetime"), max_gap_minutes
    )
    edges = edges.withColumns(
        {
            "joins": F.col("first_hot").isNotNull() & joins,
            "head_entry": F.coalesce(
                F.col("head_hot") & (F.col("before_tail.temperature_f") < threshold), F.lit(False)
            ),
        }
    ).select(
        *CELL,
        "head_entry",
        (F.col("inner_n") + F.col("joins").cast("bigint")).alias("n"),
        F.greatest("inner_last", F.when(F.col("joins"), F.col("first_hot.datetime"))).alias("last"),
        F.greatest("inner_peak", F.when(F.col("joins"), F.col("first_hot.temperature_f"))).alias("peak"),
        (F.col("inner_entries") + F.col("head_entry").cast("bigint")).alias("entries"),
    )
    edges = carried(edges, shifts, ["n"], ["last", "peak"], backwards=True)
    if limit is not None:
        edges = carried(edges, shifts, ["entries"])

    # backwards, as a frame that grows takes linear time and one that shrinks quadratic
    in_chunk = (
        Window.partitionBy(*CELL)
        .orderBy(*[F.desc(c) for c in ORDER])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rest = local.select(
        "*",
        F.count_if("kept").over(in_chunk).alias("rest_n"),
        F.max(F.when(F.col("kept"), F.col("datetime"))).over(in_chunk).alias("rest_last"),
        F.max(F.when(F.col("kept"), F.col("temperature_f"))).over(in_chunk).alias("rest_peak"),
        F.count_if("entry").over(in_chunk).alias("rest_entries"),
    ).filter(F.col("entry") | (F.col("_first") & hot))
    found = rest.join(edges, list(CELL)).filter(F.col("entry") | F.col("head_entry"))
    if limit is not None:
        # all entries of the chunk but those after this one
        nth = F.col("before_entries") + F.col("entries") - F.col("rest_entries")
        found = found.filter(nth <= limit)
    return found.select(
        "sensor_id",
        F.col("datetime").alias("start"),
        F.greatest("temperature_f", "rest_peak", "before_peak").alias("peak_temp"),
        rounded_minutes(
            F.col("datetime"), F.greatest("datetime", "rest_last", "before_last")
        ).alias("duration_min"),
        (F.lit(1) + F.col("rest_n") + F.col("before_n")).alias("readings"),
    )


def sustained_sessions(
    readings: DataFrame,
    threshold: float = ELEVATED_FROM,
    max_gap_minutes: float = SUSTAINED_GAP_MINUTES,
    min_duration_minutes: int = SUSTAINED_MINUTES,
    oven_from: float = OVEN_FROM,
    chunk_seconds: int = CHUNK_SECONDS,
    heavy: HeavyCells | None | str = FIND,
    ordered: bool = False,
) -> DataFrame:
    """Elevated episodes of some length, classed ``proofing`` or ``oven`` by their peak.

    The gap is taken between all neighbouring readings, elevated or not. ``ordered`` by the start.
    """

    def starts(dt: Column, temp: Column, prev_dt: Column, prev_temp: Column) -> Column:
        opens = F.coalesce(prev_temp < threshold, F.lit(True))
        return (temp >= threshold) & (opens | _longer(prev_dt, dt, max_gap_minutes))

    linked = link_series(with_temperature(readings), starts, chunk_seconds, heavy)
    elevated = linked.filter(F.col("temperature_f") >= threshold).select(
        "sensor_id", "island", "datetime", "temperature_f"
    )
    length = whole_minutes(F.col("start"), F.col("end"))
    episodes = grouped_quantiles(
        elevated,
        ["sensor_id", "island"],
        "temperature_f",
        {"median_temp": 0.5},
        extras={
            "start": (F.min, "datetime"),
            "end": (F.max, "datetime"),
            "peak_temp": (F.max, "temperature_f"),
        },
        having=lambda: length >= min_duration_minutes,
        within=(readings.filter(F.col("temperature_f") >= threshold), ["sensor_id"]),
    )
    classed = episodes.select(
        "sensor_id",
        "start",
        "end",
        length.alias("duration_min"),
        F.col("n").alias("readings"),
        "peak_temp",
        "median_temp",
        F.when(F.col("peak_temp") < oven_from, "proofing").otherwise("oven").alias("class"),
    )
    return classed.orderBy("start", "sensor_id") if ordered else classed


def sample_days(readings: DataFrame, sessions: DataFrame, minutes: int = 10) -> DataFrame:
    """Each sensor's day of its first proofing session, as medians of ``minutes`` at a time.

    The days are worked out at once. Up to 100,000 of them are broadcast, and the days among them reach
    the scan of the readings as ranges, so that files without such a day are skipped.
    """
    found = (
        sessions.filter(F.col("class") == "proofing")
        .groupBy("sensor_id")
        .agg(F.to_date(F.min("start")).alias("sample_date"))
    )
    days, rows = _few_days(found), with_temperature(readings)
    if days is None:
        days = found
    else:
        rows = rows.filter(_on_days([r["sample_date"] for r in days]))
        days = F.broadcast(readings.sparkSession.createDataFrame(days, found.schema))
    daily = rows.withColumn("sample_date", F.to_date("datetime"))
    bucketed = daily.join(days, ["sensor_id", "sample_date"]).select(
        "sensor_id",
        F.window("datetime", f"{minutes} minutes").getField("start").alias("bucket"),
        "temperature_f",
    )
    return grouped_quantiles(
        bucketed, ["sensor_id", "bucket"], "temperature_f", {"temp_f": 0.5}, within=(rows, ["sensor_id"])
    ).select("sensor_id", "bucket", "temp_f")


def _few_days(days: DataFrame, most: int = BROADCAST_CELLS) -> list | None:
    """The rows of a table of sensors and days, or None where there are too many."""
    rows = days.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _on_days(days: list[datetime.date], most: int = 64) -> Column:
    """Whether ``datetime`` falls on one of the days, as ranges of whole days, which reach the scan.

    Beyond ``most`` ranges the closest ones are merged, with the days between them.
    """
    ranges: list[list[datetime.date]] = []
    one = datetime.timedelta(days=1)
    for day in sorted(set(days)):
        if ranges and ranges[-1][1] == day:
            ranges[-1][1] = day + one
        else:
            ranges.append([day, day + one])
    if len(ranges) > most:
        gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])
        ends = sorted(gaps[len(ranges) - most :])
        ranges = [[ranges[i][0], ranges[j - 1][1]] for i, j in zip([0, *ends], [*ends, len(ranges)])]
    when = F.col("datetime")
    found = F.lit(False)
    for low, high in ranges:
        found = found | ((when >= moment(f"{low}")) & (when < moment(f"{high}")))
    return found
