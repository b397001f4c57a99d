"""Fermentation progress of many sessions over many sensors.

A join of readings with the sessions they fall in would repeat each reading once per session,
and on a busy sensor with open or overlapping sessions that grows with the product of both.
Here no reading is ever repeated:

1. A table of the sensors with sessions, and when their first begins and their last ends, drops
   all other readings at the scan.
2. Session bounds go into the series as marker rows. The running number of markers before a
   reading is its *segment*; no session begins or ends inside a segment. The running number
   comes from chunks of fixed time width (see :mod:`proofspark.operators.series`).
3. Readings are summed up per (sensor, segment), partly before the shuffle.
4. Segments are summed up into blocks of 32, these into blocks of 1,024 and so on, each level from
   the one below, as many as the busiest sensor needs. A session is a range of segments, hence a
   handful of blocks on each level, joined by equality.

A reading weighs the time since the reading before it, but the first reading of a session weighs
nothing. The weights of readings that open a segment (``head``) are therefore summed apart from
all others (``open``), and a block also knows the one of its very first reading (``first``), which
a session leaves out of the block it begins with.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from proofspark.functions.profile import DOUGH, Profile, with_profile_values
from proofspark.functions.times import moment
from proofspark.operators.series import (
    BROADCAST_CELLS,
    CELL,
    CHUNK_SECONDS,
    FIND,
    HeavyCells,
    carried,
    chunk_of,
    found_heavy,
    tree_shifts,
    with_chunk,
)
from proofspark.sources.readings import with_temperature

BLOCK_BITS = 5  # 32 segments or blocks per block of the next level

_START, _READING, _END = 0, 1, 2

PROGRESS_FIELDS = (
    "elapsed_hours",
    "avg_temp_f",
    "current_temp_f",
    "last_reading_at",
    "target_rise_pct",
    "est_rise_pct",
    "reading_count",
    "min_temp_f",
    "max_temp_f",
    "integral",
)


def session_progress(
    readings: DataFrame,
    sessions: DataFrame,
    profiles: Sequence[Profile] = (DOUGH,),
    chunk_seconds: int = CHUNK_SECONDS,
    heavy: HeavyCells | None | str = FIND,
) -> DataFrame:
    """One row per session: its columns and the progress fields.

    ``sessions`` come from ``resolve_session_bounds``. A session without readings has
    ``reading_count`` 0, status ``no_readings`` and nulls elsewhere; one with an unreadable end
    keeps status ``bad_end``. ``reference_hours`` are the profile's hours at the average.
    """
    found = _needed(with_temperature(readings), sessions)
    heavy, shifts = found_heavy(found.readings, heavy, chunk_seconds, readings)
    # one exchange that all uses below share, as the array keeps them from being pruned to different
    # columns, so that the ends of sessions are worked out once
    dealt = sessions.repartition("sensor_id").select(F.inline(F.array(F.struct(*sessions.columns))))
    markers = _markers(dealt, chunk_seconds)
    numbered = _numbered_readings(found.readings, markers, chunk_seconds, heavy, shifts)
    levels = _levels(_segments(numbered, profiles), profiles, found.levels)
    # markers are never cut finer than by chunks
    ranges = _session_ranges(markers, shifts if len(shifts) == 1 else tree_shifts(chunk_seconds, None))
    totals = _session_totals(ranges, levels, profiles)
    return _finish(dealt, totals, profiles)


@dataclass(frozen=True)
class _Needed:
    """The readings that sessions can need, and how many levels of blocks their segments take."""

    readings: DataFrame
    levels: int


def _needed(readings: DataFrame, sessions: DataFrame) -> _Needed:
    """Readings of sensors with sessions, from the first start to the last end of each.

    Works out the range of every sensor at once, one row a sensor. Up to 100,000 of them are broadcast
    and filter the readings where they are read; the range of all sensors together reaches the scan.
    With more sensors only that range is used, and the others' readings go with the segments.
    """
    valid = "status = 'ok' and (end_ts is null or end_ts >= start_ts)"
    # sessions that can't hold a reading are left out by conditions, as in _markers
    ranges = (
        sessions.groupBy("sensor_id")
        .agg(
            F.expr(f"min(if({valid}, start_ts, null)) as first_at"),
            F.expr(f"max(if({valid}, end_ts, null)) as last_at"),
            F.expr(f"bool_or({valid} and end_ts is null) as any_open"),
            F.expr(f"count_if({valid}) as sessions"),
        )
        .filter("sessions > 0")
    )
    rows = ranges.limit(BROADCAST_CELLS + 1).collect()
    if not rows:
        return _Needed(readings.limit(0), 1)
    if len(rows) <= BROADCAST_CELLS:
        first, any_open = min(r["first_at"] for r in rows), any(r["any_open"] for r in rows)
        last = None if any_open else max(r["last_at"] for r in rows)
        most = max(r["sessions"] for r in rows)
        per_sensor = F.broadcast(
            readings.sparkSession.createDataFrame(
                [(r["sensor_id"], r["first_at"], None if r["any_open"] else r["last_at"]) for r in rows],
                "sensor_id bigint, first_at timestamp_ntz, last_at timestamp_ntz",
            )
        )
        inside = "datetime >= first_at and (last_at is null or datetime <= last_at)"
        kept = readings.join(per_sensor, "sensor_id").filter(inside).select(*readings.columns)
    else:
        first, last, any_open, most = ranges.agg(
            F.min("first_at"), F.max("last_at"), F.bool_or("any_open"), F.max("sessions")
        ).first()
        last, kept = None if any_open else last, readings
    kept = kept.filter(F.col("datetime") >= moment(first))
    if last is not None:
        kept = kept.filter(F.col("datetime") <= moment(last))
    # twice as many markers as sessions, and a segment before the first
    return _Needed(kept, max(1, -(-(2 * most + 1).bit_length() // BLOCK_BITS)))


def _markers(sessions: DataFrame, chunk_seconds: int) -> DataFrame:
    """Two rows per session, its start and its end; an open session has no end.

    Sessions that cannot hold a reading have none. They are left out here, not by a filter: a
    filter would be pushed below the parsing of the ends and repeat it.
    """
    start = f"struct(start_ts as datetime, {_START} as kind)"
    end = f"struct(end_ts as datetime, {_END} as kind)"
    bounds = f"""case when status <> 'ok' or end_ts < start_ts then array()
        when end_ts is null then array({start}) else array({start}, {end}) end"""
    return sessions.selectExpr(
        "session_id as id", "sensor_id", "end_ts is null as is_open", f"inline({bounds})"
    ).withColumn("chunk", chunk_of("datetime", chunk_seconds) * F.lit(chunk_seconds * 1_000_000).cast("bigint"))


def _so_far(*cell: str, last: int = Window.currentRow) -> WindowSpec:
    """The rows of the same chunk up to the current one, or up to ``last`` rows from it."""
    inside = Window.partitionBy(*cell).orderBy("datetime", "kind", "id")
    return inside.rowsBetween(Window.unboundedPreceding, last)


def _session_ranges(markers: DataFrame, shifts: list[int]) -> DataFrame:
    """Per session its first and last segment, both included. Readings play no part in this."""
    numbered = markers.withColumn("inner_marks", F.count(F.lit(1)).over(_so_far("sensor_id", "chunk")))
    edges = markers.groupBy("sensor_id", "chunk").agg(F.expr("count(1) as marks"), F.expr("0L as part"))
    edges = carried(edges, shifts, ["marks"]).select("sensor_id", "chunk", "before_marks")
    whole = markers.groupBy("sensor_id").agg(F.expr("count(1) as all_marks"))
    return (
        numbered.join(edges, ["sensor_id", "chunk"])
        .selectExpr("*", "before_marks + inner_marks as number")
        .groupBy("id", "sensor_id")
        .agg(
            F.expr(f"max(case when kind = {_START} then number end) as first_seg"),
            F.expr(f"max(case when kind = {_END} then number - 1 end) as last_seg"),
        )
        .join(whole, "sensor_id")
        .selectExpr("id as session_id", "sensor_id", "first_seg", "coalesce(last_seg, all_marks) as last_seg")
    )


def _numbered_readings(
    readings: DataFrame,
    markers: DataFrame,
    chunk_seconds: int,
    heavy: HeavyCells | None,
    shifts: list[int],
) -> DataFrame:
    """Readings with ``seg``, ``pos`` (running number), ``secs`` since the previous reading, and
    ``head``: whether a marker lies between them.

    At equal timestamps starts come before and ends after the readings, as bounds are inclusive.
    What crosses a chunk's border is kept as maxima and counts, summed up before the shuffle.
    """
    rows = readings.select(
        "sensor_id",
        F.col("reading_id").alias("id"),
        "datetime",
        "temperature_f",
        F.lit(_READING).alias("kind"),
    ).unionByName(markers.drop("is_open", "chunk"), allowMissingColumns=True)
    # in a heavy instant the starts are a part of their own before, the ends one after the readings
    part = f"""case kind when {_START} then -1L when {_READING} then size(filter(bounds, b -> b <= id))
        else {2**62}L end"""
    rows = with_chunk(rows, chunk_seconds, heavy, part)
    latest = {
        "dt": F.expr(f"max(case when kind = {_READING} then datetime end)"),
        "start": F.expr(f"max(case when kind = {_START} then datetime end)"),
        "end": F.expr(f"max(case when kind = {_END} then datetime end)"),
    }
    counts = {
        "marks": F.expr(f"count_if(kind <> {_READING})"),
        "rows": F.expr(f"count_if(kind = {_READING})"),
    }

    so_far, earlier = _so_far(*CELL), _so_far(*CELL, last=-1)
    local = rows.select(
        "*",
        *[c.over(so_far).alias(f"inner_{n}") for n, c in counts.items()],
        *[c.over(earlier).alias(f"inner_{n}") for n, c in latest.items()],
    ).filter(f"kind = {_READING}")

    edges = rows.groupBy(*CELL).agg(*[c.alias(n) for n, c in (counts | latest).items()])
    edges = carried(edges, shifts, list(counts), list(latest))
    edges = edges.select(*CELL, *[f"before_{n}" for n in counts | latest])
    # a start at the previous reading's time lies before that reading, an end after it
    return (
        local.join(edges, list(CELL))
        .selectExpr(
            "sensor_id",
            "datetime",
            "temperature_f",
            *[f"before_{n} + inner_{n} as {n}" for n in counts],
            *[f"coalesce(inner_{n}, before_{n}) as last_{n}" for n in latest],
        )
        .selectExpr(
            "sensor_id",
            "datetime",
            "temperature_f",
            "marks as seg",
            "rows as pos",
            "coalesce(cast(datetime - last_dt as bigint), 0) as secs",
            "coalesce(last_start > last_dt, false) or coalesce(last_end >= last_dt, false)"
            " or last_dt is null as head",
        )
    )


def _sum_names(profiles: Sequence[Profile]) -> list[str]:
    """Sums kept per block: seconds, degree-seconds, and the integral of each profile."""
    return ["secs", "heat", *[f"integral_{i}" for i in range(len(profiles))]]


def _segments(numbered: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """Sums of the readings of each (sensor, segment)."""
    hours = {f"hours_{i}": p.expected_hours("temperature_f") for i, p in enumerate(profiles)}
    weights = {"secs": "secs", "heat": "temperature_f * secs"}
    weights |= {f"integral_{i}": f"secs / 3600D / hours_{i}" for i in range(len(profiles))}
    sums = []
    for n, weight in weights.items():
        sums.append(F.expr(f"sum(if(head, 0, {weight})) as open_{n}"))
        sums.append(F.expr(f"sum(if(head, {weight}, 0)) as head_{n}"))
    return (
        numbered.withColumns(hours)
        .groupBy("sensor_id", "seg")
        .agg(
            F.expr("count(1) as readings"),
            F.expr("min(if(isnan(temperature_f), null, temperature_f)) as low"),
            F.expr("max(if(isnan(temperature_f), null, temperature_f)) as high"),
            F.expr("min_by(temperature_f, pos) as first_temp"),
            F.expr("max_by(temperature_f, pos) as last_temp"),
            F.expr("max(datetime) as last_dt"),
            *sums,
        )
    )


def _levels(segments: DataFrame, profiles: Sequence[Profile], levels: int) -> list[DataFrame]:
    """Segments summed up per (sensor, block), level by level; level 0 are the segments themselves.

    A level has a 32nd of the rows of the one below it, from which it is made, so that all levels
    together shuffle little more than the segments once.
    """
    first = [F.lit(0.0).alias(f"first_{n}") for n in _sum_names(profiles)]
    found = [segments.select("*", F.col("seg").alias("block"), *first)]
    sums = []
    for n in _sum_names(profiles):
        sums.append(F.expr(f"sum(open_{n}) as open_{n}"))
        sums.append(F.expr(f"sum(head_{n}) as head_{n}"))
    for level in range(1, levels):
        # the very first segment's head is level 0's own, and handed on above
        lead = "head_{n}" if level == 1 else "first_{n}"
        firsts = [F.expr(f"min_by({lead.format(n=n)}, seg) as first_{n}") for n in _sum_names(profiles)]
        found.append(
            found[-1]
            .withColumn("block", F.expr(f"shiftright(block, {BLOCK_BITS})"))
            .groupBy("sensor_id", "block")
            .agg(
                F.expr("sum(readings) as readings"),
                F.expr("min(low) as low"),
                F.expr("max(high) as high"),
                F.expr("min_by(first_temp, seg) as first_temp"),
                F.expr("max_by(last_temp, seg) as last_temp"),
                F.expr("max(last_dt) as last_dt"),
                F.expr("min(seg) as seg"),
                *sums,
                *firsts,
            )
        )
    return found


def _cover(first: str, after: str, levels: int) -> list[str]:
    """Per level the blocks that make up the segments from ``first`` up to but without ``after``.

    What does not fill a block of the next level stays on its own level, at both ends.
    """

    def whole_from(level: int) -> str:
        bits = BLOCK_BITS * level
        return f"shiftright({first} + {2**bits - 1}, {bits})"

    def whole_until(level: int) -> str:
        return f"shiftright({after}, {BLOCK_BITS * level})"

    def numbers(low: str, high: str) -> str:
        return f"if({low} < {high}, sequence({low}, {high} - 1), array())"

    pieces = []
    for level in range(levels):
        low, high = whole_from(level), whole_until(level)
        found = numbers(low, high)
        if level < levels - 1:
            up, down = whole_from(level + 1), whole_until(level + 1)
            left = numbers(low, f"{up} * {2**BLOCK_BITS}")
            right = numbers(f"{down} * {2**BLOCK_BITS}", high)
            found = f"if({up} < {down}, concat({left}, {right}), {found})"
        pieces.append(found)
    return pieces


def _session_totals(
    ranges: DataFrame, levels: list[DataFrame], profiles: Sequence[Profile]
) -> DataFrame:
    """The sums of each session over the blocks of its range."""
    found: DataFrame | None = None
    for level, blocks in enumerate(levels):
        cover = _cover("first_seg", "(last_seg + 1)", len(levels))[level]
        pieces = ranges.selectExpr("session_id", "sensor_id", f"explode({cover}) as block")
        # each level is joined by the keys it was grouped by
        of_level = pieces.join(blocks, ["sensor_id", "block"]).withColumn("level", F.lit(level))
        found = of_level if found is None else found.unionByName(of_level)
    of_session = Window.partitionBy("session_id")
    found = found.withColumn("leads", F.col("seg") == F.min("seg").over(of_session))
    sums = []
    for n in _sum_names(profiles):
        heads = f"case when not leads then head_{n} when level > 0 then head_{n} - first_{n} else 0 end"
        sums.append(F.expr(f"sum(open_{n} + {heads}) as {n}"))
    return found.groupBy("session_id").agg(
        F.expr("sum(readings) as readings"),
        F.expr("min(low) as low"),
        F.expr("max(high) as high"),
        F.expr("min_by(first_temp, seg) as first_temp"),
        F.expr("max_by(last_temp, seg) as current_temp_f"),
        F.expr("max(last_dt) as last_reading_at"),
        *sums,
    )


def _finish(
    sessions: DataFrame, totals: DataFrame, profiles: Sequence[Profile]
) -> DataFrame:
    integral = F.coalesce(
        *[
            F.when(F.col("profile") == p.name, F.col(f"integral_{i}"))
            for i, p in enumerate(profiles)
        ]
    )
    # the first reading weighs zero, but zero times NaN still shows, as in a plain sum
    average = "if(secs = 0, first_temp, (heat + first_temp * 0D) / nullif(secs, 0))"
    found = with_profile_values(
        sessions.join(totals, "session_id", "left").withColumns(
            {"avg_temp_f": F.expr(average), "integral": integral}
        ),
        profiles,
        "avg_temp_f",
        "reference_hours",
        "target_rise_pct",
    )
    capped = "least(integral * target_rise_pct, target_rise_pct)"
    return found.selectExpr(
        *[c for c in sessions.columns if c != "status"],
        "if(status = 'ok' and readings is null, 'no_readings', status) as status",
        "secs / 3600D as elapsed_hours",
        "avg_temp_f",
        "current_temp_f",
        "last_reading_at",
        "target_rise_pct",
        f"if(integral is not null and target_rise_pct is not null, {capped}, null)"
        " as est_rise_pct",
        "coalesce(readings, 0) as reading_count",
        # a NaN counts only where it comes first, since nothing compares as less or more
        "if(isnan(first_temp), first_temp, low) as min_temp_f",
        "if(isnan(first_temp), first_temp, high) as max_temp_f",
        "integral",
        "reference_hours",
    )
