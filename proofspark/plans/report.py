"""Progress reports: elapsed times and reference offsets, a JSON payload, and text rows.

All functions keep one row per session and add no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofspark.functions.rounding import fixed_text, round_places
from proofspark.functions.times import (
    Moment,
    age_text,
    hours_minutes,
    long_stamp,
    moment,
    now_utc,
    rounded_minutes,
    short_stamp,
)


def with_offsets(progress: DataFrame, as_of: Moment | None = None) -> DataFrame:
    """Adds elapsed minutes, the age of the last reading and the distance to the reference.

    ``wall`` runs from the start to the end, or to ``as_of`` (now) while the session is open;
    ``data`` to the last reading; ``span`` from the first to the last reading. The age is always
    against ``as_of``. ``under`` means less than the reference hours have passed.
    """
    now = now_utc() if as_of is None else moment(as_of)
    start, last = F.col("start_ts"), F.col("last_reading_at")
    readable = ~F.col("status").isin("bad_end", "bad_tz")
    timed = progress.withColumns(
        {
            "run_at": now,
            "wall_minutes": F.when(
                readable, rounded_minutes(start, F.coalesce("end_ts", now))
            ),
            "data_minutes": rounded_minutes(start, last),
            "span_minutes": F.expr("cast(bround(elapsed_hours * 60, 0) as bigint)"),
            "age_minutes": rounded_minutes(last, now),
            "reference_minutes": F.expr("cast(bround(reference_hours * 60, 0) as bigint)"),
            "reference_end": F.expr(
                "start_ts + make_dt_interval(0, 0, 0,"
                " cast(reference_hours * 3600 as decimal(18, 6)))"
            ),
            "target_volume_ml": F.expr("volume_ml * (1 + target_rise_pct / 100)"),
        }
    )
    offsets = {}
    for name, hours in (("data", "elapsed_hours"), ("wall", "wall_minutes / 60")):
        gap = f"(reference_hours - {hours})"
        offsets[f"{name}_offset_minutes"] = F.expr(f"abs(cast(bround({gap} * 60, 0) as bigint))")
        offsets[f"{name}_offset_direction"] = F.expr(
            f"case when {hours} < reference_hours then 'under'"
            " when reference_hours is not null then 'over' end"
        )
    return timed.withColumns(offsets)


def _message() -> Column:
    """What is said of a session without readings; null for one with readings."""
    since = F.concat(long_stamp(F.col("start_ts"), F.col("tz")), F.lit(" "), F.col("tz"))
    said = (
        F.when(F.col("status") == "bad_end", F.lit("end of session not understood"))
        .when(F.col("status") == "bad_tz", F.lit("time zone of session not known"))
        .otherwise(F.concat(F.lit("no sensor readings found since "), since))
    )
    return F.when(F.col("reading_count") == 0, said)


def payload(offsets: DataFrame, meta: bool = True) -> DataFrame:
    """``session_id`` and the struct ``payload`` of each session.

    A session without readings has its start and a ``message``, and nulls elsewhere.
    """
    tz = F.col("tz")
    # The names of the fields and their order.
    fields = [
        long_stamp(F.col("start_ts"), tz).alias("bulk_start"),
        F.col("span_minutes").alias("elapsed_minutes"),
        F.col("current_temp_f").alias("last_temp_f"),
        F.col("age_minutes").alias("last_temp_age_minutes"),
        round_places(F.col("avg_temp_f"), 1).alias("avg_temp_f"),
        F.expr("cast(bround(est_rise_pct, 0) as bigint) as estimated_rise_pct"),
        F.expr("cast(bround(target_rise_pct, 0) as bigint) as target_rise_pct"),
    ]
    if meta:
        fields.append(
            F.struct(
                long_stamp(F.col("run_at"), tz).alias("run_at"),
                long_stamp(F.col("last_reading_at"), tz).alias("last_reading"),
                F.col("reading_count").alias("temperature_reading_count"),
                F.col("min_temp_f"),
                F.col("max_temp_f"),
                round_places(F.col("integral"), 4).alias("fermentation_integral"),
                F.col("reference_minutes").alias("reference_duration_minutes"),
                F.col("data_offset_minutes").alias("reference_offset_minutes"),
                F.col("data_offset_direction").alias("reference_offset_direction"),
            )
        )
        fields[-1] = F.when(F.col("reading_count") > 0, fields[-1]).alias("meta")
    fields.append(_message().alias("message"))
    return offsets.select("session_id", F.struct(*fields).alias("payload"))


def progress_json(offsets: DataFrame, meta: bool = True) -> DataFrame:
    """``session_id`` and ``json``, one JSON object per session; fields without a value are left out."""
    return payload(offsets, meta).select("session_id", F.to_json("payload").alias("json"))


def _row(label: Column | str, value: Column) -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    return F.struct(name.alias("label"), value.alias("value"))


def _with_lines(rows: Column) -> Column:
    """Adds ``line``: the label with a colon, padded to the longest one, and the value."""
    width = F.array_max(F.transform(rows, lambda r: F.length(r["label"]))) + 1
    return F.transform(
        rows,
        lambda r: F.struct(
            r["label"].alias("label"),
            r["value"].alias("value"),
            F.concat(
                F.rpad(F.concat(r["label"], F.lit(":")), width, " "), F.lit("  "), r["value"]
            ).alias("line"),
        ),
    )


def report_sections(offsets: DataFrame) -> DataFrame:
    """``session_id`` with the row arrays ``primary`` and ``meta`` of its text report.

    A session without readings has none of them, but a ``message``.
    """
    # The labels and their order.
    tz = F.col("tz")
    start, last = F.col("start_ts"), F.col("last_reading_at")
    degrees = F.lit("°F")
    texts = offsets.select(
        "*",
        _message().alias("message"),
        fixed_text(F.col("avg_temp_f"), 1).alias("_avg"),
        F.concat(
            fixed_text(F.col("min_temp_f"), 1),
            F.lit("–"),
            fixed_text(F.col("max_temp_f"), 1),
            F.lit("°F ("),
            fixed_text(F.expr("max_temp_f - min_temp_f"), 1),
            F.lit("°F)"),
        ).alias("_range"),
    )

    def offset(name: str) -> Column:
        return F.concat(
            hours_minutes(F.col(f"{name}_offset_minutes")),
            F.lit(" "),
            F.col(f"{name}_offset_direction"),
        )

    volume = F.concat(
        fixed_text(F.col("volume_ml"), 0),
        F.lit(" rises to "),
        fixed_text(F.col("target_volume_ml"), 0),
        F.lit(" mL"),
    )
    primary = F.array(
        _row("bulk start", F.concat(long_stamp(start, tz), F.lit(" "), tz)),
        _row("elapsed", hours_minutes(F.col("wall_minutes"))),
        _row("data elapsed", hours_minutes(F.col("data_minutes"))),
        _row(
            F.concat(F.lit("temp ("), age_text(F.col("age_minutes")), F.lit(")")),
            F.concat(fixed_text(F.col("current_temp_f"), 1), degrees),
        ),
        _row("avg temp", F.concat(F.col("_avg"), degrees)),
        _row("temp range", F.col("_range")),
        _row("est. rise", F.concat(fixed_text(F.col("est_rise_pct"), 0), F.lit("%"))),
        _row("target rise", F.concat(fixed_text(F.col("target_rise_pct"), 1), F.lit("%"))),
        _row("target volume", volume),
    )
    # without a volume the last row is left out
    primary = F.slice(primary, 1, F.when(F.col("volume_ml").isNull(), 8).otherwise(9))
    meta = F.array(
        _row("run at", short_stamp(F.col("run_at"), tz)),
        _row("bulk start", short_stamp(start, tz)),
        _row("last reading", short_stamp(last, tz)),
        _row("readings", F.col("reading_count").cast("string")),
        _row("temp range", F.col("_range")),
        _row("integral", fixed_text(F.col("integral"), 4)),
        _row(
            "ref. duration",
            F.concat(
                hours_minutes(F.col("reference_minutes")),
                F.lit(" (author's estimate at "),
                F.col("_avg"),
                F.lit("°F)"),
            ),
        ),
        _row("ref. end time", short_stamp(F.col("reference_end"), tz)),
        _row("ref. offset (data)", offset("data")),
        _row("ref. offset (wall)", offset("wall")),
    )
    said = F.col("message").isNull()
    bare = texts.select(
        "session_id",
        "message",
        F.when(said, primary).alias("primary"),
        F.when(said, meta).alias("meta"),
    )
    return bare.select(
        "session_id",
        "message",
        _with_lines(F.col("primary")).alias("primary"),
        _with_lines(F.col("meta")).alias("meta"),
    )


def report_rows(offsets: DataFrame, meta: bool = True) -> DataFrame:
    """One row per line: ``session_id``, ``section``, ``ord``, ``label``, ``value``, ``line``.

    A session without readings has one line, in the section ``message``.
    """
    sections = ["primary", "meta"] if meta else ["primary"]
    found = report_sections(offsets)
    named = F.array(
        *[F.struct(F.lit(s).alias("section"), F.col(s).alias("rows")) for s in sections]
    )
    line = F.struct(
        F.lit("message").alias("label"), F.col("message").alias("value"), F.col("message").alias("line")
    )
    alone = F.array(F.struct(F.lit("message").alias("section"), F.array(line).alias("rows")))
    named = F.when(F.col("message").isNull(), named).otherwise(alone)
    split = found.select("session_id", F.inline(named))
    return split.select("session_id", "section", F.posexplode("rows")).select(
        "session_id",
        "section",
        (F.col("pos") + 1).cast("bigint").alias("ord"),
        "col.label",
        "col.value",
        "col.line",
    )


def report_text(offsets: DataFrame, meta: bool = True) -> DataFrame:
    """``session_id`` and its whole report as ``text``, the sections parted by an empty line.

    The text of a session without readings is its message.
    """
    parts = ["primary", "meta"] if meta else ["primary"]
    blocks = [F.array_join(F.col(p)["line"], "\n") for p in parts]
    return report_sections(offsets).select(
        "session_id", F.coalesce("message", F.concat_ws("\n\n", *blocks)).alias("text")
    )
