"""The registered queries in plain SQL (DuckDB dialect), written from their definitions.

They share nothing with the operators but the fixed values: windows run over whole series and
joins are taken literally.
"""

from __future__ import annotations

from proofspark.functions.profile import DOUGH_KNOTS
from proofspark.plans.catalog import AS_OF, GAP_MINUTES, SAMPLE_DATE, SINCE, UNTIL

_KNOTS = ", ".join(f"({t}::DOUBLE, {h}::DOUBLE, {r}::DOUBLE)" for t, h, r in DOUGH_KNOTS)

_CTES = {
    "readings": """
        SELECT user_id AS sensor_id, event_id AS reading_id, ts AS datetime,
               CASE WHEN event_type = 'error' THEN NULL ELSE 62.0::DOUBLE + value / 5.0::DOUBLE END
                   AS temperature_f
        FROM events""",
    "r": "SELECT * FROM readings WHERE temperature_f IS NOT NULL",
    "sessions": """
        SELECT event_id AS session_id, user_id AS sensor_id, ts AS start_ts,
               CASE CAST(event_id % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '84h'
                    WHEN 2 THEN '3D12H' WHEN 3 THEN '5pm' ELSE '2024-01-20 20:00' END AS end_spec,
               1000.0::DOUBLE AS volume_ml
        FROM events WHERE event_type = 'signup'""",
    "zoned_sessions": """
        SELECT event_id AS session_id, ts AS start_ts, CASE CAST(event_id % 4 AS INT)
                   WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'Asia/Kolkata'
                   WHEN 2 THEN 'Australia/Lord_Howe' ELSE 'UTC' END AS zone,
               CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '17:30' WHEN 1 THEN '02:15' ELSE '23:59' END AS end_spec
        FROM events WHERE event_type = 'signup'""",
    "durations": """
        SELECT *, CASE
            WHEN regexp_full_match(upper(trim(end_spec)), '([0-9]+D)?([0-9]+H)?([0-9]+M)?')
                 AND trim(end_spec) <> ''
            THEN coalesce(try_cast(regexp_extract(upper(end_spec), '([0-9]+)D', 1) AS BIGINT), 0)
                     * 86400
               + coalesce(try_cast(regexp_extract(upper(end_spec), '([0-9]+)H', 1) AS BIGINT), 0)
                     * 3600
               + coalesce(try_cast(regexp_extract(upper(end_spec), '([0-9]+)M', 1) AS BIGINT), 0)
                     * 60 END AS duration_s
        FROM sessions""",
    "clocked": """
        SELECT *, coalesce(
            try_strptime(strftime(start_ts, '%Y-%m-%d') || ' ' || upper(end_spec),
                         '%Y-%m-%d %I%p'),
            try_strptime(end_spec, '%Y-%m-%d %H:%M')) AS clock_end
        FROM durations""",
    "bounds": """
        SELECT *, CASE WHEN duration_s IS NOT NULL THEN start_ts + to_seconds(duration_s)
                       WHEN clock_end < start_ts THEN clock_end + INTERVAL 1 DAY
                       ELSE clock_end END AS end_ts
        FROM clocked""",
    "knots": f"SELECT * FROM (VALUES {_KNOTS}) AS k(temp_f, hours, rise)",
    "segments": """
        SELECT temp_f AS t0, hours AS h0, rise AS r0,
               lead(temp_f) OVER (ORDER BY temp_f) AS t1,
               lead(hours) OVER (ORDER BY temp_f) AS h1,
               lead(rise) OVER (ORDER BY temp_f) AS r1
        FROM knots""",
    "profiled": """
        SELECT r.*, CASE WHEN t1 IS NULL THEN h0
                    ELSE h0 + (c - t0) / (t1 - t0) * (h1 - h0) END AS expected_hours,
               CASE WHEN t1 IS NULL THEN r0
                    ELSE r0 + (c - t0) / (t1 - t0) * (r1 - r0) END AS target_rise_pct
        FROM (SELECT *, greatest(65.0::DOUBLE, least(80.0::DOUBLE, temperature_f)) AS c FROM r) r
        JOIN segments ON c >= t0 AND (c < t1 OR t1 IS NULL)""",
    "in_session": """
        SELECT session_id, datetime, reading_id, temperature_f, expected_hours,
               coalesce(date_sub('second', lag(datetime) OVER w, datetime), 0) AS secs
        FROM bounds b JOIN profiled p
          ON p.sensor_id = b.sensor_id AND datetime >= start_ts
         AND (end_ts IS NULL OR datetime <= end_ts)
        WINDOW w AS (PARTITION BY session_id ORDER BY datetime, reading_id)""",
    "summed": """
        SELECT session_id, count(*) AS n, CAST(sum(secs) AS BIGINT) AS total,
               sum(temperature_f * secs) AS heat,
               sum(secs / 3600.0::DOUBLE / expected_hours) AS integral,
               first(temperature_f ORDER BY datetime, reading_id) AS first_temp,
               last(temperature_f ORDER BY datetime, reading_id) AS current_temp_f,
               max(datetime) AS last_reading_at,
               min(temperature_f) AS min_temp_f, max(temperature_f) AS max_temp_f
        FROM in_session GROUP BY session_id""",
    "averaged": """
        SELECT *, CASE WHEN total = 0 THEN first_temp ELSE heat / total END AS avg_temp_f
        FROM summed""",
    "looked_up": """
        SELECT a.*, CASE WHEN t1 IS NULL THEN h0
                    ELSE h0 + (c - t0) / (t1 - t0) * (h1 - h0) END AS ref_hours,
               CASE WHEN t1 IS NULL THEN r0
                    ELSE r0 + (c - t0) / (t1 - t0) * (r1 - r0) END AS target
        FROM (SELECT *, greatest(65.0::DOUBLE, least(80.0::DOUBLE, avg_temp_f)) AS c
              FROM averaged) a
        JOIN segments ON c >= t0 AND (c < t1 OR t1 IS NULL)""",
    "progress": f"""
        SELECT b.session_id, b.sensor_id, b.start_ts, b.end_ts, b.volume_ml,
               CASE WHEN n IS NULL THEN 'no_readings' ELSE 'ok' END AS status,
               total / 3600.0::DOUBLE AS elapsed_hours, avg_temp_f, current_temp_f,
               last_reading_at, target AS target_rise_pct,
               least(integral * target, target) AS est_rise_pct, coalesce(n, 0) AS reading_count,
               min_temp_f, max_temp_f, integral, ref_hours,
               TIMESTAMP '{AS_OF}' AS as_of
        FROM bounds b LEFT JOIN looked_up l USING (session_id)""",
    "timed": """
        SELECT *,
            CAST(round_even(date_diff('microsecond', start_ts, coalesce(end_ts, as_of))
                 / 60000000.0::DOUBLE, 0) AS BIGINT) AS wall_minutes,
            CAST(round_even(date_diff('microsecond', start_ts, last_reading_at)
                 / 60000000.0::DOUBLE, 0) AS BIGINT) AS data_minutes,
            CAST(round_even(elapsed_hours * 60, 0) AS BIGINT) AS span_minutes,
            CAST(round_even(date_diff('microsecond', last_reading_at, as_of)
                 / 60000000.0::DOUBLE, 0) AS BIGINT) AS age_minutes,
            CAST(round_even(ref_hours * 60, 0) AS BIGINT) AS reference_minutes,
            start_ts + to_microseconds(CAST(round(ref_hours * 3600000000.0::DOUBLE) AS BIGINT))
                AS ref_end,
            volume_ml * (1 + target_rise_pct / 100) AS target_volume_ml
        FROM progress""",
    "offsets": """
        SELECT *,
            CAST(abs(round_even((ref_hours - elapsed_hours) * 60, 0)) AS BIGINT)
                AS data_offset_minutes,
            CASE WHEN ref_hours IS NULL THEN NULL WHEN elapsed_hours < ref_hours THEN 'under'
                 ELSE 'over' END AS data_offset_direction,
            CAST(abs(round_even((ref_hours - wall_minutes / 60.0::DOUBLE) * 60, 0)) AS BIGINT)
                AS wall_offset_minutes,
            CASE WHEN ref_hours IS NULL THEN NULL
                 WHEN wall_minutes / 60.0::DOUBLE < ref_hours THEN 'under'
                 ELSE 'over' END AS wall_offset_direction
        FROM timed""",
    "d": """
        SELECT *, temperature_f - lag(temperature_f) OVER w AS temp_delta,
               lag(datetime) OVER w AS prev_dt, lag(temperature_f) OVER w AS prev_temp
        FROM r WINDOW w AS (PARTITION BY sensor_id ORDER BY datetime, reading_id)""",
    "counted": """
        SELECT CAST(round_even(temperature_f, 0) AS BIGINT) AS temp_rounded, count(*) AS "count"
        FROM r GROUP BY 1""",
    "flagged": f"""
        SELECT *, temperature_f >= 82 AND (prev_temp IS NULL OR prev_temp < 82
                  OR datetime - prev_dt > INTERVAL {GAP_MINUTES} MINUTE) AS opens
        FROM d""",
    "numbered": """
        SELECT *, sum(CAST(opens AS INT)) OVER
            (PARTITION BY sensor_id ORDER BY datetime, reading_id) AS episode
        FROM flagged""",
    "runs": """
        SELECT sensor_id, min(datetime) AS start, max(datetime) AS "end",
               date_sub('minute', min(datetime), max(datetime)) AS duration_min,
               count(*) AS readings, max(temperature_f) AS peak_temp,
               median(temperature_f) AS median_temp
        FROM numbered WHERE temperature_f >= 82 GROUP BY sensor_id, episode""",
    "sustained": """
        SELECT *, CASE WHEN peak_temp < 90 THEN 'proofing' ELSE 'oven' END AS class
        FROM runs WHERE duration_min >= 10""",
}


def _sql(last: str, *needed: str) -> str:
    """``last`` with the common table expressions it names, and those they name."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for other in _USES.get(name, ()):
            want(other)
        if name not in wanted:
            wanted.append(name)

    for name in needed:
        want(name)
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in wanted)
    return f"WITH {ctes}\n{last}"


_USES = {
    "r": ("readings",),
    "durations": ("sessions",),
    "clocked": ("durations",),
    "bounds": ("clocked",),
    "segments": ("knots",),
    "profiled": ("r", "segments"),
    "in_session": ("bounds", "profiled"),
    "summed": ("in_session",),
    "averaged": ("summed",),
    "looked_up": ("averaged", "segments"),
    "progress": ("bounds", "looked_up"),
    "timed": ("progress",),
    "offsets": ("timed",),
    "d": ("r",),
    "counted": ("r",),
    "flagged": ("d",),
    "numbered": ("flagged",),
    "runs": ("numbered",),
    "sustained": ("runs",),
}


def _r6(name: str, alias: str | None = None) -> str:
    return f'round({name}, 6) AS "{alias or name}"'


_LONG, _SHORT = "'%Y-%m-%d %a %-I:%M %p'", "'%m-%d %a %-I:%M %p'"


def _hm(minutes: str) -> str:
    whole = f"CAST(floor({minutes} / 60.0::DOUBLE) AS BIGINT)"
    rest = f"({minutes} - 60 * {whole})"
    return f"({whole} || 'h' || CASE WHEN {rest} = 0 THEN '' ELSE {rest} || 'm' END)"


def _fixed(value: str, places: int) -> str:
    return f"printf('%.{places}f', {value})"


_RANGE = (
    f"{_fixed('min_temp_f', 1)} || '–' || {_fixed('max_temp_f', 1)} || '°F ('"
    f" || {_fixed('max_temp_f - min_temp_f', 1)} || '°F)'"
)
_AGE = (
    "CASE WHEN age_minutes >= 60 THEN printf('%dh%2dm ago', age_minutes // 60, age_minutes % 60)"
    " ELSE age_minutes || 'm ago' END"
)
_REPORT = {
    "primary": [
        ("'bulk start'", f"strftime(start_ts, {_LONG}) || ' UTC'"),
        ("'elapsed'", _hm("wall_minutes")),
        ("'data elapsed'", _hm("data_minutes")),
        (f"'temp (' || {_AGE} || ')'", f"{_fixed('current_temp_f', 1)} || '°F'"),
        ("'avg temp'", f"{_fixed('avg_temp_f', 1)} || '°F'"),
        ("'temp range'", _RANGE),
        ("'est. rise'", f"{_fixed('est_rise_pct', 0)} || '%'"),
        ("'target rise'", f"{_fixed('target_rise_pct', 1)} || '%'"),
        (
            "'target volume'",
            f"{_fixed('volume_ml', 0)} || ' rises to ' || {_fixed('target_volume_ml', 0)}"
            " || ' mL'",
        ),
    ],
    "meta": [
        ("'run at'", f"strftime(as_of, {_SHORT})"),
        ("'bulk start'", f"strftime(start_ts, {_SHORT})"),
        ("'last reading'", f"strftime(last_reading_at, {_SHORT})"),
        ("'readings'", "CAST(reading_count AS VARCHAR)"),
        ("'temp range'", _RANGE),
        ("'integral'", _fixed("integral", 4)),
        (
            "'ref. duration'",
            f"{_hm('reference_minutes')} || ' (author''s estimate at '"
            f" || {_fixed('avg_temp_f', 1)} || '°F)'",
        ),
        ("'ref. end time'", f"strftime(ref_end, {_SHORT})"),
        (
            "'ref. offset (data)'",
            f"{_hm('data_offset_minutes')} || ' ' || data_offset_direction",
        ),
        (
            "'ref. offset (wall)'",
            f"{_hm('wall_offset_minutes')} || ' ' || wall_offset_direction",
        ),
    ],
}
_MESSAGE = f"'no sensor readings found since ' || strftime(start_ts, {_LONG}) || ' UTC'"
_REPORT_ROWS = " UNION ALL ".join(
    f"SELECT session_id, '{section}' AS section, CAST({i + 1} AS BIGINT) AS ord,"
    f" {label} AS label, {value} AS value FROM offsets WHERE reading_count > 0"
    for section, rows in _REPORT.items()
    for i, (label, value) in enumerate(rows)
)
_REPORT_LINES = f"""
    SELECT *, rpad(label || ':',
                   CAST(max(length(label)) OVER (PARTITION BY session_id, section) + 1 AS INT), ' ')
              || '  ' || value AS line
    FROM ({_REPORT_ROWS})
    UNION ALL
    SELECT session_id, 'message', 1, 'message', {_MESSAGE}, {_MESSAGE} FROM offsets WHERE reading_count = 0"""


def _describe(measure: str, value: str, source: str, linear: bool = False) -> str:
    """Summary rows of a column; quartiles by nearest rank or linear."""
    rows = [
        ("count", f"CAST(count({value}) AS DOUBLE)"),
        ("null_count", f"CAST(count(*) FILTER ({value} IS NULL) AS DOUBLE)"),
        ("mean", f"avg({value})"),
        ("std", f"stddev_samp({value})"),
        ("min", f"CAST(min({value}) AS DOUBLE)"),
        ("max", f"CAST(max({value}) AS DOUBLE)"),
    ]
    for q in (0.25, 0.5, 0.75):
        nearest = (
            f"CAST(list_sort(list({value}))[CAST(round({q}::DOUBLE * (count({value}) - 1))"
            " AS BIGINT) + 1] AS DOUBLE)"
        )
        rows.append((f"{q:.0%}", f"quantile_cont({value}, {q})" if linear else nearest))
    return " UNION ALL ".join(
        f"SELECT '{measure}' AS measure, '{name}' AS statistic,"
        f" round({expr}, 6) AS value FROM {source}"
        for name, expr in rows
    )


def _mode_per(parts: dict[str, str]) -> str:
    names = ", ".join(parts)
    keys = ", ".join(f'CAST({e} AS BIGINT) AS "{n}"' for n, e in parts.items())
    return f"""
        SELECT {names}, temp_rounded AS most_common_temp, n AS "count" FROM (
            SELECT *, row_number() OVER (PARTITION BY {names} ORDER BY n DESC, temp_rounded) AS nth
            FROM (SELECT {keys}, CAST(round_even(temperature_f, 0) AS BIGINT) AS temp_rounded,
                         count(*) AS n
                  FROM r GROUP BY ALL))
        WHERE nth = 1"""


_DELTA = f"""
    SELECT sensor_id, reading_id, datetime, {_r6("temperature_f")}, {_r6("temp_delta")},
           date_sub('second', prev_dt, datetime) AS time_delta_s
    FROM d"""
_FIRST_30 = " ORDER BY datetime, sensor_id, reading_id LIMIT 30"
_SESSION = f"""
    sensor_id, start, "end", duration_min, readings, {_r6("peak_temp")}, {_r6("median_temp")}"""

_INTERPOLATED = f"""
    SELECT reading_id, {_r6("temperature_f")}, {_r6("expected_hours")}, {_r6("target_rise_pct")}
    FROM profiled"""

ORACLE_SQL: dict[str, str] = {
    "readings_since": _sql(
        f"""SELECT sensor_id, reading_id, datetime, {_r6("temperature_f")} FROM r
            WHERE datetime >= TIMESTAMP '{SINCE}' AND datetime <= TIMESTAMP '{UNTIL}'
            ORDER BY datetime, sensor_id, reading_id""",
        "r",
    ),
    "interpolate_profile": _sql(_INTERPOLATED, "profiled"),
    "interpolate_profile_table": _sql(_INTERPOLATED, "profiled"),
    "duration_parse": _sql("SELECT session_id, end_spec, duration_s FROM durations", "durations"),
    "session_bounds": _sql(
        """SELECT session_id, sensor_id, start_ts, end_ts,
                  CASE WHEN end_spec <> '' AND end_ts IS NULL THEN 'bad_end' ELSE 'ok' END AS status
           FROM bounds""",
        "bounds",
    ),
    "session_bounds_zoned": _sql(
        """SELECT session_id, zone, start_ts, local_start, CASE
                      WHEN end_utc < start_ts THEN timezone('UTC', timezone(zone, local_end + INTERVAL 1 DAY))
                      ELSE end_utc END AS end_ts
           FROM (SELECT *, timezone('UTC', timezone(zone, local_end)) AS end_utc
                 FROM (SELECT *, try_strptime(strftime(local_start, '%Y-%m-%d') || ' ' || end_spec, '%Y-%m-%d %H:%M')
                           AS local_end
                       FROM (SELECT *, timezone(zone, timezone('UTC', start_ts)) AS local_start
                             FROM zoned_sessions)))""",
        "zoned_sessions",
    ),
    "sample_dates": _sql(
        f"""SELECT sensor_id, reading_id, datetime, {_r6("temperature_f")} FROM r
            WHERE CAST(datetime AS DATE) = DATE '{SAMPLE_DATE}'""",
        "r",
    ),
    "session_progress": _sql(
        f"""SELECT session_id, sensor_id, start_ts, end_ts, status, {_r6("elapsed_hours")},
                   {_r6("avg_temp_f")}, {_r6("current_temp_f")}, last_reading_at,
                   {_r6("target_rise_pct")}, {_r6("est_rise_pct")}, reading_count,
                   {_r6("min_temp_f")}, {_r6("max_temp_f")}, {_r6("integral")},
                   {_r6("ref_hours", "reference_hours")}
            FROM progress""",
        "progress",
    ),
    "progress_elapsed_offsets": _sql(
        f"""SELECT session_id, wall_minutes, data_minutes, span_minutes, age_minutes,
                   reference_minutes, strftime(ref_end, '%Y-%m-%d %H:%M') AS reference_end,
                   {_r6("target_volume_ml")}, data_offset_minutes, data_offset_direction,
                   wall_offset_minutes, wall_offset_direction
            FROM offsets""",
        "offsets",
    ),
    "progress_json": _sql(
        f"""SELECT session_id, strftime(start_ts, {_LONG}) AS bulk_start,
                   span_minutes AS elapsed_minutes, {_r6("current_temp_f", "last_temp_f")},
                   age_minutes AS last_temp_age_minutes,
                   CAST({_fixed("avg_temp_f", 1)} AS DOUBLE) AS avg_temp_f,
                   CAST(round_even(est_rise_pct, 0) AS BIGINT) AS estimated_rise_pct,
                   CAST(round_even(target_rise_pct, 0) AS BIGINT) AS target_rise_pct,
                   CASE WHEN reading_count > 0 THEN strftime(as_of, {_LONG}) END AS run_at,
                   strftime(last_reading_at, {_LONG}) AS last_reading,
                   nullif(reading_count, 0) AS temperature_reading_count,
                   {_r6("min_temp_f")}, {_r6("max_temp_f")},
                   CAST({_fixed("integral", 4)} AS DOUBLE) AS fermentation_integral,
                   reference_minutes AS reference_duration_minutes,
                   data_offset_minutes AS reference_offset_minutes,
                   data_offset_direction AS reference_offset_direction,
                   CASE WHEN reading_count = 0 THEN {_MESSAGE} END AS message
            FROM offsets""",
        "offsets",
    ),
    "progress_report": _sql(_REPORT_LINES, "offsets"),
    "progress_report_text": _sql(
        f"""SELECT session_id,
                   string_agg(line, chr(10) ORDER BY ord) FILTER (section = 'primary')
                   || chr(10) || chr(10)
                   || string_agg(line, chr(10) ORDER BY ord) FILTER (section = 'meta') AS text
            FROM ({_REPORT_LINES}) WHERE section <> 'message' GROUP BY session_id
            UNION ALL SELECT session_id, {_MESSAGE} FROM offsets WHERE reading_count = 0""",
        "offsets",
    ),
    "reading_counts": _sql(
        """SELECT count(*) AS total_rows, count(*) FILTER (temperature_f IS NULL) AS null_temps,
                  count(temperature_f) AS non_null_temps,
                  count(*) FILTER (temperature_f >= 85) AS hot_readings
           FROM readings""",
        "readings",
    ),
    "temp_frequency": _sql("SELECT * FROM counted", "counted"),
    "top_temps": _sql(
        'SELECT * FROM counted ORDER BY "count" DESC, temp_rounded LIMIT 20', "counted"
    ),
    "temp_mode": _sql(
        """SELECT temp_rounded AS mode_temp, "count" AS mode_count,
                  round(100.0::DOUBLE * "count" / (SELECT count(*) FROM r), 6) AS mode_pct
           FROM counted ORDER BY "count" DESC, temp_rounded LIMIT 1""",
        "counted",
    ),
    "hourly_mode": _sql(_mode_per({"hour": "hour(datetime)"}), "r"),
    "monthly_mode": _sql(_mode_per({"year": "year(datetime)", "month": "month(datetime)"}), "r"),
    "describe_temps": _sql(_describe("temperature_f", "temperature_f", "r"), "r"),
    "describe_temps_linear": _sql(_describe("temperature_f", "temperature_f", "r", True), "r"),
    "describe_deltas": _sql(
        _describe("temp_delta", "temp_delta", "(SELECT * FROM d WHERE temp_delta IS NOT NULL)"),
        "d",
    ),
    "describe_sessions": _sql(
        " UNION ALL ".join(
            _describe(c, c, "(SELECT * FROM sustained WHERE class = 'proofing')")
            for c in ("duration_min", "median_temp")
        ),
        "sustained",
    ),
    "temp_deltas": _sql(_DELTA, "d"),
    "temp_deltas_heavy_chunks": _sql(_DELTA, "d"),
    "spikes": _sql(_DELTA + " WHERE temp_delta >= 5", "d"),
    "first_spikes": _sql(_DELTA + " WHERE d.temp_delta >= 5" + _FIRST_30, "d"),
    "hot_readings": _sql(_DELTA + " WHERE d.temperature_f >= 85", "d"),
    "first_hot_readings": _sql(_DELTA + " WHERE d.temperature_f >= 85" + _FIRST_30, "d"),
    "spike_histogram": _sql(
        """SELECT CAST(round_even(temp_delta, 0) AS BIGINT) AS delta_bucket, count(*) AS "count"
           FROM d WHERE temp_delta >= 2 GROUP BY 1""",
        "d",
    ),
    "hot_transitions": _sql(
        """SELECT sensor_id,
                  count(*) FILTER (temperature_f >= 85 AND prev_temp < 85) AS episodes_starting,
                  count(*) FILTER (temperature_f < 85 AND prev_temp >= 85) AS episodes_ending
           FROM d GROUP BY sensor_id""",
        "d",
    ),
    "hot_episodes": _sql(
        f"""SELECT sensor_id, min(datetime) AS start, {_r6("max(temperature_f)", "peak_temp")},
                   CAST(round_even(date_diff('microsecond', min(datetime), max(datetime))
                        / 60000000.0::DOUBLE, 0) AS BIGINT) AS duration_min,
                   count(*) AS readings
            FROM (SELECT *, sum(CAST(temperature_f >= 85 AND (prev_temp IS NULL OR prev_temp < 85
                                OR datetime - prev_dt > INTERVAL {GAP_MINUTES} MINUTE) AS INT))
                            OVER (PARTITION BY sensor_id ORDER BY datetime, reading_id) AS run
                  FROM d)
            WHERE temperature_f >= 85 GROUP BY sensor_id, run
            HAVING bool_or(prev_temp < 85)""",
        "d",
    ),
    "hot_suffix_summary": _sql(
        f"""SELECT sensor_id, start, {_r6("max(temperature_f)", "peak_temp")},
                   CAST(round_even(date_diff('microsecond', min(datetime), max(datetime))
                        / 60000000.0::DOUBLE, 0) AS BIGINT) AS duration_min,
                   count(*) AS readings
            FROM (SELECT s.sensor_id, s.datetime AS start, h.datetime, h.temperature_f,
                         h.datetime - lag(h.datetime) OVER (PARTITION BY s.reading_id
                             ORDER BY h.datetime, h.reading_id) AS gap
                  FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id
                                                     ORDER BY datetime, reading_id) AS nth
                        FROM d WHERE temperature_f >= 85 AND prev_temp < 85) s
                  JOIN r h ON h.sensor_id = s.sensor_id AND h.datetime >= s.datetime
                          AND h.temperature_f >= 85
                  WHERE nth <= 10)
            WHERE gap IS NULL OR gap <= INTERVAL {GAP_MINUTES} MINUTE
            GROUP BY sensor_id, start""",
        "d",
    ),
    "hot_days": _sql(
        f"""SELECT strftime(datetime, '%Y-%m-%d') AS date, count(*) AS hot_readings,
                   {_r6("max(temperature_f)", "peak_temp")}
            FROM r WHERE temperature_f >= 85 GROUP BY 1
            ORDER BY hot_readings DESC, date LIMIT 20""",
        "r",
    ),
    "daily_summary": _sql(
        f"""SELECT sensor_id, strftime(datetime, '%Y-%m-%d') AS date, count(*) AS total_readings,
                   {_r6("max(temperature_f)", "peak_temp")},
                   {_r6("median(temperature_f)", "median_temp")}
            FROM r GROUP BY 1, 2""",
        "r",
    ),
    "cool_days": _sql(
        f"""SELECT sensor_id, strftime(datetime, '%Y-%m-%d') AS date, count(*) AS total_readings,
                   {_r6("max(temperature_f)", "peak_temp")},
                   {_r6("median(temperature_f)", "median_temp")}
            FROM r GROUP BY 1, 2 HAVING max(temperature_f) < 85""",
        "r",
    ),
    "cool_day_count": _sql(
        """SELECT count(*) AS days, count(*) FILTER (peak < 85) AS cool_days
           FROM (SELECT max(temperature_f) AS peak FROM r GROUP BY sensor_id, datetime::DATE)""",
        "r",
    ),
    "zone_breakdown": _sql(
        """SELECT zone, count(temperature_f) AS "count",
                  round(100.0::DOUBLE * count(temperature_f) / (SELECT count(*) FROM r), 6) AS pct
           FROM (VALUES ('ambient', '-inf'::DOUBLE, 82.0::DOUBLE),
                        ('elevated', 82.0::DOUBLE, 90.0::DOUBLE),
                        ('oven', 90.0::DOUBLE, 'inf'::DOUBLE)) AS z(zone, low, high)
           LEFT JOIN r ON temperature_f >= low AND temperature_f < high
           GROUP BY zone""",
        "r",
    ),
    "elevated_histogram": _sql(
        """SELECT CAST(round_even(temperature_f, 0) AS BIGINT) AS bucket, count(*) AS "count"
           FROM r WHERE temperature_f >= 82 AND temperature_f < 90 GROUP BY 1""",
        "r",
    ),
    "sustained_sessions": _sql(f"SELECT {_SESSION}, class FROM sustained", "sustained"),
    "proofing_sessions": _sql(
        f"SELECT {_SESSION} FROM sustained WHERE class = 'proofing'", "sustained"
    ),
    "oven_sessions": _sql(f"SELECT {_SESSION} FROM sustained WHERE class = 'oven'", "sustained"),
    "sample_day_10min": _sql(
        f"""SELECT sensor_id, time_bucket(INTERVAL 10 MINUTE, datetime) AS bucket,
                   {_r6("median(temperature_f)", "temp_f")}
            FROM r JOIN (SELECT sensor_id, CAST(min(start) AS DATE) AS day FROM sustained
                         WHERE class = 'proofing' GROUP BY sensor_id) USING (sensor_id)
            WHERE CAST(datetime AS DATE) = day
            GROUP BY 1, 2""",
        "sustained",
    ),
}
