"""Reference profiles: expected hours and target rise by temperature."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROFILE_SCHEMA = "profile string, temp_f double, hours double, target_rise_pct double"

# The dough guide as (temp_f, hours, target_rise_pct).
DOUGH_KNOTS = (
    (65.0, 16.0, 100.0),
    (66.0, 16.0, 95.0),
    (67.0, 15.0, 90.0),
    (68.0, 14.0, 85.0),
    (69.0, 13.0, 80.0),
    (70.0, 12.0, 75.0),
    (71.0, 11.0, 70.0),
    (72.0, 10.0, 65.0),
    (73.0, 9.0, 60.0),
    (74.0, 8.0, 55.0),
    (75.0, 7.0, 50.0),
    (76.0, 7.0, 50.0),
    (77.0, 6.0, 40.0),
    (78.0, 6.0, 40.0),
    (79.0, 5.5, 30.0),
    (80.0, 5.5, 30.0),
)


@dataclass(frozen=True)
class Profile:
    """What ferments, as data: knots ``(temp_f, hours, target_rise_pct)``, rising by temperature."""

    name: str
    knots: tuple[tuple[float, float, float], ...]

    def __post_init__(self) -> None:
        temps = [k[0] for k in self.knots]
        if not temps or temps != sorted(set(temps)):
            raise ValueError("a profile needs knots with rising temperatures")

    def expected_hours(self, temp: str) -> Column:
        """Hours at the temperature that the SQL expression ``temp`` gives."""
        return F.expr(self._interpolate(temp, 1))

    def target_rise_pct(self, temp: str) -> Column:
        return F.expr(self._interpolate(temp, 2))

    def _interpolate(self, temp: str, field: int) -> str:
        """Linear between knots, constant outside. NaN counts as above the last knot."""
        first, last = self.knots[0][0], self.knots[-1][0]
        # greatest and least pass over nulls; the rest stays outside of any branch, so that the
        # generated code works out repeated parts once
        clamped = f"if({temp} is null, null, greatest({_sql(first)}, least({_sql(last)}, {temp})))"
        points = [(k[0], k[field]) for k in self.knots]
        inside = _by_position if _evenly_spaced(points) else _between
        return inside(clamped, points)


DOUGH = Profile("dough", DOUGH_KNOTS)


def _evenly_spaced(points: Sequence[tuple[float, float]]) -> bool:
    """Whether a knot's temperature follows exactly from its position."""
    if len(points) < 2:
        return False
    first, step = points[0][0], points[1][0] - points[0][0]
    (_, before), (_, top) = points[-2:]
    return before + (top - before) == top and all(
        t == first + i * step for i, (t, _) in enumerate(points)
    )


def _sql(number: float) -> str:
    return f"{float(number)!r}D"


def _by_position(temp: str, points: Sequence[tuple[float, float]]) -> str:
    """For evenly spaced knots: the segment's number is computed, not searched for."""
    first, step = points[0][0], points[1][0] - points[0][0]
    values = f"array({', '.join(_sql(v) for _, v in points)})"
    at = f"least(int(floor(({temp} - {_sql(first)}) / {_sql(step)})), {len(points) - 2})"
    low, high = f"get({values}, {at})", f"get({values}, {at} + 1)"
    share = f"({temp} - ({_sql(first)} + {at} * {_sql(step)})) / {_sql(step)}"
    return f"{low} + {share} * ({high} - {low})"


def _between(temp: str, points: Sequence[tuple[float, float]]) -> str:
    """A balanced tree of comparisons, so that a row passes log2 of the segments, not all."""
    if len(points) == 1:
        return f"if({temp} is null, null, {_sql(points[0][1])})"
    if len(points) == 2:
        (t0, v0), (t1, v1) = points
        share = f"({temp} - {_sql(t0)}) / {_sql(t1 - t0)}"
        inside = f"{_sql(v0)} + {share} * {_sql(v1 - v0)}"
        return f"case when {temp} = {_sql(t1)} then {_sql(v1)} else {inside} end"
    middle = len(points) // 2
    below, above = _between(temp, points[: middle + 1]), _between(temp, points[middle:])
    # an unknown temperature falls through to the last segment, whose arithmetic gives null
    return f"case when {temp} < {_sql(points[middle][0])} then {below} else {above} end"


def with_profile_values(
    rows: DataFrame, profiles: Sequence[Profile], temp: str, hours: str, rise: str
) -> DataFrame:
    """Adds the columns ``hours`` and ``rise`` of the profile named in each row's ``profile``.

    Null for a name that is not given.
    """
    looked_up, names = {}, []
    for i, p in enumerate(profiles):
        looked_up[f"_hours_{i}"] = p.expected_hours(temp)
        looked_up[f"_rise_{i}"] = p.target_rise_pct(temp)
        names.append(F.col("profile") == p.name)
    return (
        rows.withColumns(looked_up)
        .withColumns(
            {
                hours: F.coalesce(*[F.when(c, F.col(f"_hours_{i}")) for i, c in enumerate(names)]),
                rise: F.coalesce(*[F.when(c, F.col(f"_rise_{i}")) for i, c in enumerate(names)]),
            }
        )
        .drop(*looked_up)
    )


def reference_profile(spark: SparkSession, profiles: Sequence[Profile] = (DOUGH,)) -> DataFrame:
    """The knots as a table."""
    rows = [(p.name, *k) for p in profiles for k in p.knots]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def interpolate_by_table(
    rows: DataFrame, knots: DataFrame, temp: str = "temperature_f", broadcast_limit: int = 10_000
) -> DataFrame:
    """Adds ``expected_hours`` and ``target_rise_pct`` from a table of knots, joined by ``profile``.

    For profiles kept in a table instead of in code. Segments become rows per whole degree. Their number
    is counted; few are broadcast and joined on (profile, degree) beside the range. A larger table is
    merged as of the temperature: rows and segments of a (profile, degree) are sorted together, and a row
    takes the last segment before it, however many there are. Of the keys, those with more than a
    hundredth of all rows (at most a hundred) are counted out; their rows are dealt by a hash over as many
    parts as hold a hundredth, and their segments go to each part.
    """
    extent = knots.agg(F.floor(F.min("temp_f")), F.floor(F.max("temp_f"))).first()
    coldest, hottest = (extent[0] or 0), (extent[1] or 0)
    by_temp = Window.partitionBy("profile").orderBy("temp_f")
    whole = Window.partitionBy("profile")
    segments = (
        knots.select(
            "profile",
            F.col("temp_f").alias("t0"),
            F.col("hours").alias("h0"),
            F.col("target_rise_pct").alias("r0"),
            F.lead("temp_f").over(by_temp).alias("t1"),
            F.lead("hours").over(by_temp).alias("h1"),
            F.lead("target_rise_pct").over(by_temp).alias("r1"),
            F.min("temp_f").over(whole).alias("low"),
            F.max("temp_f").over(whole).alias("high"),
        )
        # the last knot is no segment, unless it is the only one
        .filter("t1 is not null or low = high")
        .withColumns({"lowest": F.expr("t0 = low"), "highest": F.expr("coalesce(t1, t0) = high")})
        .withColumn(
            "slot",
            F.expr(
                f"""explode(sequence(if(lowest, {coldest}L, floor(t0)),
                                     if(highest, {hottest}L, floor(t1))))"""
            ),
        )
    )
    few = segments.limit(broadcast_limit + 1).count() <= broadcast_limit
    keyed = rows.withColumn(
        "slot",
        F.expr(
            f"if({temp} is null, null,"
            f" floor(greatest({_sql(coldest)}, least({_sql(hottest)}, {temp}))))"
        ),
    )
    if few:
        inside = F.expr(f"(lowest or k.{temp} >= t0) and (highest or k.{temp} < t1)")
        joined = keyed.alias("k").join(
            F.broadcast(segments).alias("s"),
            (F.col("k.profile") == F.col("s.profile")) & (F.col("k.slot") == F.col("s.slot")) & inside,
            "left",
        )
    else:
        joined = _merged_as_of(keyed, segments, temp).alias("k")
    clamped = f"greatest(low, least(high, k.{temp}))"
    share = f"coalesce(({clamped} - t0) / (t1 - t0), 0D)"

    def between(first: str, second: str) -> Column:
        return F.expr(
            f"if({clamped} = t1, {second}, {first} + coalesce({share} * ({second} - {first}), 0D))"
        )

    return joined.select(
        *[F.col("k." + c).alias(c) for c in rows.columns],
        between("h0", "h1").alias("expected_hours"),
        between("r0", "r1").alias("target_rise_pct"),
    )


_SEGMENT = ("t0", "h0", "r0", "t1", "h1", "r1", "low", "high")


def _merged_as_of(keyed: DataFrame, segments: DataFrame, temp: str, share: int = 100) -> DataFrame:
    """``keyed`` with the columns of the last segment of its profile and slot that begins at or below ``temp``."""
    counts = keyed.filter("profile is not null and slot is not null").groupBy("profile", "slot").agg(F.expr("count(1) as n"))
    limit = max(1, keyed.count() // share)
    hot = counts.filter(F.col("n") > limit).selectExpr("profile", "slot", f"cast(ceil(n / {limit}) as int) as parts").collect()
    parts = F.broadcast(
        keyed.sparkSession.createDataFrame(hot, "profile string, slot bigint, parts int").withColumnsRenamed({"profile": "_p", "slot": "_s"})
    )
    of_key = (F.col("profile") == F.col("_p")) & (F.col("slot") == F.col("_s"))
    dealt = keyed.join(parts, of_key, "left").withColumn(
        "_part", F.pmod(F.xxhash64(*keyed.columns), F.coalesce("parts", F.lit(1)))
    )
    lookups = dealt.drop("_p", "_s", "parts").withColumns(
        {"_key": F.col(temp), "_row": F.lit(1), "_segment": F.lit(None).cast(_segment_of(segments))}
    )
    begins = segments.join(parts, of_key, "left").select(
        "profile",
        "slot",
        F.expr("explode(sequence(0L, coalesce(parts, 1) - 1L))").alias("_part"),
        F.expr("if(lowest, double('-Infinity'), t0)").alias("_key"),
        F.lit(0).alias("_row"),
        F.struct(*_SEGMENT).alias("_segment"),
    )
    known = lookups.filter("profile is not null and slot is not null")
    along = (
        Window.partitionBy("profile", "slot", "_part")
        .orderBy("_key", "_row")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        known.unionByName(begins, allowMissingColumns=True)
        .withColumn("_segment", F.last("_segment", ignorenulls=True).over(along))
        .filter("_row = 1")
    )
    rest = lookups.filter("profile is null or slot is null")
    return placed.unionByName(rest).select(*keyed.columns, *[F.col(f"_segment.{c}").alias(c) for c in _SEGMENT])


def _segment_of(segments: DataFrame) -> str:
    return segments.select(F.struct(*_SEGMENT).alias("s")).schema["s"].dataType.simpleString()
