"""Exact quantiles of groups of any size.

Groups that one task can sort are sorted there, after one exchange. Larger groups, and the columns of
``describe``, go by radix selection: a double has a whole number that sorts the same way, and four passes
of 16 bits each count how many values begin with which bits. A pass looks only at values that begin like
a wanted rank; these beginnings are few, are broadcast, and drop all other rows before any shuffle. What
is shuffled are counts, at most 65,536 a group, rank and pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASSES = (48, 32, 16, 0)
#: More rows than one task should sort.
LARGE_GROUP = 20_000_000
#: Rows that a single task sorts in no more time than the passes of a radix selection take.
FEW_ROWS = 1_000_000
MOST_LARGE = 100_000

Extra = tuple[Callable[[str], Column], str]


def with_order(rows: DataFrame, value: str, name: str = "_order") -> DataFrame:
    """Adds whole numbers in the order of a column of doubles: the bits of each, negated below zero.

    Zeros of both signs are equal and NaN is above all, as in Spark's own order. Spark has no function for
    a double's bits, so Java's is called; null stays null.
    """
    bits = f"if(`{value}` is null, null, bigint(java_method('java.lang.Double', 'doubleToLongBits', `{value}`)))"
    rows = rows.withColumn("_bits", F.expr(bits))
    return rows.withColumn(name, F.expr(f"if(_bits < 0, bigint({-(2**63)}) - _bits, _bits)")).drop("_bits")


def large_groups(rows: DataFrame, keys: list[str], limit: int = LARGE_GROUP) -> DataFrame | None:
    """The groups of more than ``limit`` rows, to be broadcast; None where there are none.

    Counts in a job of its own, combined before the shuffle. There can't be more such groups than rows
    divided by ``limit``; beyond 100,000 they are returned without a broadcast.
    """
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    seen = found.limit(MOST_LARGE + 1).collect()
    if not seen:
        return None
    if len(seen) > MOST_LARGE:
        return found
    return F.broadcast(rows.sparkSession.createDataFrame(seen, found.schema))


def grouped_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    wanted: Mapping[str, float],
    interpolation: str = "linear",
    extras: Mapping[str, Extra] | None = None,
    having: Callable[[], Column] | None = None,
    within: tuple[DataFrame, list[str]] | None = None,
    limit: int = LARGE_GROUP,
) -> DataFrame:
    """One row per group: ``keys``, ``n`` (values), the ``extras`` and one column per quantile.

    ``wanted`` maps column names to quantiles in [0, 1]. ``linear`` goes between the two ranks
    around ``q * (n - 1)``; ``nearest`` takes the rank ``round(q * (n - 1))``. ``extras`` maps
    names to (``F.min`` or ``F.max``, column). ``having`` is a condition on ``n`` and the extras.
    Rows without a value are ignored. Keys must not be null.

    Groups of more than ``limit`` rows are found by a count and go by radix selection. ``within`` names
    rows that are cheaper to count and the keys of groups that hold ours whole; where none of them is
    large, none of ours is.
    """
    extras, having = dict(extras or {}), having or (lambda: F.lit(True))
    valued = rows.filter(F.col(value).isNotNull())
    large = None
    if within is None or large_groups(*within, limit) is not None:
        large = large_groups(valued, keys, limit)
    if large is None:
        return _by_sorting(valued, keys, value, wanted, interpolation, extras).filter(having())
    small = valued.join(large, keys, "left_anti")
    rest = valued.join(large, keys, "left_semi")
    sums = rest.groupBy(*keys).agg(*[fn(c).alias(name) for name, (fn, c) in extras.items()], F.count(F.lit(1)).alias("n"))
    selected = radix_quantiles(rest.select(*keys, value), keys, value, wanted, interpolation).join(sums.drop("n"), keys)
    sorted_ = _by_sorting(small, keys, value, wanted, interpolation, extras)
    return sorted_.unionByName(selected).filter(having())


def _by_sorting(
    valued: DataFrame, keys: list[str], value: str, wanted: Mapping[str, float], interpolation: str, extras: dict[str, Extra]
) -> DataFrame:
    """One exchange by group and one sort; the rows of the wanted ranks are picked out."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = valued.select(
        *keys,
        F.col(value).alias("_value"),
        (F.row_number().over(ordered) - 1).alias("_before"),
        F.count(F.lit(1)).over(group).alias("n"),
        *[fn(c).over(group).alias(name) for name, (fn, c) in extras.items()],
    ).withColumn("_n", F.lit(1))
    return _at_ranks(numbered.filter(_holds_a_rank(wanted, interpolation)), keys, wanted, interpolation, list(extras))


def radix_quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    wanted: Mapping[str, float],
    interpolation: str = "linear",
    counted: DataFrame | None = None,
) -> DataFrame:
    """``keys``, ``n`` and one column per quantile, for few groups of any size; no row is shuffled.

    ``counted`` may give the counts ``_n`` of the first pass by ``keys`` and ``_p``, the first 16 bits of
    :func:`with_order`.
    """
    ordered = with_order(rows.filter(F.col(value).isNotNull()), value)
    ranks = F.array(*[r for q in wanted.values() for r in _ranks(q, interpolation)])
    placed = radix_cells(ordered, keys, ranks, value, counted)
    return _at_ranks(placed, keys, wanted, interpolation, [])


def radix_cells(
    ordered: DataFrame, keys: list[str], ranks: Column, value: str = "_order", counted: DataFrame | None = None
) -> DataFrame:
    """The distinct whole numbers ``_order`` that take the ``ranks``, an array made from the rows ``n`` of a group.

    One row (``keys``, ``n``, ``_p``, ``_before``, ``_n``, ``_value``) for each: the number, how many rows
    of the group are below it and have it, and the ``value`` of these rows.
    """
    held: DataFrame | None = None
    placed = ordered
    for shift in PASSES:
        part = F.shiftright("_order", shift).alias("_p")
        if held is None:
            if counted is None:
                counted = ordered.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
            whole = F.sum("_n").over(Window.partitionBy(*keys)).alias("n")
            cells = counted.select(*keys, F.lit(0).alias("_q"), "_p", "_n", F.lit(0).cast("long").alias("_from"), whole)
            cells = cells.withColumn("_value", F.lit(None).cast(ordered.schema[value].dataType))
        else:
            same = [F.col(k) == F.col(f"_of_{k}") for k in keys]
            near = ordered.join(F.broadcast(held), [*same, F.shiftright("_order", shift + 16) == F.col("_q")])
            cells = near.groupBy(*keys, "_q", part, "_from", "n").agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_value"))
        earlier = Window.partitionBy(*keys, "_q").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("_before", F.col("_from") + F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        placed = placed.filter(_holds_one_of(ranks))
        held = placed.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_p").alias("_q"), F.col("_before").alias("_from"), "n")
    return placed


def _holds_one_of(ranks: Column) -> Column:
    return F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))


def _holds_a_rank(wanted: Mapping[str, float], interpolation: str) -> Column:
    return _holds_one_of(F.array(*[r for q in wanted.values() for r in _ranks(q, interpolation)]))


def _at_ranks(placed: DataFrame, keys: list[str], wanted: Mapping[str, float], interpolation: str, extras: list[str]) -> DataFrame:
    """The quantiles from rows ``_value`` that take the ranks from ``_before`` on, ``_n`` of them."""
    found = []
    for name, q in wanted.items():
        for side, rank in zip(("low", "high"), _ranks(q, interpolation)):
            here = (rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_n"))
            found.append(F.max(F.when(here, F.col("_value"))).alias(f"_{side}_{name}"))
    per_group = placed.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(c).alias(c) for c in extras], *found)
    return per_group.select(
        *keys,
        "n",
        *extras,
        *[
            F.when(F.col(f"_low_{name}") == F.col(f"_high_{name}"), F.col(f"_low_{name}"))
            .otherwise(F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * _share(q))
            .alias(name)
            for name, q in wanted.items()
        ],
    )


def _ranks(q: float, interpolation: str) -> tuple[Column, Column]:
    """The zero-based ranks a quantile lies between, from the column ``n``."""
    position = F.lit(float(q)) * (F.col("n") - 1)
    if interpolation == "nearest":
        rank = F.round(position).cast("bigint")
        return rank, rank
    if interpolation == "linear":
        return F.floor(position), F.ceil(position)
    raise ValueError(f"unknown interpolation: {interpolation}")


def _share(q: float) -> Column:
    position = F.lit(float(q)) * (F.col("n") - 1)
    return position - F.floor(position)


def describe(
    rows: DataFrame, columns: list[str], interpolation: str = "nearest", within: DataFrame | None = None
) -> DataFrame:
    """Summary statistics as rows ``(measure, statistic, value)``.

    ``count``, ``null_count``, ``mean``, ``std`` (sample), ``min``, ``25%``, ``50%``, ``75%``,
    ``max``; the quartiles are values that occur unless ``interpolation`` is ``linear``.

    The first pass of the radix selection also carries the moments of each of its cells, which are
    merged afterwards. ``within`` may name a table of at least as many rows that is cheap to count; if it
    has few, they are sorted instead.
    """
    measures = [F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns]
    long = rows.select(F.inline(F.array(*measures)))
    cells = (
        with_order(long, "value")
        .groupBy("measure", F.shiftright("_order", PASSES[0]).alias("_p"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.avg("value").alias("_mean"),
            F.var_pop("value").alias("_var"),
            F.min("value").alias("_min"),
            F.max("value").alias("_max"),
        )
    )
    # an array of one row, which keeps both uses from being pruned to different columns
    cells = cells.select("measure", F.inline(F.array(F.struct(*cells.columns[1:]))))
    counted = F.expr("if(_p is null, 0, _n)")
    whole = Window.partitionBy("measure")
    merged = cells.withColumn("_all", F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.nullif(F.sum(counted).over(whole), F.lit(0)))
    spread = F.sum(F.col("_n") * (F.col("_var") + (F.col("_mean") - F.col("_all")) ** 2))
    moments = merged.groupBy("measure").agg(
        F.sum(counted).cast("double").alias("count"),
        F.sum(F.expr("if(_p is null, _n, 0)")).cast("double").alias("null_count"),
        F.max("_all").alias("mean"),
        F.when(F.sum(counted) > 1, F.sqrt(spread / (F.sum(counted) - 1))).alias("std"),
        F.min("_min").alias("min"),
        F.max("_max").alias("max"),
    )
    wanted = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
    if within is not None and within.count() <= FEW_ROWS:
        quartiles = _by_sorting(long.filter("value is not null"), ["measure"], "value", wanted, interpolation, {})
    else:
        first = cells.filter("_p is not null").select("measure", "_p", "_n")
        quartiles = radix_quantiles(long, ["measure"], "value", wanted, interpolation, first)
    return _as_rows(moments).unionByName(_as_rows(quartiles.drop("n")))


def _as_rows(wide: DataFrame) -> DataFrame:
    names = [c for c in wide.columns if c != "measure"]
    return wide.unpivot("measure", [F.col(f"`{c}`") for c in names], "statistic", "value")
