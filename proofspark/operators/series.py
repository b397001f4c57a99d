"""Row-to-previous-row operators over sensor series of any length.

A window partitioned by sensor would bring a whole series into one task, and one sensor may
hold a third of all readings. Here a series is cut into chunks of fixed time width. Windows run
inside (sensor, chunk), and what crosses a chunk's border travels in a table with one row per
non-empty chunk: its first and last reading and its counts. That table is scanned as a tree:
chunks are summed up to blocks of thousands of chunks, blocks to larger blocks, and what came
before a block is handed down again. So no window holds more than some 16,000 rows, however long
a sensor's history and however short the chunks.

The chunk is a plain function of the timestamp, so a lost executor's tasks recompute the same
chunks, and both uses of the chunked rows can share one exchange.

A single chunk can still be too large, say after a bulk load under one timestamp. ``heavy_cells``
counts the rows per chunk and names those beyond a limit; they are then cut by seconds, heavy
seconds by microseconds, and heavy microseconds by ranks of ``reading_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofspark.operators.quantiles import radix_cells

CHUNK_SECONDS = 3600
HEAVY_ROWS = 20_000_000
BROADCAST_CELLS = 100_000
#: Have heavy chunks looked for, with ``HEAVY_ROWS`` as the limit.
FIND = "find"
#: Blocks of chunks: every timestamp plus OFFSET microseconds has less than TOP_BITS bits, and a block
#: has at most 2 to the power of LEVEL_BITS children.
OFFSET, TOP_BITS, LEVEL_BITS = 1 << 58, 59, 14
MOST_PIECES = 10_000

ORDER = ("datetime", "reading_id")
CELL = ("sensor_id", "chunk", "part")

# flag(datetime, temperature, previous datetime, previous temperature); previous are null at first
StartFlag = Callable[[Column, Column, Column, Column], Column]

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_SECOND = f"cast(datetime - {_EPOCH} as bigint) * 1000000L"
_MICROSECOND = f"cast(cast(datetime - {_EPOCH} as decimal(20, 6)) * 1000000 as bigint)"


@dataclass(frozen=True)
class HeavyCells:
    """Chunks with too many rows: ``(sensor_id, chunk)`` hours, then seconds, then instants.

    Instants also have ``bounds``, the rising values of ``reading_id`` at which they are cut.
    """

    hours: DataFrame
    seconds: DataFrame | None = None
    instants: DataFrame | None = None


def with_chunk(
    rows: DataFrame,
    chunk_seconds: int = CHUNK_SECONDS,
    heavy: HeavyCells | None = None,
    part: str = "size(filter(bounds, b -> b <= reading_id))",
) -> DataFrame:
    """Adds ``chunk``, the start of a row's stretch of time in microseconds, and ``part``.

    ``part`` tells the pieces of a heavy instant apart and is 0 elsewhere.
    """
    rows = rows.withColumns(
        {
            "chunk": F.expr(
                # never null, so that a join by chunk adds no filter to one of its sides only,
                # which would keep the two from sharing an exchange
                f"coalesce(floor(cast(datetime - {_EPOCH} as bigint) / {chunk_seconds})"
                f" * {chunk_seconds * 1_000_000}L, 0L)"
            ),
            "part": F.lit(0).cast("bigint"),
        }
    )
    if heavy is None:
        return rows
    for cells, finer in ((heavy.hours, _SECOND), (heavy.seconds, _MICROSECOND)):
        if cells is not None:
            found = cells.select("sensor_id", "chunk", F.lit(True).alias("is_heavy"))
            rows = (
                rows.join(found, ["sensor_id", "chunk"], "left")
                .withColumn("chunk", F.expr(f"if(is_heavy, {finer}, chunk)"))
                .drop("is_heavy")
            )
    if heavy.instants is not None:
        rows = (
            rows.join(heavy.instants, ["sensor_id", "chunk"], "left")
            .withColumn("part", F.expr(f"if(bounds is null, 0L, cast({part} as bigint))"))
            .drop("bounds")
        )
    return rows


def heavy_cells(
    readings: DataFrame, limit: int = HEAVY_ROWS, chunk_seconds: int = CHUNK_SECONDS
) -> HeavyCells | None:
    """The chunks of more than ``limit`` readings, or None where there are none.

    A table of no more rows than ``limit`` is only counted. Else a job reads ids and times and combines
    counts before the shuffle; finer counts only look at heavy chunks. Heavy instants are cut at ranks of
    their ids, found by radix selection, so that pieces are even however ids lie. The
    result can be passed to every operator over the same readings.
    """
    if readings.count() <= limit:
        return None
    heavy, rows, keys = None, readings, ["sensor_id", "chunk"]
    for level in ("hours", "seconds", "instants"):
        cut = with_chunk(rows, chunk_seconds, heavy)
        counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
        cells = _broadcast_if_few(counts if level == "instants" else counts.select(*keys))
        if cells is None:
            break
        if level == "instants":
            cells = _broadcast_if_few(_id_bounds(cut, cells, limit))
        known = {} if heavy is None else {"hours": heavy.hours, "seconds": heavy.seconds}
        heavy = HeavyCells(**{"hours": cells, **known, level: cells})
        if level == "hours":
            rows = cut.join(cells, keys, "left_semi").select(*readings.columns)
    return heavy


def _id_bounds(cut: DataFrame, cells: DataFrame, limit: int) -> DataFrame:
    """Per heavy instant the ids at which it is cut into pieces of about half of ``limit``."""
    keys = ["sensor_id", "chunk"]
    ids = cut.join(cells.select(*keys), keys, "left_semi").select(*keys, F.col("reading_id").alias("_order"))
    ranks = F.expr(
        f"transform(sequence(1, cast(least({MOST_PIECES}, ceil(2 * n / {limit})) as int) - 1), i ->"
        f" cast(i as bigint) * n div least({MOST_PIECES}, ceil(2 * n / {limit})))"
    )
    return radix_cells(ids, keys, ranks).groupBy(*keys).agg(F.array_sort(F.collect_set("_p")).alias("bounds"))


def _broadcast_if_few(cells: DataFrame) -> DataFrame | None:
    """The cells as a broadcast table, or as they are where there are too many; None for none."""
    rows = cells.limit(BROADCAST_CELLS + 1).collect()
    if not rows:
        return None
    if len(rows) > BROADCAST_CELLS:
        return cells
    return F.broadcast(cells.sparkSession.createDataFrame(rows, cells.schema))


def chunk_of(ts: str, chunk_seconds: int = CHUNK_SECONDS) -> Column:
    """The number of the fixed-width stretch of time that a timestamp column falls in."""
    return F.expr(f"floor(cast({ts} - {_EPOCH} as bigint) / {chunk_seconds})")


def found_heavy(
    readings: DataFrame,
    heavy: HeavyCells | None | str,
    chunk_seconds: int,
    within: DataFrame | None = None,
) -> tuple[HeavyCells | None, list[int]]:
    """What ``heavy`` stands for, and the levels of the tree of chunks.

    ``heavy`` are cells found before, None for none, or ``FIND`` to look for them now. Where a count finds
    no more readings than one task may hold, nothing is heavy and one level is enough; ``within`` may name
    a table with at least these rows that is cheaper to count.
    """
    if heavy == FIND:
        if (readings if within is None else within).count() <= HEAVY_ROWS:
            return None, [TOP_BITS]
        heavy = heavy_cells(readings, HEAVY_ROWS, chunk_seconds)
    return heavy, tree_shifts(chunk_seconds, heavy)


def tree_shifts(chunk_seconds: int, heavy: HeavyCells | None) -> list[int]:
    """How many bits of a chunk's start are cut off for its block, level by level, up to a single block."""
    finest = 0 if heavy is not None else (chunk_seconds * 1_000_000).bit_length() - 1
    levels = max(1, -(-(TOP_BITS - finest) // LEVEL_BITS))
    return [finest + (TOP_BITS - finest) * (i + 1) // levels for i in range(levels)]


def carried(
    cells: DataFrame,
    shifts: list[int],
    sums: Sequence[str] = (),
    maxima: Sequence[str] = (),
    backwards: bool = False,
    level: int = 0,
) -> DataFrame:
    """Adds ``before_`` columns: sums and maxima over a sensor's earlier cells (later ones if ``backwards``).

    Sums are 0 and maxima null where there are none. A cell sees the cells before it inside its block; what
    came before the block is worked out in the same way on the next level, where a block is one row.
    """
    whole = len(shifts) == 1
    block = f"_block{shifts[0]}"
    keys = ["sensor_id", block] if shifts[0] < TOP_BITS or level else ["sensor_id"]
    order = [F.desc(c) if backwards else F.asc(c) for c in ("chunk", "part")]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if len(keys) > 1:
        # an array of one row, which keeps both uses below from being pruned to different columns
        names = [c for c in cells.columns if c not in CELL]
        cells = cells.withColumn(block, F.shiftright(F.col("chunk") + F.lit(OFFSET), shifts[0]))
        cells = cells.select(*CELL, block, F.inline(F.array(F.struct(*names))))
    near = cells.select(
        "*",
        *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"before_{n}") for n in sums],
        *[F.max(n).over(inside).alias(f"before_{n}") for n in maxima],
    )
    if whole:
        return near.drop(block)
    blocks = near.groupBy("sensor_id", block).agg(
        F.min("chunk").alias("chunk"),
        F.min("part").alias("part"),
        *[F.sum(n).alias(n) for n in sums],
        *[F.max(n).alias(n) for n in maxima],
    )
    above = carried(blocks, shifts[1:], sums, maxima, backwards, level + 1).select(
        "sensor_id", block, *[F.col(f"before_{n}").alias(f"above_{n}") for n in (*sums, *maxima)]
    )
    both = {f"before_{n}": F.col(f"before_{n}") + F.col(f"above_{n}") for n in sums}
    both |= {f"before_{n}": F.greatest(f"before_{n}", f"above_{n}") for n in maxima}
    joined = near.join(above, ["sensor_id", block]).withColumns(both)
    return joined.drop(block, *[f"above_{n}" for n in (*sums, *maxima)])


def link_series(
    readings: DataFrame,
    starts: StartFlag | None = None,
    chunk_seconds: int = CHUNK_SECONDS,
    heavy: HeavyCells | None | str = FIND,
    marked: str | None = None,
) -> DataFrame:
    """Adds ``prev_datetime`` and ``prev_temperature_f``, the sensor's previous reading.

    With ``starts`` also ``island``: how many rows up to and including this one are starts.
    With ``marked``, a condition, also ``prev_marked``: when the last earlier row met it.
    Expects rows with a timestamp and a unique ``reading_id`` per sensor and time. ``chunk`` and
    ``part`` stay in the result for operators that go on. Heavy chunks are found and cut unless
    ``heavy`` names them or is None.
    """
    heavy, shifts = found_heavy(readings, heavy, chunk_seconds)
    inside = Window.partitionBy(*CELL).orderBy(*ORDER)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    local = with_chunk(readings, chunk_seconds, heavy).select(
        "*",
        F.lag("datetime").over(inside).alias("_dt"),
        F.lag("temperature_f").over(inside).alias("_temp"),
        F.lead("datetime").over(inside).isNull().alias("_last"),
    )
    first = F.col("_dt").isNull()
    if starts is not None:
        flag = _flag(starts, "datetime", "temperature_f", "_dt", "_temp")
        local = local.withColumn("_start", F.when(first, F.lit(0)).otherwise(flag))
        local = local.withColumn("_run", F.sum("_start").over(so_far))

    # times only rise, so the latest is the highest
    latest_marked = F.expr(f"max(case when {marked} then datetime end)")
    if marked is not None:
        earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
        local = local.withColumn("_marked", latest_marked.over(earlier))

    # cells in order, so that the highest of the earlier ones is the last
    tail = F.struct("chunk", "part", F.col("datetime").alias("dt"), F.col("temperature_f").alias("temp"))
    edge = [F.max(F.when(F.col("_last"), tail)).alias("tail")]
    if starts is not None:
        edge += [
            F.max(F.when(first, F.col("datetime"))).alias("head_dt"),
            F.max(F.when(first, F.col("temperature_f"))).alias("head_temp"),
            F.sum("_start").alias("inner_starts"),
        ]
    maxima = ["tail"]
    if marked is not None:
        edge.append(latest_marked.alias("marked"))
        maxima.append("marked")
    edges = carried(local.groupBy(*CELL).agg(*edge), shifts, maxima=maxima).withColumns(
        {"carry_dt": F.col("before_tail.dt"), "carry_temp": F.col("before_tail.temp")}
    )
    carries = ["carry_dt", "carry_temp"]
    if marked is not None:
        carries.append("before_marked")
    if starts is not None:
        head = _flag(starts, "head_dt", "head_temp", "carry_dt", "carry_temp")
        edges = edges.withColumn("head_start", head).withColumn("starts", F.col("inner_starts") + F.col("head_start"))
        edges = carried(edges.select(*CELL, "head_start", "starts", *carries), shifts, sums=["starts"])
        edges = edges.withColumn("base", F.col("before_starts") + F.col("head_start"))
        carries.append("base")

    joined = local.join(edges.select(*CELL, *carries), list(CELL))
    added = [
        F.when(first, F.col("carry_dt")).otherwise(F.col("_dt")).alias("prev_datetime"),
        F.when(first, F.col("carry_temp")).otherwise(F.col("_temp")).alias("prev_temperature_f"),
    ]
    if starts is not None:
        added.append((F.col("base") + F.col("_run")).alias("island"))
    if marked is not None:
        added.append(F.coalesce("_marked", "before_marked").alias("prev_marked"))
    return joined.select(*readings.columns, "chunk", "part", *added)


def _flag(starts: StartFlag, dt: str, temp: str, prev_dt: str, prev_temp: str) -> Column:
    """A start flag as 0 or 1; unknown counts as no start."""
    told = starts(F.col(dt), F.col(temp), F.col(prev_dt), F.col(prev_temp))
    return F.coalesce(told, F.lit(False)).cast("bigint")
