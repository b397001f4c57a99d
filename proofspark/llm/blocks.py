"""Comparing all rows of a key in bounded tasks, however many rows a key has."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def blocked(rows: DataFrame, keys: list[str], id_column: str, block: int = BLOCK, shard_rows: int = 40_000) -> DataFrame:
    """Rows with ``_cell``, ``_i``, ``_j`` and ``_own``, to be grouped by the first three.

    Keys of up to ``block`` rows share cells of about ``shard_rows`` rows. A larger key is cut into blocks
    by the hash of the id; each pair of its blocks is a cell of its own and holds about two blocks, so
    memory is bounded and every pair of rows meets exactly once. ``rows`` is read twice: give a stored table.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    hot = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.ceil(F.col("_n") / block).cast("int").alias("_b"))
    shards = int(rows.count() // shard_rows) + 1
    joined = rows.join(hot, [F.col(k) == F.col(f"_{k}") for k in keys], "left").drop(*[f"_{k}" for k in keys])
    own = F.when(F.col("_b").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_column, F.lit(5)), F.col("_b"))).cast("int")
    others = F.when(F.col("_b").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_b") - 1))
    shard = F.pmod(F.xxhash64(*keys), F.lit(shards))
    return (
        joined.withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .withColumn("_cell", F.when(F.col("_b").isNull(), shard).otherwise(F.lit(shards) + F.pmod(F.xxhash64(*keys), F.lit(1 << 40))))
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .drop("_b", "_other")
    )


def blocked_apart(
    rows: DataFrame, keys: list[str], id_column: str, apart: str, block: int = BLOCK, shard_rows: int = 40_000
) -> DataFrame:
    """Like ``blocked``, where only rows of a key that differ in ``apart`` need to meet.

    In a large key each value of ``apart`` with more than ``block`` rows has blocks of its own, which are
    not paired with each other; all other rows of the key share blocks, which are paired with all. So a
    key of one large value and a few others costs as many rows again, not the square of its blocks.
    """
    per_value = rows.groupBy(*keys, apart).agg(F.count(F.lit(1)).alias("_n"))
    large = F.when(F.col("_n") > block, F.ceil(F.col("_n") / block)).otherwise(0)
    hot = (
        per_value.groupBy(*keys)
        .agg(
            F.sum("_n").alias("_all"),
            F.sum(F.when(F.col("_n") > block, 0).otherwise(F.col("_n"))).alias("_rest"),
            # at most as many as rows of the key / block
            F.array_sort(F.collect_list(F.when(F.col("_n") > block, F.struct(apart, large.cast("int").alias("b"))))).alias("_large"),
        )
        .where(F.col("_all") > block)
        .withColumn("_own_blocks", F.aggregate("_large", F.lit(0), lambda t, x: t + x["b"]))
        .withColumn("_blocks", F.col("_own_blocks") + F.ceil(F.col("_rest") / block).cast("int"))
    )
    shared = hot.select(*[F.col(k).alias(f"_{k}") for k in keys], "_own_blocks", "_blocks")
    before = F.aggregate(F.slice("_large", F.lit(1), F.col("pos")), F.lit(0), lambda t, x: t + x["b"])
    spread = hot.select(*keys, "_large", F.posexplode("_large")).select(
        *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.col(f"col.{apart}").alias("_of_apart"),
        before.alias("_at"),
        F.col("col.b").alias("_b"),
    )
    shards = int(rows.count() // shard_rows) + 1
    joined = rows.join(shared, [F.col(k) == F.col(f"_{k}") for k in keys], "left").join(
        spread, [*[F.col(k) == F.col(f"_of_{k}") for k in keys], F.col(apart) == F.col("_of_apart")], "left"
    )
    chance = F.xxhash64(id_column, F.lit(5))
    own = (
        F.when(F.col("_blocks").isNull(), 0)
        .when(F.col("_b").isNotNull(), F.col("_at") + F.pmod(chance, F.col("_b")))
        .otherwise(F.col("_own_blocks") + F.pmod(chance, F.greatest(F.col("_blocks") - F.col("_own_blocks"), F.lit(1))))
    ).cast("int")
    until = lambda low, high: F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))
    others = (
        F.when(F.col("_blocks").isNull(), F.array(F.lit(0)))
        .when(
            F.col("_b").isNotNull(),
            F.concat(until(F.lit(0), F.col("_at")), until(F.col("_at") + F.col("_b"), F.col("_blocks"))),
        )
        .otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    )
    hashed = F.pmod(F.xxhash64(*keys), F.lit(shards))
    return (
        joined.withColumn("_own", own)
        .withColumn("_other", F.explode(others))
        .withColumn(
            "_cell", F.when(F.col("_blocks").isNull(), hashed).otherwise(F.lit(shards) + F.pmod(F.xxhash64(*keys), F.lit(1 << 40)))
        )
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .select(*rows.columns, "_own", "_cell", "_i", "_j")
    )


def groups_of(table: pa.Table, keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each key of a cell, the positions of its two sides; the same array twice where all pairs count."""
    columns = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns)
    change = np.zeros(len(order), bool)
    for c in columns:
        change[1:] |= c[order][1:] != c[order][:-1]
    i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
    own = table.column("_own").to_numpy()
    for at in np.split(order, np.flatnonzero(change)):
        if i == j:
            if len(at) > 1:
                yield at, at
        else:
            left, right = at[own[at] == i], at[own[at] == j]
            if len(left) and len(right):
                yield left, right


class Forest:
    """Union-find over the rows of one cell; remembers the links that joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x], x = top, up
        return top

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))
