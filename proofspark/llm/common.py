"""Helpers of the operators: written tables, shards, ranks, words and packed rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input that one shard of packed rows stands for.
SHARD_BYTES = 24 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares, ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "/tmp/proofspark-checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/table-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read back; cuts lineage."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables; only for tables that no later job reads."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/table-" in path:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_rows(df: DataFrame) -> DataFrame:
    """Like ``stored`` for small tables of an iteration, by ``checkpoint``.

    Their files go with the session's references to them where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true, else they stay as written tables do.
    """
    scratch(df.sparkSession)
    return df.checkpoint()


def shard_count(df: DataFrame, column: str, least: int = 8, size: int = SHARD_BYTES) -> int:
    """Shards so that each stands for about ``size`` bytes of the text column."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(least, int(total // size) + 1)


def ranked(df: DataFrame, groups: list[str], order: Column, name: str, fine: int = 256) -> DataFrame:
    """Adds ``name``: gapless numbers from 0 in each group.

    A group is cut into ``fine`` parts by the hash of ``order``; parts are numbered by themselves and
    start after the counts of the parts before, so that no task holds a whole group. Rows that agree in
    ``order`` are numbered in any order. ``df`` must give the same rows when it is computed again.
    """
    from pyspark.sql import Window

    parted = df.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(fine)))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        parted.groupBy(*groups, "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), "_start")
    )
    inside = Window.partitionBy(*groups, "_part").orderBy(order)
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return (
        parted.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, [*same, F.col("_part") == F.col("_p")])
        .withColumn(name, (F.col("_start") + F.col("_in")).cast("long"))
        .select(*df.columns, name)
    )


_CODES: dict[bytes, int] = {}


def word_codes(words: list[bytes]) -> np.ndarray:
    """64-bit codes of words; the cache is emptied when it has grown large."""
    if len(_CODES) > 1_000_000:
        _CODES.clear()
    get, code = _CODES.get, xxhash.xxh3_64_intdigest
    out = [get(w) for w in words]
    if None in out:
        for i, c in enumerate(out):
            if c is None:
                out[i] = _CODES[words[i]] = code(words[i])
    return np.array(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def shingle_codes(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct codes of all runs of ``size`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    codes = word_codes(words)
    n = max(1, len(codes) - size + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(size, len(codes))):
        h = mixed(h + codes[i : i + n] + np.uint64(i + 1))
    return np.unique(mixed(h ^ np.uint64(min(size, len(codes)))))


def by_bytes(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes together."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
