"""Importance resampling: hashed n-gram models of target and raw text, drawn by Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofspark.llm.common import documents, mixed, stored, word_codes

BUCKETS = 1 << 14
TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+")
#: The most labelled texts that the target model is fitted on.
TARGET_ROWS = 20_000


def features(text: str | None) -> np.ndarray:
    """Buckets of single tokens, of pairs, and of tokens that occurred among the last five."""
    codes = word_codes(TOKEN.findall((text or "").encode("utf-8", "surrogatepass")))
    if not len(codes):
        return np.zeros(0, np.int64)
    pairs = mixed(codes[:-1] + mixed(codes[1:]))
    back = np.zeros(len(codes), bool)
    for d in range(1, 6):
        back[d:] |= codes[d:] == codes[:-d]
    again = np.full(int(back.sum()), np.uint64(0x5EED))
    return (np.concatenate([mixed(codes), pairs, again]) % np.uint64(BUCKETS)).astype(np.int64)


def bucket_counts(docs: DataFrame, text: str) -> np.ndarray:
    """Features of all texts by bucket. Each task sends one row per bucket; one vector reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(features(value.as_py()), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS)
    for r in docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log probability of each bucket in the target less that in the raw text, with one added to all counts."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def _gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    codes = np.array([hash_ for hash_ in ids.to_numpy(zero_copy_only=False)], np.float64)
    whole = np.nan_to_num(codes, nan=-1.0).astype(np.int64).view(np.uint64)
    u = (mixed(whole + mixed(np.full(1, seed, np.uint64))) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / float(1 << 53)))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long, found 16 bits at a time; each step collects at most 65,536 counts."""
    here, prefix = rows, None
    for shift in (48, 32, 16, 0):
        part = F.shiftright(column, shift)
        if prefix is not None:
            here = rows.where(F.shiftright(column, shift + 16) == prefix)
        counts = here.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()
        for r in sorted(counts, key=lambda r: -r["p"]):
            if r["n"] >= k:
                prefix = r["p"]
                break
            k -= r["n"]
        else:
            return None
    return prefix


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: float,
    seed: int = 11,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """For each row of ``docs``: its id, log_ratio, score and kept.

    The raw model counts the features of all texts of ``docs``, the target model those of ``target``
    (texts of the wanted kind; the caller bounds it). ``log_ratio`` is the sum over a text's features of
    the difference in log probability, ``score`` adds Gumbel noise by the hash of the id, and the
    ``share`` of rows with the largest scores is kept: a draw without replacement in proportion to the
    ratio of the models. Rows that tie with the last one are kept as well.

    Null and empty texts have ratio 0. Repeated rows get the same score. A null id has a fixed noise.
    Other columns are left out. Empty tables are fine: no target means a flat model, no rows no result.
    """
    weights = log_ratios(bucket_counts(target, text), bucket_counts(docs, text))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = np.array([weights[features(t.as_py())].sum() for t in batch.column(1)], np.float64)
            total = ratio + _gumbel(batch.column(0), seed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ratio), pa.array(total), pa.array(_ordered(total))],
                names=[id_column, "log_ratio", "score", "_order"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    scored = stored(
        docs.select(id_column, text).mapInArrow(score, f"`{id_column}` {kind}, log_ratio double, score double, _order long")
    )
    k = round(share * scored.count())
    limit = kth_largest(scored, "_order", k) if k > 0 else None
    kept = F.lit(False) if limit is None else F.col("_order") >= limit
    return scored.withColumn("kept", kept).drop("_order")


def quality_target(docs: DataFrame, labels: DataFrame, most: int = TARGET_ROWS) -> tuple[DataFrame, float]:
    """Texts labelled good, at most about ``most`` by the hash of their ids, and the share of good labels."""
    sums = labels.agg(F.count("quality").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("good")).first()
    good = labels.where("quality = 1").select("doc_id").distinct()
    part = min(1.0, most / max(1, sums["good"] or 0))
    chosen = good.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) < int(part * 1_000_000))
    return docs.join(chosen, "doc_id", "left_semi"), (sums["good"] or 0) / max(1, sums["n"] or 0)


def op9_quality_classifier(spark, folder: str) -> DataFrame:
    """Scores of all documents; as large a share is kept as labels call good."""
    docs = documents(spark, folder).select("doc_id", "text")
    target, share = quality_target(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return resample(docs, target, share)
