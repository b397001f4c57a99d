"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofspark.llm.common import documents, stored, stored_rows

MARGINS = ("source", "lang", "topic")
#: Hash values stand for [0, 1) in steps of 2^-53.
GRAIN = 1 << 53


def topic_of(text: str) -> str:
    """A topic by the form of a text: table, figures, notes (short lines) or prose."""
    size = max(len(text), 1)
    if 100 * text.count("|") >= size:
        return "table"
    if 20 * sum(map(text.count, "0123456789")) >= size:
        return "figures"
    return "notes" if size < 60 * (text.count("\n") + 1) else "prose"


def measured(docs: DataFrame, text: str, topic: bool, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``tokens`` (words as ``[^\\x20\\x09-\\x0D]+``) and, if asked for, ``topic``; null texts are empty."""
    at = docs.columns.index(text)
    fields = [f for i, f in enumerate(docs.schema.fields) if keep_text or i != at]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, topics = [], []
            for value in batch.column(at):
                own = value.as_py() or ""
                tokens.append(len(own.encode("utf-8", "surrogatepass").split()))
                if topic:
                    topics.append(topic_of(own))
            columns = [batch.column(f.name) for f in fields] + [pa.array(tokens, pa.int64())]
            names = [*[f.name for f in fields], "tokens"]
            if topic:
                columns, names = [*columns, pa.array(topics, pa.string())], [*names, "topic"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    added = StructType.fromDDL("tokens long, topic string" if topic else "tokens long").fields
    return docs.mapInArrow(measure, StructType([*fields, *added]))


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares of a margin in proportion to its tokens to a power; 1 keeps the mix, 0 levels it."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").alias("t")).where("t > 0")
    return sums.select(margin, F.pow(F.col("t").cast("double"), power).alias("target"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 30, tolerance: float = 1e-4
) -> DataFrame:
    """``cells`` with ``weight``: tokens scaled so that each margin's shares meet its targets.

    ``targets`` has for each margin a table (margin, target) of numbers in proportion; a value that is
    missing there, or has none, gets weight 0. Each sweep scales all margins in turn by sums over windows of cells
    (what is windowed are cells, not documents); ends when all shares are within ``tolerance`` of their targets, or after ``sweeps`` (the targets may
    contradict each other where cells are empty; the last margin is then met exactly). Nothing is collected but one number for
    three sweeps.
    """
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = {}
    for margin, table in targets.items():
        present = cells.where("tokens > 0").select(F.col(margin).alias("_key")).distinct()
        wanted = table.where("target > 0").groupBy(margin).agg(F.sum("target").alias("_goal"))
        wanted = stored_rows(present.join(wanted, F.col("_key").eqNullSafe(F.col(margin))).select("_key", "_goal"))
        shares = wanted.agg(F.sum("_goal")).first()[0]
        goals[margin] = wanted.withColumn("_goal", F.col("_goal") * (whole / shares if shares else 0.0))
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, goal in goals.items():
        goal = goal.withColumnRenamed("_goal", f"_goal_{margin}")
        now = now.join(goal, F.col(margin).eqNullSafe(F.col("_key")), "left").drop("_key")
    now = stored_rows(now)
    for _ in range(0, sweeps, 3):
        for _ in range(3):
            for margin in goals:
                now = now.withColumn("_sum", F.sum("weight").over(Window.partitionBy(margin)))
                factor = F.when(F.col("_sum") > 0, F.coalesce(F.col(f"_goal_{margin}"), F.lit(0.0)) / F.col("_sum")).otherwise(0.0)
                now = now.withColumn("weight", F.col("weight") * factor).withColumn(f"_off_{margin}", F.abs(factor - 1))
        now = stored_rows(now)
        off = now.where("weight > 0").agg(F.max(F.greatest(F.lit(0.0), *[F.col(f"_off_{m}") for m in goals]))).first()[0]
        if off is None or off <= tolerance:
            break
    return now.select(*cells.columns, "weight")


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    power: float = 0.7,
    keep: float | None = None,
    seed: int = 7,
    text: str = "text",
    id_column: str = "doc_id",
) -> DataFrame:
    """All rows of ``docs`` with ``tokens``, ``topic``, ``probability`` and ``sampled``.

    Tokens are words. Cells of (source, lang, topic) are raked to ``targets`` (by default each margin's
    tokens to ``power``, so that a hot source gives way); a document's probability is its cell's ratio of
    raked to real tokens, scaled so that ``keep`` of all tokens are expected, or, by default, as large as
    leaves no probability above 1. With ``keep``, probabilities stop at 1 and the rest is spread again, so
    that the expected total holds. A document is sampled if the hash of its id is below its probability:
    equal ids fare alike, and nothing depends on partitions.

    Null sources, languages and topics are values like others. Documents without words are never sampled.
    A null id has a hash as well. Clashing added columns are replaced, but a ``topic`` that ``docs`` has
    is used. An empty table stays empty.
    """
    own_topic = "topic" in docs.columns
    rows = docs.drop(*[c for c in ("tokens", "probability", "sampled") if c != text])
    narrow = measured(rows.select(text, *[m for m in MARGINS if m in rows.columns]), text, not own_topic, keep_text=False)
    rows = measured(rows, text, not own_topic)
    cells = stored(narrow.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    goals = targets or {m: tempered(cells, m, power) for m in MARGINS}
    raked = rake(cells, goals).withColumn("_ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0))
    raked = stored_rows(raked)
    top = raked.agg(F.max("_ratio"), F.sum("tokens")).first()
    if keep is None:
        scale = 1 / top[0] if top[0] else 0.0
    else:
        scale = _scale(raked, keep * (top[1] or 0), top[0] or 0.0)
    chances = raked.select(
        *[F.col(m).alias(f"_{m}") for m in MARGINS], F.round(F.least(F.lit(1.0), F.col("_ratio") * scale), 9).alias("probability")
    )
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_column), 11) / F.lit(float(GRAIN))
    same = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS])
    return (
        rows.join(chances, same, "left")
        .drop(*[f"_{m}" for m in MARGINS])
        .withColumn("sampled", (drawn < F.coalesce("probability", F.lit(0.0))) & (F.col("tokens") > 0))
    )


def _scale(raked: DataFrame, wanted: float, top: float) -> float:
    """The factor at which min(1, ratio * factor) of all tokens are ``wanted``; all there are if that is less.

    Each job sums at 64 factors at once: powers of two first, then evenly between the two that enclose it. The
    factors are rows beside each cell, so that all jobs share one short piece of generated code.
    """
    if not top or wanted <= 0:
        return 0.0
    scales = [2.0**k / top for k in range(64)]
    for step in range(6):
        tried = raked.select("tokens", "_ratio", F.posexplode(F.lit(scales)).alias("_at", "_scale"))
        share = F.least(F.lit(1.0), F.col("_ratio") * F.col("_scale"))
        sums = {r["_at"]: r["_sum"] for r in tried.groupBy("_at").agg(F.sum(F.col("tokens") * share).alias("_sum")).collect()}
        found = [sums[k] for k in range(len(scales))]
        at = next((i for i, x in enumerate(found) if x >= wanted), len(scales) - 1)
        low = scales[at - 1] if at else (0.0 if step == 0 else scales[0])
        high = scales[at]
        scales = [low + (high - low) * k / 63 for k in range(64)]
    return high


def op2_mix_sources(spark, folder: str) -> DataFrame:
    """Probability and draw of every document, for half of all words."""
    mixed = mix(documents(spark, folder), keep=0.5)
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", "probability", "sampled")
