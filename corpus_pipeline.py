"""A corpus pipeline: quality rules, line dedup, near-duplicate documents, mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``docs``. Rows are judged as rows: ids may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofspark.llm.common import documents, dropped, stored
from proofspark.llm.lines import drop_repeated_lines
from proofspark.llm.minhash import near_duplicates
from proofspark.llm.mixing import mix
from proofspark.llm.packing import pack_documents
from proofspark.llm.quality import quality_cascade

#: Share of all words that the mix keeps.
KEEP = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_cascade(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its later near-duplicate lines; ``n_chars`` counts anew where a line went."""
    out = drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, at a similarity of 0.8.

    A document is a row with its id and text: rows that share an id but not the text are two, equal rows
    are one, and null ids come last in their group. Rows go by a 64-bit hash; should two different rows
    ever share it, both stay.
    """
    keyed = docs.withColumn("_sha", F.sha2("text", 256)).withColumn("_row", F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select("_row", "text"), above=(100, 80), id_column="_row").select("_row", "component_id").distinct()
    found = stored(found)
    who = F.struct("doc_id", "_sha")
    rows = stored(keyed.groupBy("_row").agg(F.min(who).alias("low"), F.max(who).alias("high")))
    order = F.struct(F.col("low.doc_id").isNull().alias("last"), F.col("low.doc_id").alias("id"), "_row")
    first = rows.join(found, "_row").groupBy("component_id").agg(F.min(order).alias("first")).select("first._row")
    clashes = rows.where(~F.col("low").eqNullSafe(F.col("high"))).select("_row")
    kept = stored(first.union(clashes).distinct())
    dropped(found, rows)
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row", "doc_id", "_sha"]).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of documents in which sources, languages and topics have tempered shares."""
    return mix(docs, keep=KEEP).where("sampled").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-duplicate documents", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Raking, near-duplicates and packing have no equivalent in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
