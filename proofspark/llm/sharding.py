"""Sharding with linked documents together: balanced label propagation, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofspark.llm.common import documents, ranked, stored, stored_rows

#: Parts into which movers between two shards are cut; whole parts move, as many as the quota takes.
PARTS = 64


def text_links(rows: DataFrame) -> DataFrame:
    """Links (rid, node): rows of equal texts share a node. Rows alone with their text have none."""
    shared = rows.groupBy("text_hash").agg(F.count("*").alias("_n")).where("_n > 1")
    return rows.join(shared, "text_hash").select("rid", F.xxhash64("text_hash").alias("node"))


def _quotas(wishes: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """(source, target, allowed): how many rows may go from a shard to another.

    Swaps first: as many as wish to go both ways. What is left may fill the target's free room, shared
    out in order of the wish. Both tables have at most shards x shards rows.
    """
    back = wishes.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("n").alias("back"))
    pairs = wishes.join(back, ["source", "target"], "left")
    pairs = pairs.withColumn("swap", F.least("n", F.coalesce("back", F.lit(0)))).withColumn("over", F.col("n") - F.col("swap"))
    before = Window.partitionBy("target").orderBy(F.desc("over"), "source").rowsBetween(Window.unboundedPreceding, -1)
    roomy = pairs.join(sizes.select(F.col("shard").alias("target"), "rows"), "target", "left")
    room = F.greatest(F.lit(most) - F.coalesce("rows", F.lit(0)), F.lit(0))
    taken = F.coalesce(F.sum("over").over(before), F.lit(0))
    extra = F.least(F.col("over"), F.greatest(room - taken, F.lit(0)))
    return roomy.select("source", "target", (F.col("swap") + extra).alias("allowed"))


def propagate(rows: DataFrame, links: DataFrame, most: int, rounds: int = 10) -> DataFrame:
    """Moves linked rows (rid, shard) towards the shard that most members of their node are in.

    Each round counts the members of every node by shard (partial sums; a hot node is one count per
    shard). A row wishes for the shard with the most neighbours among those with room, ties by a hash, if
    it beats its own shard. Wishes are granted within quotas: movers of a pair of shards are cut into
    parts by a hash that changes with the round, and parts are granted while their sum is within the
    quota, so that no shard outgrows ``most`` by more than it had and movers are never gathered in one
    task. A node larger than a shard fills one after the other. Ends when nothing moves.
    """
    for k in range(rounds):
        placed = links.join(rows, "rid")
        sizes = stored_rows(rows.groupBy("shard").agg(F.count("*").alias("rows")))
        counts = placed.groupBy("node", "shard").agg(F.count("*").alias("n"))
        scored = counts.withColumn("score", F.struct("n", F.xxhash64("node", "shard").alias("h")))
        roomy = scored.join(F.broadcast(sizes.where(F.col("rows") < most).select("shard")), "shard", "left_semi")
        best = roomy.groupBy("node").agg(F.max(F.struct("score", F.col("shard").alias("target"))).alias("best"))
        wish = (
            placed.join(scored.select("node", "shard", "score"), ["node", "shard"])
            .join(best, "node")
            .where("best.score > score")
            .groupBy("rid", F.col("shard").alias("source"))
            .agg(F.max("best").alias("best"))
            .select("rid", "source", F.col("best.target").alias("target"))
            .where("source != target")
            .withColumn("_part", F.pmod(F.xxhash64("rid", F.lit(k)), F.lit(PARTS)))
        )
        wish = stored_rows(wish)
        parts = wish.groupBy("source", "target", "_part").agg(F.count("*").alias("n"))
        wishes = parts.groupBy("source", "target").agg(F.sum("n").alias("n"))
        up_to = Window.partitionBy("source", "target").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        granted = (
            parts.withColumn("sum", F.sum("n").over(up_to))
            .join(_quotas(wishes, sizes, most), ["source", "target"])
            .where("sum <= allowed")
        )
        granted = stored_rows(granted.select("source", "target", "_part", "n"))
        if not granted.agg(F.sum("n")).first()[0]:
            break
        moves = wish.join(granted.drop("n"), ["source", "target", "_part"]).select("rid", F.col("target").alias("_to"))
        rows = stored_rows(rows.join(moves, "rid", "left").withColumn("shard", F.coalesce("_to", "shard")).drop("_to"))
    return rows


def fill(tied: DataFrame, loose: DataFrame, shards: int, n: int) -> DataFrame:
    """Places every row so that shards differ by one row at most: (rid, shard).

    Linked rows (rid, shard) stay as far as their shard's due; the others and the ``loose`` ones (rid)
    take the free seats in turn. The larger dues go to the shards with the most linked rows. Only tables
    of one row per shard are windowed as a whole or broadcast.
    """
    grid = tied.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    counts = grid.join(tied.groupBy("shard").agg(F.count("*").alias("rows")), "shard", "left").fillna(0, ["rows"])
    whole = Window.partitionBy(F.lit(0))
    due = F.lit(n // shards) + F.when(F.row_number().over(whole.orderBy(F.desc("rows"), "shard")) <= n % shards, 1).otherwise(0)
    counts = counts.withColumn("due", due).withColumn("free", F.greatest(F.col("due") - F.col("rows"), F.lit(0)))
    before = whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored_rows(counts.withColumn("low", F.coalesce(F.sum("free").over(before), F.lit(0))))
    numbered = ranked(tied, ["shard"], F.col("rid"), "_at").join(F.broadcast(counts.select("shard", "due")), "shard")
    pool = stored_rows(numbered.where("_at >= due").select("rid").union(loose.select("rid")))
    seated = ranked(pool.withColumn("_all", F.lit(0)), ["_all"], F.col("rid"), "_seat", 4096)
    gaps = F.broadcast(counts.where("free > 0").select("shard", "low", "free"))
    taken = seated.join(gaps, (F.col("_seat") >= F.col("low")) & (F.col("_seat") < F.col("low") + F.col("free")))
    return numbered.where("_at < due").select("rid", "shard").union(taken.select("rid", "shard"))


def shard_documents(
    docs: DataFrame, shards: int = 24, links: DataFrame | None = None, rounds: int = 10, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """Places every row of ``docs`` in a shard; counts differ by one at most, linked rows mostly share one.

    Returns the id, size (UTF-8 bytes of the text and 8), text_crc32, law (``rows``), shard, slot (gapless
    from 0 in the shard, in no meaningful order) and grown_shard (null). ``links`` (id, node) names what
    belongs together; without it, equal texts do. Linked rows start in shards by the rank of their hash and
    ``propagate`` within a limit of one due share; ``fill`` seats the rest. A group larger than a shard
    fills as many as it needs.

    Null texts have size 8, the checksum of an empty text, and link with nothing; empty texts are equal
    texts. Repeated rows are rows of their own. Null ids are placed as well. Other columns are left out.
    An empty table gives an empty result.
    """
    hashed = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.sha2(F.col(text), 256).alias("text_hash"),
    )
    base = stored(hashed)
    base = stored(ranked(base.withColumn("_all", F.lit(0)), ["_all"], F.struct("id", "text_hash"), "rid", 4096).drop("_all"))
    n = base.count()
    if links is None:
        links = text_links(base.where("text_hash is not null"))
    else:
        names = [F.col(c).alias(to) for c, to in zip(links.columns, ("id", "node"), strict=False)]
        links = base.join(links.select(*names), "id").select("rid", "node")
    links = stored_rows(links)
    first = links.select("rid").distinct()
    first = stored_rows(first.withColumn("shard", F.pmod("rid", F.lit(shards)).cast("int")))
    tied = propagate(first, links, max(1, n // shards), rounds)
    even = stored(fill(tied, base.select("rid").join(first, "rid", "left_anti"), shards, n))
    slots = ranked(even, ["shard"], F.col("rid"), "slot")
    return base.join(slots, "rid").select(
        F.col("id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark, folder: str) -> DataFrame:
    """All documents in 24 shards of even counts, equal texts together."""
    return shard_documents(documents(spark, folder))
