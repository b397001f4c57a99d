"""Connected components of links by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofspark.llm.common import dropped, stored


def _leaves(links: DataFrame) -> DataFrame:
    """Each node with its smallest neighbour, itself included."""
    return links.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))


def _twice(links: DataFrame, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
    """Two links (u, v) of each row, by its columns; ``links`` is gone through once."""
    pairs = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (first, second)]
    return links.select(F.explode(F.array(*pairs)).alias("link")).select("link.u", "link.v")


def _settled(edges: DataFrame) -> bool:
    """Whether all edges are stars: each u has one edge and is the v of none."""
    up, down = (F.struct(F.col(c).alias("id"), F.lit(n).alias("up")) for c, n in (("u", 1), ("v", 0)))
    ends = edges.select(F.explode(F.array(up, down)).alias("end")).select("end.id", "end.up")
    inner = ends.groupBy("id").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1")
    return inner.agg(F.count("*")).first()[0] == 0


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """The smallest reachable id of every id in ``links`` (two columns of any ids, taken as undirected).

    Returns ``id`` and ``component_id``. Each round hangs larger neighbours on the smallest one (large
    star), then smaller ones (small star), until all links are a star around each smallest id; links that
    are stars already take no round. Either half of a round is a table written by a plan of one join, which
    replaces the one before, so that the driver holds small plans only. Hubs are summed up by partial
    aggregates; rows of a hub are joined, never gathered.
    """
    a, b = links.columns[:2]
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = stored(edges)
    for _ in range(most):
        if _settled(edges):
            break
        both = _twice(edges, ("u", "v"), ("v", "u"))
        large = both.join(_leaves(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = stored(large.distinct())
        small = _twice(large.join(_leaves(large), "u"), ("v", "least"), ("u", "least"))
        after = stored(small.where("u != v").distinct())
        dropped(edges, large)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(roots)
