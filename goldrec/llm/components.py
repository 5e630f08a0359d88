"""Connected components of a large edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.plans.durable import durable


def _mark(edges: DataFrame) -> tuple:
    """A few numbers that tell whether the edge set has changed."""
    total = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` for every vertex ``u`` that is not the smallest of its component: ``v`` is.

    ``edges`` has columns ``u, v`` of one ordered type. Every round links the larger
    neighbours of a vertex to its smallest one, then the smaller ones; a round is two
    aggregations and two joins over the edges and is stored, and the number of rounds
    grows with the logarithm of the longest path.
    """
    edges = durable(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = durable(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges
