"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import materialise, release


def _contract(edges: DataFrame, smaller_too: bool) -> DataFrame:
    """Point each node's neighbours at the least id it knows.

    ``smaller_too`` false: only greater neighbours move (large star), with edges seen from both
    ends; true: an edge is seen from its greater end and the end itself moves too (small star).
    """
    if smaller_too:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = seen.groupBy("u").agg(F.min("v").alias("m"))
        moved = seen.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = seen.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        moved = seen.join(least, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    return moved.where("a != b").select("a", "b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (least id reachable) of every node at a link (a, b); no row for others.

    Each round is written to the shared folder and costs two shuffles of the links; the number
    of rounds grows with the logarithm of a component's width.  Loops and repeats are harmless.
    """
    edges = materialise(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        last, edges = edges, materialise(_contract(_contract(edges, False), True), "links")
        release(last)
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
