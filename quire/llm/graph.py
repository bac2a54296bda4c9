"""Connected components by star contraction, for edge tables of any size.

Defined cases: an edge of a node with itself makes no component; repeated edges count once; an empty table has no
components; of several nodes the least names its component, so ties cannot occur; null ends of an edge are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, release


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every larger neighbour of a node is tied to the least node around it. Also returns the written table that this reads."""
    both = _both(edges)
    # written, so that the join reads the edges of a hub from an exchange of its own, which Spark can split
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), least


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of edges (u, v); root is the least node it is connected to.

    Each round is two stars; the number of rounds grows with the logarithm of the longest chain.
    Only a count and a checksum come to the driver.
    """
    now, before = materialize(_small_star(edges)), None
    for _ in range(rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == before or not seen[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = seen
        tied, least = _large_star(now)
        last, now = now, materialize(_small_star(tied))
        release(last, least)
    raise RuntimeError("components did not settle")
