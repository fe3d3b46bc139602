"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wordloom.llm.common import written

# The smallest neighbours are written before they are joined: then both sides of
# the join are plain shuffles, and adaptive execution can split a node with very many edges.


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = written(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "lowest")
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of these."""
    low = written(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    joined = edges.join(low, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest of its component.

    Alternates large-star and small-star steps: the number of rounds grows with
    the logarithm of the longest path, no node's neighbours are gathered, and an
    edge is replaced by at most one edge a step.  Null ends and loops are left out.
    """
    star = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    star = written(star.distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = mark(star)
    while before[0]:
        star = written(_small_star(_large_star(star).distinct()).distinct(), "edges")
        after = mark(star)
        if after == before:
            break
        before = after
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
