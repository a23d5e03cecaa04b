"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, each from the larger node u to the smaller v, are stars: no u has two, and none is a v."""
    ups = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    middle = ups.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return ups.where("n > 1").select("u").union(middle.select("u")).isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has an edge to another node; component is the smallest node reachable.

    Nodes may be of any ordered type. Null ends and self loops say nothing and are left out, repeated edges count
    once, an empty table gives an empty result. Each round is one written table of at most as many edges as before;
    minima are combined before the shuffle, so a hub node does not gather its edges in one place, and the number of
    rounds grows with the logarithm of the longest path. Edges that are stars already, as most groups of copies are, take
    no round.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = scratch.table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(e):
        after = scratch.table(_small_star(_large_star(e).distinct()).distinct())
        scratch.drop(e)
        e = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
