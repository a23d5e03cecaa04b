"""Spanning forests, parts of a graph, single linkage and the closure of constraints, from tables of edges.

Each round every part picks its lightest edge to another part and is merged over it, so the number of parts at least
halves; edges within a part, and all but the lightest between two parts, are dropped. What crosses a round is a table of
edges and one of parts, both written in the shared folder.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators.distance import with_blocks


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written in the session's spark.checkpoint.dir; only a local master may leave that unset.

    A checkpoint would keep the size that Spark expected of the rows, which multiplies with every join of every round; a
    table that is read back has the size of its files.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loadscape-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _roots(best: DataFrame) -> DataFrame:
    """(c, root) of parts that each point to another one over a tree edge: of two that point to each other the smaller is
    a root; pointers are doubled until all point to roots."""
    p = best.select("c", F.col("o").alias("root"))
    back = p.select(F.col("c").alias("root"), F.col("root").alias("_back"))
    p = cut(p.join(back, "root").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("root")), F.col("c")).otherwise(F.col("root")).alias("root")))
    while True:
        up = p.select(F.col("c").alias("root"), F.col("root").alias("_up"))
        after = cut(p.join(up, "root").select("c", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")))
        p = after.select("c", "root")
        if after.where("moved").isEmpty():
            return p


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(forest, parts, rounds) of edges (i, j, d): the edges of a minimum spanning forest, ties by (d, i, j), with i < j,
    and (node, part) for every node of an edge; a part is called by its smallest node.

    Loops and edges with a null end or weight say nothing; of repeated edges the lightest counts. The rounds grow with
    the logarithm of the number of nodes.
    """
    live = edges.where("i <> j and d is not null").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    live = cut(live.groupBy("i", "j").agg(F.min("d").alias("d")).select(F.col("i").alias("a"), F.col("j").alias("b"), "i", "j", "d"))
    parts = cut(live.select(F.col("i").alias("node")).union(live.select("j")).distinct().select("node", F.col("node").alias("part")))
    forest, rounds = None, 0
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("c"), F.struct("d", "i", "j", F.col("b").alias("o")).alias("e"))
        ends = ends.union(live.select(F.col("b").alias("c"), F.struct("d", "i", "j", F.col("a").alias("o")).alias("e")))
        best = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.d", "e.i", "e.j", "e.o"))
        chosen = best.select("i", "j", "d").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        roots = _roots(best)
        named = lambda end: roots.select(F.col("c").alias(end), F.col("root").alias(f"_{end}"))
        moved = live.join(named("a"), "a", "left").join(named("b"), "b", "left")
        moved = moved.select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"), "i", "j", "d").where("x <> y")
        lightest = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min(F.struct("d", "i", "j")).alias("e"))
        live = cut(lightest.select("a", "b", "e.i", "e.j", "e.d"))
        parts = cut(parts.join(named("part"), "part", "left").select("node", F.coalesce("_part", "part").alias("part")))
        rounds += 1
    first = parts.groupBy("part").agg(F.min("node").alias("_first"))
    parts = cut(parts.join(first, "part").select("node", F.col("_first").alias("part")))
    return live.select("i", "j", "d") if forest is None else cut(forest), parts, rounds


def _tree(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(rows - 1, 3) of (rank, larger rank, d): the spanning tree of points by their distances, ties by ranks, grown point by point."""
    n, at, found = len(x), 0, []
    open_, d, lo, hi = np.ones(n, bool), np.full(n, np.inf), np.full(n, n), np.full(n, n)
    for _ in range(n - 1):
        open_[at] = False
        away = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        a, b = np.minimum(rank, rank[at]), np.maximum(rank, rank[at])
        nearer = open_ & ((away < d) | ((away == d) & ((a < lo) | ((a == lo) & (b < hi)))))
        d[nearer], lo[nearer], hi[nearer] = away[nearer], a[nearer], b[nearer]
        left = np.flatnonzero(open_)
        ties = left[d[left] == d[left].min()]
        at = ties[np.lexsort((hi[ties], lo[ties]))[0]]
        found.append((lo[at], hi[at], d[at]))
    return np.array(found).reshape(-1, 3)


def euclidean_forests(df: DataFrame, group: str, key: str, vals: str) -> DataFrame:
    """(group, i, j, d): edges among which lies the spanning forest of all pairs of each group, without a table of the pairs.

    A group is dealt into blocks of about BLOCK_ROWS rows (``distance.with_blocks``); each two blocks give the edges of their
    own spanning tree. An edge that is dropped there is the longest of a cycle, so the whole group's tree does without it
    too. A task holds two blocks; the distances are still as many as pairs. Rows without a group, without values, or
    with a value that is null or NaN have no edges, nor have profiles of different width.
    """
    bad = F.exists(vals, lambda v: v.isNull() | F.isnan(v))
    known = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(vals).isNotNull()).where(~bad)
    known = known.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vals).cast("array<double>").alias("v"), F.size(vals).alias("w"))
    own = F.pmod(F.xxhash64("k"), F.col("_blocks")).cast("int")
    others = F.array_except(F.sequence(F.lit(0), F.col("_blocks") - 1), F.array("own"))
    dealt = with_blocks(known, ["g", "w"]).withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("g", "k", "v", "w", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        keys, rank = np.unique(rows["k"].to_numpy(), return_inverse=True)
        found = _tree(np.stack(rows["v"].to_numpy()).astype(float), rank)
        i, j = (keys[found[:, c].astype(int)] for c in (0, 1))
        out = {"g": rows["g"].to_numpy()[:1].repeat(len(found)), "i": i, "j": j, "d": found[:, 2]}
        return pd.DataFrame({n: pd.Series(v, dtype=v.dtype) for n, v in out.items()})

    kind = lambda c: known.schema[c].dataType.simpleString()
    edges = dealt.groupBy("g", "w", "x", "y").applyInPandas(tree, f"g {kind('g')}, i {kind('k')}, j {kind('k')}, d double")
    return edges.where("i <> j").select(F.col("g").alias(group), "i", "j", "d")


def single_linkage(nodes: DataFrame, edges: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """(group, key, part): the rows of each group in at most ``k`` parts that single linkage gives.

    ``edges`` (group, i, j, d) join rows of one group; a part is called by its smallest key. The lowest cut is taken that
    leaves at most k parts, so links of equal length are cut together or not at all; a group of at most k rows stays
    apart. Rows without an edge are parts of their own.
    """
    forest, _, _ = spanning_forest(edges)
    of_group = nodes.select(F.col(key).alias("i"), F.col(group).alias("_g"))
    links = cut(forest.join(of_group, "i"))
    last = Window.partitionBy("_g").orderBy(F.desc("d"))
    cuts = links.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k).where(F.col("_r") == k).select("_g", F.col("d").alias("_t"))
    _, parts, _ = spanning_forest(links.join(cuts, "_g").where(F.col("d") <= F.col("_t")).select("i", "j", "d"))
    return nodes.select(group, key).join(parts.select(F.col("node").alias(key), "part"), key, "left").select(group, key, F.coalesce("part", key).alias("part"))


def constraint_closure(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts, apart) of constraints (i1, i2, is_ml): must-links closed into parts, cannot-links lifted to these.

    parts has (node, part) for every node that a constraint names, part being its smallest node. apart has (part_a,
    part_b, n, contradiction): two parts that may not be one, a before b, with the number of cannot-links that say so; a
    cannot-link within one part contradicts the must-links. Null ends say nothing.
    """
    known = links.where("i1 is not null and i2 is not null")
    _, parts, _ = spanning_forest(known.where("is_ml").select(F.col("i1").alias("i"), F.col("i2").alias("j"), F.lit(0).alias("d")))
    nodes = known.select(F.col("i1").alias("node")).union(known.select("i2")).distinct()
    parts = cut(nodes.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("part")))
    end = lambda i, p: parts.select(F.col("node").alias(i), F.col("part").alias(p))
    lifted = known.where("not is_ml").join(end("i1", "_a"), "i1").join(end("i2", "_b"), "i2")
    apart = lifted.groupBy(F.least("_a", "_b").alias("part_a"), F.greatest("_a", "_b").alias("part_b")).agg(F.count(F.lit(1)).alias("n"))
    return parts, apart.withColumn("contradiction", F.col("part_a") == F.col("part_b"))
