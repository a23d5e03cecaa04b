"""Conditional samplers: for every query (test) a distribution over training rows (pick), as (test, pick, p)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.operators.blocks import cogrouped
from loadscape.operators.counted import numbered, running
from loadscape.operators.digests import Tails
from loadscape.operators.distance import euclidean


#: Cells of a group's running weights.
CELLS = 256


def _digest(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def hash_below(key: Column, seed: str, share: float) -> Column:
    """Whether a key belongs to a share of all keys; decided by the key alone."""
    return _digest(key, seed) < F.lit(f"{int(share * 16**8):08x}")


def fold_of(key: Column, seed: str, folds: int) -> Column:
    return (F.conv(F.substring(_digest(key, seed), 1, 8), 16, 10).cast("long") % folds).cast("int")


def uniform(picks: DataFrame) -> DataFrame:
    """Every pick of a test is as likely."""
    return picks.withColumn("p", 1 / F.count(F.lit(1)).over(Window.partitionBy("test")).cast("double"))


def temperature_band(queries: DataFrame, train: DataFrame, reach: float) -> DataFrame:
    """Days within ``reach`` degrees of the same day kind; else the same weekday and month; else the same month.

    Only days of other years are picked. Temperatures are cut into cells as wide as the reach, so the band is an equality
    join on the cell and its neighbours.
    """
    cell = F.floor(F.col("t") / reach)
    q = queries.select(F.col("date").alias("test"), "weekend", "dow", "month", F.col("t").alias("tq"), F.col("y").alias("yq"), cell.alias("cell"))
    near = q.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    t = train.select(F.col("date").alias("pick"), "weekend", "dow", "month", "t", "y", cell.alias("cell"))
    apart = F.col("yq") != F.col("y")
    band = near.join(t.select("pick", "weekend", "t", "y", "cell"), ["weekend", "cell"]).where(apart & (F.abs(F.col("tq") - F.col("t")) <= reach)).select("test", "pick")
    left = q.join(band.select("test").distinct(), "test", "left_anti")
    second = left.join(t.select("pick", "y", "dow", "month"), ["dow", "month"]).where(apart).select("test", "pick")
    third = left.join(second.select("test").distinct(), "test", "left_anti").join(t.select("pick", "y", "month"), "month").where(apart).select("test", "pick")
    return uniform(band.union(second).union(third))


def share_out(probs: DataFrame, members: DataFrame, cluster: str) -> DataFrame:
    """Probabilities of clusters shared equally by their members. Sizes are joined, so a large cluster stays spread."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    return probs.join(sizes, cluster).join(members, cluster).withColumn("p", F.col("p") / F.col("_n")).drop(cluster, "_n")


def nearest_centroid(queries: DataFrame, train: DataFrame, x: str) -> DataFrame:
    """(test, cluster, p): the nearest cluster mean; p is the chance of each of its members.

    Centroids are few: all of them come to each row as one array, so a row is not multiplied by them; of a test's rows the
    nearest counts.
    """
    centres = train.groupBy("cluster").agg(F.avg(x).alias("_c"), F.count(F.lit(1)).alias("_n")).agg(F.collect_list(F.struct("_c", "cluster", "_n")).alias("_all"))
    best = F.array_min(F.transform("_all", lambda c: F.struct(F.abs(F.col(x) - c["_c"]).alias("d"), c["cluster"].alias("cluster"), c["_n"].alias("_n"))))
    hit = queries.select(F.col("id").alias("test"), x).join(F.broadcast(centres)).select("test", best.alias("b")).where("b is not null")
    hit = hit.groupBy("test").agg(F.min("b").alias("b"))
    return hit.select("test", F.col("b.cluster").alias("cluster"), (1 / F.col("b._n").cast("double")).alias("p"))


def cross_validated_centroids(df: DataFrame, key: str, cluster: str, x: str, fold: str) -> DataFrame:
    """``df`` with guess and d: the cluster whose mean, without the row's own fold, is nearest, and how far it is.

    The means of all folds come from one pass: sums by cluster and fold, less the own fold's. They are few.
    """
    sums = df.groupBy(cluster, fold).agg(F.sum(x).alias("_s"), F.count(F.lit(1)).alias("_n"))
    total = sums.groupBy(cluster).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    all_ = df.select(fold).distinct().join(F.broadcast(total)).join(sums, [cluster, fold], "left").na.fill(0, ["_s", "_n"])
    means = all_.where("_tn > _n").select(fold, F.struct(F.col(cluster).alias("c"), ((F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias("m")).alias("_c"))
    means = means.groupBy(fold).agg(F.collect_list("_c").alias("_all"))
    best = F.array_min(F.transform("_all", lambda c: F.struct(F.round(F.abs(F.col(x) - c["m"]), 12).alias("r"), c["c"].alias("c"), F.abs(F.col(x) - c["m"]).alias("d"))))
    return df.join(means, fold).withColumn("_best", best).withColumns({"guess": F.col("_best.c"), "d": F.col("_best.d")}).drop("_all", "_best")


def cross_validated_energy(df: DataFrame, key: str, cluster: str, x: str, fold: str, vals: str, n: int, seed: str) -> DataFrame:
    """(key, fold, guess, es): each row's energy score under the cluster that a model fitted without its fold gives it.

    The model is ``cross_validated_centroids`` on ``x``; its scenarios are ``n`` members of the guessed cluster outside the
    fold, those with the smallest hashes. How far these lie apart depends on fold and cluster alone, so it is summed once for
    each, not once a row. What a row meets is n scenarios, however large its cluster; NULL where the cluster has none.
    """
    guessed = cross_validated_centroids(df.select(key, cluster, x, fold, vals), key, cluster, x, fold)
    least = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_s"))
    rows = df.select(F.col(cluster).alias("_c"), F.col(fold).alias("_own"), F.col(key).alias("_s"), F.col(vals).alias("_v"), _digest(F.col(key), seed).alias("_h"))
    few = rows.withColumn("_r", least(["_c", "_own"])).where(F.col("_r") <= n)
    folds = df.select(F.col(fold).alias("_f")).distinct()
    drawn = few.join(F.broadcast(folds), F.col("_own") != F.col("_f")).withColumn("_r", least(["_f", "_c"])).where(F.col("_r") <= n).select("_f", "_c", "_s", "_v")
    other = drawn.select("_f", "_c", F.col("_s").alias("_s2"), F.col("_v").alias("_v2"))
    apart = drawn.join(other, ["_f", "_c"]).groupBy("_f", "_c").agg((F.sum(euclidean(F.col("_v"), F.col("_v2"))) / (2 * F.count(F.lit(1)))).alias("_apart"))
    near = guessed.join(drawn, (F.col(fold) == F.col("_f")) & (F.col("guess") == F.col("_c")), "left")
    near = near.groupBy(key, fold, "guess").agg(F.avg(euclidean(F.col(vals), F.col("_v"))).alias("_near"))
    found = near.join(F.broadcast(apart), (F.col(fold) == F.col("_f")) & (F.col("guess") == F.col("_c")), "left")
    return found.select(key, fold, "guess", (F.col("_near") - F.col("_apart")).alias("es"))


#: Rows and tests of a block in which tests draw.
DRAWN_ROWS, DRAWING_TESTS = 32_768, 2_000


def draw(queries: DataFrame, train: DataFrame, n: int, seed: str) -> DataFrame:
    """n picks without replacement per test, by hash of both keys. Tests are a stated query set, held against all rows.

    A block of tests and a block of rows meet in one task, which hashes all their pairs and keeps a test's n smallest: the n
    smallest of all are among them, so no row for each pair leaves a task. Null picks come last.
    """
    kinds = {"test": queries.schema["test"].dataType, "pick": train.schema["pick"].dataType}
    sides = (queries.select("test"), "test", F.lit(f"{seed}:"), F.lit(":")), (train.select("pick"), "pick", F.lit(""), F.lit(""))
    asked, rows = (d.withColumn("_text", F.concat(before, F.col(c).cast("string"), after)) for d, c, before, after in sides)
    tests, parts = max(1, -(-asked.count() // DRAWING_TESTS)), max(4, -(-rows.count() // DRAWN_ROWS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = asked.withColumns({"_x": own("test", tests), "_y": every(parts)})
    right = rows.withColumns({"_y": own("pick", parts), "_x": every(tests)})

    def least(a: pa.Table, b: pa.Table) -> pa.Table:
        texts = b.column("_text").to_pylist()
        known, none = [i for i, x in enumerate(texts) if x is not None], [i for i, x in enumerate(texts) if x is None]
        tails, found = Tails([texts[i].encode() for i in known]), []
        for i, head in enumerate(a.column("_text").to_pylist()):
            best = [(i, known[j], digest) for digest, j in tails.least(head.encode(), n)] if head is not None else []
            spare = none if head is not None else range(len(texts))
            found += best + [(i, j, None) for j in spare[: max(0, n - len(best))]]
        i, j = (pa.array([x[k] for x in found], pa.int64()) for k in (0, 1))
        return pa.table({"test": a.column("test").take(i), "pick": b.column("pick").take(j), "_h": pa.array([x[2] for x in found], pa.binary())})

    schema = f"test {kinds['test'].simpleString()}, pick {kinds['pick'].simpleString()}, _h binary"
    met = cogrouped(left, right, ["_x", "_y"], tests * parts).applyInArrow(least, schema)
    w = Window.partitionBy("test").orderBy(F.asc_nulls_last("_h"), "pick")
    return uniform(met.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).select("test", "pick"))


def numbered_draws(queries: DataFrame, train: DataFrame, n: int, seed: str) -> DataFrame:
    """(test, pick, p): n different picks per test, every set of n as likely, without meeting all rows: the work grows with tests.

    Picks are numbered in their order. Of N numbers, step j from N - n to N - 1 draws one of 0 to j by hash of test and
    step, and takes j itself if that one is taken (Floyd's sampling). Fewer than n rows are all picked; repeated picks count
    once, null ones and tests over an empty table give nothing.
    """
    rows = numbered(train.where("pick is not null"), "pick").select(F.col("value").alias("pick"), F.col("number").alias("_k"))
    size = rows.agg(F.count(F.lit(1)).alias("_n"))

    def step(taken: Column, j: Column) -> Column:
        key = F.concat(F.col("test").cast("string"), F.lit(":"), j.cast("string"))
        u = F.conv(F.substring(_digest(key, seed), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
        at = F.floor(u * (j + 1))
        return F.concat(taken, F.array(F.when(F.array_contains(taken, at), j).otherwise(at)))

    steps = F.sequence(F.greatest(F.col("_n") - n, F.lit(0)), F.col("_n") - 1)
    asked = queries.select("test").join(F.broadcast(size.where("_n > 0")))
    drawn = asked.select("test", F.aggregate(steps, F.array().cast("array<bigint>"), step).alias("_all"))
    return drawn.select("test", (1 / F.size("_all").cast("double")).alias("p"), F.explode("_all").alias("_k")).join(rows, "_k").select("test", "pick", "p")


def by_key(queries: DataFrame, train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All training rows that share the query's keys."""
    return uniform(queries.join(train, list(keys)).select("test", "pick"))


def weighted_draws(queries: DataFrame, train: DataFrame, group: str, weight: str, n: int, seed: str) -> DataFrame:
    """(test, n, pick): n draws with replacement per test among the training rows of its group, by weight.

    Each draw is a number decided by hash, which falls into one pick's share of the group's running weights. Shares and
    draws meet in cells of the group's total, so a draw sees the picks of its cell only; weights run up range by range, so
    no task sees a whole group.
    """
    rows = running(train.select("pick", group, F.col(weight).alias("_w")), "pick", ["_w"], [group])
    shares = rows.select("pick", group, "_w", (F.col("_w_below") + F.col("_w")).alias("_hi"), F.col("_w_total").alias("_total"))
    draws = queries.select("test", group, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("n"))
    key = F.concat(F.col("test").cast("string"), F.lit(":"), F.col("n").cast("string"))
    u = F.conv(F.substring(_digest(key, seed), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    at = F.col("_u") * F.col("_total")
    cell = lambda x: F.least(F.greatest(F.floor(x * CELLS), F.lit(0)), F.lit(CELLS - 1)).cast("int")
    # a cell more on either side, so that rounding loses no draw
    near = F.sequence(F.greatest(cell((F.col("_hi") - F.col("_w")) / F.col("_total")) - 1, F.lit(0)), F.least(cell(F.col("_hi") / F.col("_total")) + 1, F.lit(CELLS - 1)))
    spread = shares.where(F.col("_total") > 0).withColumn("_cell", F.explode(near))
    met = draws.withColumn("_u", u).withColumn("_cell", cell(F.col("_u"))).join(spread, [group, "_cell"])
    return met.where((at >= F.col("_hi") - F.col("_w")) & (at < F.col("_hi"))).select("test", "n", "pick")


#: Parts into which the tests of a join are dealt, so that the rows of a few large clusters are made by many tasks.
PARTS = 64


def spread_join(asked: DataFrame, members: DataFrame, on: Sequence[str], pick: str = "pick") -> DataFrame:
    """``asked`` joined with ``members``: members are dealt into PARTS and each asked row goes to all of them.

    What is asked is few beside its members or what comes of them; a cluster's pairs are then made by as many tasks.
    """
    own = F.pmod(F.xxhash64(pick), F.lit(PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    # as many partitions as are named: by their few bytes Spark would take a handful of tasks for all that comes of them
    sides = (d.withColumn("_part", part).repartition(2 * PARTS, *on, "_part") for d, part in ((asked, every), (members, own)))
    return next(sides).join(next(sides).hint("shuffle_hash"), [*on, "_part"]).drop("_part")


def two_level(cluster_probs: DataFrame, members: DataFrame, cluster: str, same: Sequence[str]) -> DataFrame:
    """(test, pick, p): a cluster's probability times an equal share among its members that agree in ``same``."""
    sizes = members.groupBy(cluster, *same).agg(F.count(F.lit(1)).alias("_n"))
    asked = cluster_probs.join(sizes, [cluster, *same])
    return spread_join(asked, members, [cluster, *same]).select("test", "pick", (F.col("p") / F.col("_n")).alias("p"))
