"""Sharding by rendezvous hashing: each key goes to the shard with the best score, so few keys move with the count."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.llm.arrow import free, named
from loadscape.llm.scratch import Scratch

SHARDS = 16


def _draw(key: Column, shard: int) -> Column:
    """52 bits decided by key and shard."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{shard}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: of shard i with weight w the score is ln(u) / w, u decided by key and i; the best one wins.

    Equal weights need no logarithm. A shard of weight zero takes no key. Ties go to the first shard. A null key is a key.
    """
    if len({*weights}) == 1:
        scores = {i: _draw(key, i) for i in range(len(weights))}
    else:
        scores = {i: F.ln((_draw(key, i) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(w)) for i, w in enumerate(weights) if w}
    best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("shard")) for i, s in scores.items()]))
    return -best["shard"]


def assign_shards(docs: DataFrame, id_col: str = "doc_id", shards: int | Sequence[float] = SHARDS, shard_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row, decided by its id and the shards (a count, or their weights) alone.

    Nothing is shuffled. Equal ids, null among them, share a shard; an empty table stays empty. An existing column of
    that name is replaced. Weights are finite and not negative, and a shard of weight zero takes no rows; without a shard
    of a weight above zero there is a ValueError.
    """
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not all(math.isfinite(w) and w >= 0 for w in weights) or not any(weights):
        raise ValueError(f"shards need finite weights of at least zero, one of them above it: {shards}")
    shard = shard_of(named(id_col), weights)
    if shard_col.lower() in map(str.lower, docs.columns):
        return docs.select(*[shard.alias(c) if c.lower() == shard_col.lower() else named(c) for c in docs.columns])
    return docs.select("*", shard.alias(shard_col))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number_within(rows: DataFrame, group_col: str, order_cols: Sequence[str], slot_col: str, scratch: Scratch) -> DataFrame:
    """``rows`` with a gapless number from 0 within each group, in the order given (null first); ties get some order.

    Rows are dealt by range over group, order and a row number, so no group and no key has to fit in a task; each range
    counts its rows, and the counts before it are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, part, own, inside = free(rows, "_row", "_part", "_own", "_inside")
    group, order = named(group_col), [*map(named, order_cols)]
    numbered = scratch.table(rows.withColumn(row, F.monotonically_increasing_id()))
    dealt = scratch.table(numbered.repartitionByRange(n, group, *order, row).withColumn(own, F.spark_partition_id()))
    counts = dealt.groupBy(F.col(own).alias(part), group.alias("group")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("group").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(part, "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).alias("starts")
    within = F.row_number().over(Window.partitionBy(own, group).orderBy(*order, row)) - 1
    out = dealt.withColumn(inside, within).alias("dealt")
    out = out.join(starts, (F.col(own) == F.col(part)) & F.col(f"dealt.{_quoted(group_col)}").eqNullSafe(F.col("starts.group")))
    kept = [F.col(f"dealt.{_quoted(c)}") for c in rows.columns]
    return out.select(*kept, (F.col("starts.start") + F.col(inside)).cast("long").alias(slot_col))
