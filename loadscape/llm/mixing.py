"""Mixing sources to target weights: whole copies by the integer part of a rate, one more by a seeded coin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.llm.arrow import free, named, others
from loadscape.llm.scratch import Scratch

WEIGHTS, MAX_RATE, SEED = (5, 2, 1), 3, "mix"
WORDS = r"[^\x20\x09-\x0D]+"
#: Sources, and bytes of their names, up to which the table of rates is sent to all tasks.
SENT_SOURCES, SENT_BYTES = 50_000, 4 << 20


def size_of(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) decided by seed and key: the first 48 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def rates(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the total of all sizes. Targets stop at
    ``max_rate`` times their source's size; what is cut off goes to the others by weight until none is above. Only sums
    reach the driver, once per round. Sources are numbered in one task, so they have to be far fewer than documents.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    table = scratch.table(sizes.select("source", "source_size", weight.cast("long").alias("weight")))
    total, held, level = table.agg(F.sum("source_size")).first()[0] or 0, -1, 0.0
    full = F.lit(False)
    while True:
        capped, cap_size, weight_left = table.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if capped == held or not weight_left:
            break
        held, level = capped, (total - max_rate * (cap_size or 0)) / weight_left
        full = F.col("weight") * F.lit(level) > max_rate * F.col("source_size")
    most = (max_rate * F.col("source_size")).cast("double")
    return table.select("source", "source_size", F.when(full, most).otherwise(F.col("weight") * F.lit(level)).alias("target"))


#: What ``assign_copies`` adds: words, words of the source, words wanted of the source, and copies to take.
ADDED = ("_llm_size", "_llm_source_size", "_llm_target", "_llm_copies")


def assign_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, added: tuple[str, str, str, str] = ADDED, size_col: str | None = None) -> DataFrame:
    """``docs`` with the columns ``added`` (in place of any so called): size, source size, target, copies (0 to ``max_rate``).

    rate = target / source size; a document is taken floor(rate) times, and once more if a number decided by seed and id
    lies below the fraction. Reruns agree, rows that repeat an id fare alike. Null texts have size 0; null ids share one
    number; a null source is a source. Sources without a word get no copies, an empty table stays empty. Sizes are
    summed per source before the shuffle, and documents stay where they are unless there are too many sources to send.
    Where words are already counted, ``size_col`` holds them and no text is read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size, source_size, target, copies = added
    (own,) = free(docs, "_llm_source")
    words = F.coalesce(named(size_col).cast("long"), F.lit(0)) if size_col else size_of(named(text_col))
    by = docs.groupBy(named(source_col).cast("string").alias("source")).agg(F.sum(words).alias("source_size"))
    table = scratch.table(rates(by, scratch, weights, max_rate))
    n, bytes_ = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).first()
    small = n <= SENT_SOURCES and (bytes_ or 0) <= SENT_BYTES
    table = table.select(F.col("source").alias(own), F.col("source_size").alias(source_size), F.col("target").alias(target))
    sized = docs.select(*map(named, others(docs, added)), words.alias(size))
    joined = sized.join(F.broadcast(table) if small else table, named(source_col).cast("string").eqNullSafe(F.col(own)))
    rate = F.coalesce(F.try_divide(F.col(target), F.col(source_size).cast("double")), F.lit(0.0))
    extra = uniform(seed, named(id_col)) < rate - F.floor(rate)
    return joined.withColumn(copies, (F.floor(rate) + extra.cast("int")).cast("int")).drop(own)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """Each row of ``docs`` as many times as ``assign_copies`` says, with its own columns, whatever their names."""
    *added, copy = free(docs, *ADDED, "_llm_copy")
    rows = assign_copies(docs, id_col, text_col, source_col, seed, added=tuple(added)).where(F.col(added[3]) > 0)
    rows = rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(added[3]))))
    return rows.select(*map(named, docs.columns))
