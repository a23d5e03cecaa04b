"""Fill-in-middle transformation over an index of distinct texts.

Where a text's tokens end is found once for every distinct text and kept as an Elias-Fano list (some 4 bits a token);
each document that bears the text selects its two cuts from the list. Texts that occur once, as nearly all do, are cut
where they lie. Rows whose text's hash is met again (a filter of bounded size tells, and may say so of a few more) take
the other way: their texts are grouped by whole content, indexed, and joined back to the documents, which carry ids and
seeds only, so a copy of a text is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import free, kept_where, named, others, with_made
from loadscape.llm.scratch import Scratch

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT_PERCENT, SPM_PERCENT = 42, 50, 80
#: Bits of the filter for each repeated hash, and at most (16 MB go to all tasks). A full filter only sends more rows
#: through the index; the result is the same.
BITS_PER_HASH, MAX_BITS = 16, 1 << 27
#: A text whose copies hold over so many bytes is met by several tasks; there are at most HOT_TEXTS such texts.
HOT_BYTES, HOT_TEXTS = 64 << 20, 100_000


def token_ends(text: str) -> np.ndarray:
    """Code points before the end of each token: white space with the word behind it, or white space at the end."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = (c - np.uint32(9) <= 4) | (c == 32)
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(c)) if len(c) and space[-1] else ends


@dataclass
class EliasFano:
    """Ascending numbers: ``low`` has the lowest ``width`` bits of each, ``high`` the rest as a bit map of gaps."""

    n: int
    width: int
    low: bytes
    high: bytes

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        n = len(numbers)
        if not n:
            return cls(0, 0, b"", b"")
        x = numbers.astype(np.int64)
        width = max(0, (int(x[-1]) // n).bit_length() - 1)
        bits = (x[:, None] >> np.arange(width) & 1).astype(np.uint8)
        high = np.zeros((int(x[-1]) >> width) + n, np.uint8)
        high[(x >> width) + np.arange(n)] = 1
        return cls(n, width, np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes())

    def select(self, k: int) -> int:
        """Number k, from 0."""
        words = np.frombuffer(self.high + bytes(-len(self.high) % 8), "<u8")
        before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        w = int(np.searchsorted(before, k + 1))
        rest = k - (int(before[w - 1]) if w else 0)
        word = int(words[w])
        for _ in range(rest):
            word &= word - 1
        high = 64 * w + (word & -word).bit_length() - 1 - k
        at = k * self.width
        piece = int.from_bytes(self.low[at // 8 : (at + self.width + 7) // 8], "little") >> at % 8 & (1 << self.width) - 1
        return high << self.width | piece

    def end_of(self, units: int) -> int:
        """Code points in the first so many tokens."""
        return self.select(units - 1) if units else 0


def _seeds(doc_id: Column) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def form_of(text: str, h3: int, h4: int) -> str:
    if not text or h3 % 100 >= CUT_PERCENT or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return "plain"
    return "spm" if h4 % 100 < SPM_PERCENT else "psm"


def cut(text: str, ends: EliasFano, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of prefix and middle, output)."""
    form = form_of(text, h3, h4)
    if form == "plain":
        return ends.n, form, None, None, text
    a, b = (ends.end_of(k) for k in sorted((h1 % (ends.n + 1), h2 % (ends.n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    first = PREFIX + prefix + SUFFIX + suffix if form == "psm" else SUFFIX + suffix + PREFIX + prefix
    return ends.n, form, a, b - a, first + MIDDLE + middle


NEW = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output": "string"}


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)]


def _cut_here() -> Callable:
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, seeds = batch.column("text").to_pylist(), zip(*(batch.column(f"h{k}").to_pylist() for k in range(4)))
        return _columns([cut(t, EliasFano.of(token_ends(t)), *h) for t, h in zip(texts, seeds)])

    return work


def _cut_indexed() -> Callable:
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = map(EliasFano, *(batch.column(c).to_pylist() for c in ("units", "width", "low", "high")))
        texts, seeds = batch.column("text").to_pylist(), zip(*(batch.column(f"h{k}").to_pylist() for k in range(4)))
        return _columns([cut(t, e, *h) for t, e, h in zip(texts, lists, seeds)])

    return work


def _index() -> Callable:
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [EliasFano.of(token_ends(t)) for t in batch.column("text").to_pylist()]
        kinds = (("n", pa.int64()), ("width", pa.int64()), ("low", pa.binary()), ("high", pa.binary()))
        return [pa.array([getattr(e, c) for e in found], k) for c, k in kinds]

    return work


@dataclass
class Filter:
    """Whether a hash may be repeated: two bits of one word."""

    words: np.ndarray

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.astype(np.int64)
        bits = np.int64(1) << (h & 63) | np.int64(1) << (h >> 6 & 63)
        return self.words[(h >> 12) % len(self.words)] & bits == bits if len(self.words) else np.zeros(len(h), bool)


def _filter(repeated: DataFrame, n: int, max_bits: int) -> Filter:
    size = min(max_bits, 64 * -(-BITS_PER_HASH * n // 64)) // 64
    if not size:
        return Filter(np.zeros(0, np.int64))
    h, one = F.col("hash"), F.lit(1).cast("bigint")
    bits = F.call_function("shiftleft", one, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseOR(F.call_function("shiftleft", one, F.shiftright(h, 6).bitwiseAND(F.lit(63)).cast("int")))
    filled = repeated.groupBy(F.pmod(F.shiftright(h, 12), F.lit(size)).alias("word")).agg(F.bit_or(bits).alias("bits")).toArrow()
    words = np.zeros(size, np.int64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    return Filter(words)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the text, with n (tokens), form, prefix_chars, middle_chars and output; one row per row.

    Null texts count as empty, and empty texts and those that hold a marker stay plain; a null id is a seed of its own,
    and rows of equal id and text are cut alike. Texts may be of any length; other columns go along, those of the new
    names are replaced; an empty table stays empty. Grouping compares whole texts, and a document finds its text by
    SHA-256 and length.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "fillmiddle")
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    kept = others(docs, [text_col, *NEW])
    names = [f"_{i}" for i in range(len(kept))]
    seeds = [h.alias(f"_h{k}") for k, h in enumerate(_seeds(named(id_col)))]
    rows = docs.select(*[named(c).alias(a) for c, a in zip(kept, names)], *seeds, text.alias("_text"), F.xxhash64(text).alias("hash"))
    seed_inputs = {f"h{k}": F.col(f"_h{k}") for k in range(4)}

    counted = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.max(F.octet_length("_text")).alias("bytes"))
    repeated = scratch.table(counted.where("copies > 1"))
    n, most = repeated.agg(F.count(F.lit(1)), F.sum(F.col("copies").cast("double") * F.col("bytes"))).first()
    held = spark.sparkContext.broadcast(_filter(repeated, n, max_bits))

    def passing(yes: bool) -> Callable:
        def make() -> Callable:
            return lambda batch: held.value(batch.column("hash").to_numpy()) == yes

        return make

    alone = kept_where(rows, {"hash": F.col("hash")}, passing(False)).drop("hash")
    alone = with_made(alone, {"text": F.col("_text"), **seed_inputs}, _cut_here, NEW)

    key = [F.sha2(F.col("_text").cast("binary"), 256).alias("sha"), F.octet_length("_text").alias("size")]
    texts = kept_where(rows.select("_text", "hash"), {"hash": F.col("hash")}, passing(True)).select("_text").distinct()
    index = with_made(texts, {"text": F.col("_text")}, _index, {"units": "bigint", "width": "bigint", "low": "binary", "high": "binary"})
    hot_bytes = max(HOT_BYTES, (most or 0) / HOT_TEXTS)
    shares = F.ceil(F.col("copies").cast("double") * F.col("bytes") / F.lit(float(hot_bytes))).cast("int")
    hot = repeated.select("hash", shares.alias("shares")).where("shares > 1")
    hot = F.broadcast(spark.createDataFrame(hot.collect(), "hash bigint, shares int"))

    index = index.withColumn("hash", F.xxhash64("_text")).join(hot, "hash", "left")
    index = index.select(*key, "_text", "units", "width", "low", "high", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
    narrow = rows.select(*names, *[f"_h{k}" for k in range(4)], *key, "hash")
    narrow = kept_where(narrow, {"hash": F.col("hash")}, passing(True)).join(hot, "hash", "left")
    spread = F.pmod(F.xxhash64(*[f"_h{k}" for k in range(4)]), F.coalesce("shares", F.lit(1)).cast("bigint")).cast("int")
    met = narrow.withColumn("share", spread).join(index, ["sha", "size", "share"])
    again = with_made(met, {"text": F.col("_text"), **{c: F.col(c) for c in ("units", "width", "low", "high")}, **seed_inputs}, _cut_indexed, NEW)
    return alone.select(*names, *NEW).union(again.select(*names, *NEW)).toDF(*kept, *NEW)


def restored(form: Column, output: Column) -> Column:
    """The text that a form and output were made of. No text that is cut holds a marker, so each marker occurs once."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
