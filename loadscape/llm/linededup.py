"""Lines that many documents share are dropped from all but one of them.

Two Bloom filters hold the hashes of line keys seen at least once and at least twice. Each task fills a pair of its own;
pairs are merged slice by slice (what two pairs have both seen once has been seen twice), so the merged twice-filter lets
every repeated key pass and few others. Only lines that pass it are shuffled, as SHA-256 digests, to be counted exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import free, gathered, map_batches, named, with_made
from loadscape.llm.scratch import Scratch

SPACE = b" \t\n\v\f\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of a filter for each line expected, at an expected line length, and at most: the twice-filter that is sent to
#: all tasks has at most MAX_BITS / 8 = 128 MB. A full filter only lets more lines be counted; the result is the same.
BITS_PER_LINE, LINE_CHARS, MIN_BITS, MAX_BITS = 10, 80, 1 << 20, 1 << 30
#: Filter words that are merged as one.
SLICE = 1 << 14


def line_keys(text: bytes | None, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text and each one's key (stripped, A-Z lower-cased), None for a key that is too short."""
    lines = (text or b"").split(b"\n")
    keys = [line.strip(SPACE) for line in lines]
    return lines, [k.lower() if len(k) >= min_chars and (len(k) >= 4 * min_chars or len(k.decode()) >= min_chars) else None for k in keys]


def _bits(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of each hash, and its four bits there."""
    one, low = np.uint64(1), np.uint64(63)
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= one << (hashes >> np.uint64(shift) & low)
    return (hashes >> np.uint64(24)).astype(np.int64) % words, mask


def _ranked(words: np.ndarray) -> Iterator[np.ndarray]:
    """Places in rounds, so that no word comes twice in a round."""
    order = np.argsort(words, kind="stable")
    w, at = words[order], np.arange(len(words))
    rank = at - np.maximum.accumulate(np.where(np.concatenate(([True], w[1:] != w[:-1])), at, 0))
    by = np.argsort(rank, kind="stable")
    yield from np.split(order[by], np.cumsum(np.bincount(rank))[:-1])


def _fill(words: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        for batch in batches:
            found = [xxhash.xxh64_intdigest(k) for t in batch.column(0) for k in {*line_keys(t.as_py(), min_chars)[1]} - {None}]
            hashes, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            if not len(hashes):
                continue
            word, mask = _bits(hashes, words)
            for at in _ranked(word):
                w, m = word[at], mask[at]
                again = (counts[at] > 1) | (once[w] & m == m)
                twice[w] |= np.where(again, m, np.uint64(0))
                once[w] |= m
        used = np.flatnonzero(once)
        for at in np.array_split(used, -(-len(used) // 65536) or 1):
            yield pa.RecordBatch.from_arrays([pa.array(at // SLICE), pa.array(at % SLICE), pa.array(once[at].view(np.int64)), pa.array(twice[at].view(np.int64))], names=["slice", "word", "once", "twice"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The twice-filter of each slice; a task holds the slices that it was dealt."""
    held: dict[int, np.ndarray] = {}
    for batch in gathered(batches, 10_000):
        slices, words = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        once, twice = (batch.column(k).to_numpy().view(np.uint64) for k in (2, 3))
        for s in np.unique(slices).tolist():
            own = np.flatnonzero(slices == s)
            pair = held.setdefault(s, np.zeros((2, SLICE), np.uint64))
            for at in _ranked(words[own]):
                rows = own[at]
                pair[1, words[rows]] |= twice[rows] | (pair[0, words[rows]] & once[rows])
                pair[0, words[rows]] |= once[rows]
    for s, pair in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([pair[1].tobytes()], pa.binary())], names=["slice", "twice"])


def twice_seen(texts: DataFrame, words: int, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The filter words of keys that at least two of the texts in the only column hold, and of few others."""
    filled = map_batches(texts, _fill(words, min_chars), "slice bigint, word bigint, once bigint, twice bigint")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(words, np.uint64)
    for s, twice in map_batches(filled.repartition(n, "slice"), _merge, "slice bigint, twice binary").collect():
        out[s * SLICE : (s + 1) * SLICE] = np.frombuffer(twice, np.uint64)[: words - s * SLICE]
    return out


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell a row's id and text."""
    one, text = named(id_col), named(text_col).cast("string")
    return [F.xxhash64(one, text), F.xxhash64(text, F.lit("b"), one)]


def _suspects(held, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = held.value
        for batch in batches:
            rows, digests = [], []
            for i, t in enumerate(batch.column("text")):
                keys = [*({*line_keys(t.as_py(), min_chars)[1]} - {None})]
                if keys:
                    word, mask = _bits(np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64), len(twice))
                    for k in np.flatnonzero(twice[word] & mask == mask).tolist():
                        rows.append(i)
                        digests.append(hashlib.sha256(keys[k]).digest())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:3]], pa.array(digests, pa.binary())], names=["row_a", "row_b", "id", "digest"])

    return run


def _drop(min_chars: int):
    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        total, gone, texts = [], [], []
        for text, drops in zip(batch.column("text"), batch.column("drops").to_pylist()):
            lines, keys = line_keys(text.as_py(), min_chars)
            drops = {*(drops or ())}
            left = [x for x, k in zip(lines, keys) if k is None or hashlib.sha256(k).digest() not in drops] if drops else lines
            total.append(len(lines))
            gone.append(len(lines) - len(left))
            texts.append(b"\n".join(left))
        return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]

    return work


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with ``text_col`` less its repeated lines, and n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased. Keys of at least ``min_chars`` code
    points that at least ``min_docs`` ids hold lose all their lines, but in the rows of the largest of those ids. A null
    or empty text is one empty line. Rows that repeat an id count as one document; all null ids count as one, which is
    the smallest. Lines of any length are told by digest. Existing columns n_lines and n_dropped are replaced, all
    others go along whatever their names; an empty table stays empty. Beyond ``max_bits`` the filters let ever more
    lines be counted exactly: the result stays the same, and what is shuffled grows to one digest for each line.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "linededup")
    one, text = named(id_col), named(text_col).cast("string")
    lines = (docs.agg(F.sum(F.length(text))).first()[0] or 0) / LINE_CHARS
    bits = MIN_BITS
    while bits < min(max_bits, lines * BITS_PER_LINE):
        bits *= 2
    binary = text.cast("binary").alias("text")
    held = spark.sparkContext.broadcast(twice_seen(docs.select(binary), bits // 64, min_chars))
    row_a, row_b = _row_keys(id_col, text_col)
    rows = docs.select(row_a.alias("row_a"), row_b.alias("row_b"), one.alias("id"), binary)
    kind = rows.schema["id"].dataType.simpleString()
    suspects = scratch.table(map_batches(rows, _suspects(held, min_chars), f"row_a bigint, row_b bigint, id {kind}, digest binary"))
    once = suspects.select("digest", "id").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep"))
    once = scratch.table(once.where(F.col("n") >= min_docs))
    gone = suspects.join(once, "digest").where(~F.col("id").eqNullSafe(F.col("keep")))
    a, b, lost = free(docs, "_row_a", "_row_b", "_drops")
    drops = gone.groupBy(F.col("row_a").alias(a), F.col("row_b").alias(b)).agg(F.collect_set("digest").alias(lost))
    joined = docs.withColumns({a: row_a, b: row_b}).join(drops, [a, b], "left").select(*map(named, docs.columns), lost)
    out = with_made(joined, {"text": text.cast("binary"), "drops": F.col(lost)}, lambda: _drop(min_chars), {text_col: "string", "n_lines": "bigint", "n_dropped": "bigint"})
    return out.drop(lost)
