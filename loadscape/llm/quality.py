"""Quality rules: hard limits on counts, and a hashed n-gram log-likelihood ratio of trusted text against the corpus.

Words and word pairs are hashed into BUCKETS; one multinomial is counted over trusted documents, one over all. A
document's score is the mean over its n-grams of the log of the ratio of the two, so length does not matter, and the
document is kept if the score reaches the threshold. The threshold comes from trusted documents, each scored as if it were
not one of them (its own n-grams are taken off the trusted counts): all but a small share of them pass, at every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import map_batches, named, with_made
from loadscape.llm.text import Known, word_chunks

#: Hash buckets and smoothing counts of each bucket. The threshold lies MARGIN below the score that all but UNSEEN_SHARE
#: of the trusted rows reach when left out of the trusted counts.
BUCKETS, SMOOTH = 1 << 16, 1.0
UNSEEN_SHARE, MARGIN = 0.005, 0.05
#: Trusted rows that are used, at most: those with the smallest hash of their id.
MAX_TRUSTED = 20_000
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = b"#*$%&|<>"
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_START = np.array([(x & 0xC0) != 0x80 for x in range(256)])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Grams:
    """Hash buckets of the words and word pairs of a text."""

    def __init__(self, buckets: int = BUCKETS):
        self.mask, self.known = buckets - 1, Known(lambda w: zlib.crc32(w.lower()))

    def __call__(self, text: bytes) -> np.ndarray:
        out, odd = [np.empty(0, np.int64)], 0
        for words in word_chunks(text, 1):
            one = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
            with np.errstate(over="ignore"):
                two = (one[:-1] * _ODD[0] + one[1:] * _ODD[1]) >> np.uint64(40)
            out += [one[odd:].astype(np.int64) & self.mask, two.astype(np.int64) & self.mask]
            odd = 1
        return np.concatenate(out)


def repeated_words(text: bytes) -> int:
    """Words that lie in a window of WINDOW words that the text holds at least twice, the first one included."""
    numbers: dict[bytes, int] = {}
    parts = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64) for words in word_chunks(text)]
    one = np.concatenate([np.empty(0, np.uint64), *parts]) + np.uint64(1)
    n = len(one)
    if n <= WINDOW:
        return 0
    with np.errstate(over="ignore"):
        keys = sum(one[k : n - WINDOW + 1 + k] * _ODD[k] for k in range(WINDOW))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(WINDOW):
        inside[k : n - WINDOW + 1 + k] |= twice
    return int(inside.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len({*lines})


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[ends[1:]] - total[ends[:-1]]


def byte_counts(texts: pa.LargeBinaryArray) -> dict[str, np.ndarray]:
    """n_words, word_chars and n_symbols of each text, over the whole batch at once."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.empty(0, np.uint8)
    ends = ends - ends[0]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < ends[1:]]
    begins[heads] = inside[heads]
    return {"n_words": _sums(begins, ends), "word_chars": _sums(inside & _START[data], ends), "n_symbols": _sums(_SYMBOL[data], ends)}


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, raw, target = Grams(buckets), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            trusted = batch.column("trusted").to_pylist()
            for at in range(0, batch.num_rows, 500):
                part = batch.column("text").slice(at, 500)
                found = [grams(t.as_py() or b"") for t in part]
                raw += np.bincount(np.concatenate(found), minlength=buckets)
                if own := [x for x, yes in zip(found, trusted[at:]) if yes]:
                    target += np.bincount(np.concatenate(own), minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(target[used]), pa.array(raw[used])], names=["bucket", "target", "raw"])

    return run


@dataclass
class Model:
    """ratios: of each bucket, the log of target over corpus. A document of a score below threshold is let go."""

    ratios: np.ndarray
    threshold: float

    def scores(self, grams: Grams, texts: list[bytes]) -> list[float]:
        found = [grams(t) for t in texts]
        return [float(self.ratios[x].mean()) if len(x) else 0.0 for x in found]


def left_out(counts: np.ndarray, found: np.ndarray) -> float:
    """The score of a trusted document by ``counts`` (trusted, all) without its own n-grams among the trusted."""
    if not len(found):
        return 0.0
    used, own = np.unique(found, return_counts=True)
    smooth = SMOOTH * counts.shape[1]
    target = np.log(counts[0, used] - own + SMOOTH) - np.log(counts[0].sum() - len(found) + smooth)
    raw = np.log(counts[1, used] + SMOOTH) - np.log(counts[1].sum() + smooth)
    return float(own @ (target - raw) / len(found))


def _left_out(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(held.value.shape[1])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([left_out(held.value, grams(t.as_py() or b"")) for t in batch.column("text")], pa.float64())], names=["score"])

    return run


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> Model:
    """Learn from the corpus, and from the rows whose ids are in ``id_col`` of ``trusted``.

    The corpus is counted over every row of ``docs``; of trusted ids the ``max_trusted`` with the smallest hash are taken,
    all of them to count and each, left out of the counts, to set the threshold. Without a trusted row, or over an empty
    table, all ratios are zero and nothing is let go. Null ids are not trusted.
    """
    spark = docs.sparkSession
    ids = trusted.select(named(id_col).alias("trusted_id")).where("trusted_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64(F.lit("quality"), "trusted_id"), "trusted_id").limit(max_trusted)
    ids = F.broadcast(spark.createDataFrame(ids.collect(), ids.schema))
    texts = docs.select(named(id_col).alias("id"), named(text_col).cast("string").cast("binary").alias("text"))
    rows = texts.join(ids, F.col("id") == F.col("trusted_id"), "left").select("text", F.col("trusted_id").isNotNull().alias("trusted"))
    counts = np.zeros((2, buckets))
    counted = map_batches(rows, _count(buckets), "bucket bigint, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target"), F.sum("raw"))
    for bucket, target, raw in counted.collect():
        counts[:, bucket] = target, raw
    if not counts[0].any():
        return Model(np.zeros(buckets), -np.inf)
    p = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
    own = texts.join(ids, F.col("id") == F.col("trusted_id")).select("text")
    scored = map_batches(own, _left_out(spark.sparkContext.broadcast(counts)), "score double")
    return Model(np.log(p[0] / p[1]), scored.agg(F.percentile("score", F.lit(UNSEEN_SHARE))).first()[0] - MARGIN)


def judge(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept.

    Words are runs of anything but ASCII white space. base_failed: fewer than MIN_WORDS words, or over
    MAX_REPEAT_PERCENT percent of them in repeated windows. kept: not base_failed, and the score at or above the model's
    threshold. Null and empty texts have no words, score 0 and fail. Equal texts are judged alike, an empty table stays
    empty; other columns are passed on whatever their names, those of the names above replaced.
    """
    new = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "score": "double", "kept": "boolean"}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value
        grams = Grams(len(model.ratios))

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
            out = byte_counts(texts)
            dup, repeat, score = [], [], []
            for text in texts:
                data = text.as_py()
                dup.append(duplicate_lines(data))
                repeat.append(repeated_words(data))
                score += model.scores(grams, [data])
            n, repeated, scores = out["n_words"], np.array(repeat, np.int64), np.array(score, np.float64)
            failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)
            columns = [*out.values(), np.array(dup, np.int64), repeated, failed, scores, ~failed & (scores >= model.threshold)]
            return [*map(pa.array, columns)]

        return work

    return with_made(docs, {"text": named(text_col).cast("string").cast("binary")}, make, new)
