"""Toxicity: cumulative-link ordinal regression on sparse word features.

One weight per feature is shared across the ordered thresholds: P(grade <= k) = logistic(threshold_k - w.x). The expected
severity of a text is the sum over k of P(grade > k). Features are hashed words, their beginnings and the letter runs of
GRAM letters in them (so that inflected and compounded words are known by their stems), kept if they tell toxic from clean labelled texts
beyond chance, with log(1 + count) as value, so that a long clean text does not gather weight. A run without spaces that
is longer than a word is read in blocks, which count like words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import map_batches, named, with_made
from loadscape.llm.scratch import Scratch
from loadscape.llm.text import Known, plain, word_chunks

BUCKETS, GRAM = 1 << 22, 5
#: Letter runs that start in one block of a word; words of no more bytes are remembered.
BLOCK = 100
#: Labelled rows that are learned from, at most: those with the smallest hash of their id. The least likelihood-ratio
#: statistic (G2) of a feature, and the least share of toxic texts among those that hold it.
MAX_ROWS, MIN_G2, MIN_SHARE = 20_000, 15.0, 0.6
#: Toxic rows with so many toxic words or more have the next grade.
GRADE_AT = 3
#: Groups of features that a task remembers from one text to the next.
MAX_GROUPS = 100_000
STEPS, RATE, L2 = 600, 0.1, 1e-4
#: Clean texts lie near 0 and one toxic word is rare, so a text is flagged well before toxic is the likelier grade.
FLAG_AT = 0.25


def blocks_of(word: bytes) -> Iterator[tuple[int, ...]]:
    """Buckets of a word, its beginning and its runs of GRAM letters, the ends of the word included, BLOCK runs at a time."""
    w = plain(word)
    marked = f"<{w}>" if w else ""
    for at in range(0, max(len(marked) - GRAM + 1, bool(w)), BLOCK):
        block = marked[at : at + BLOCK + GRAM - 1]
        runs = (block[i : i + GRAM] for i in range(len(block) - GRAM + 1))
        yield tuple({zlib.crc32(x.encode()) % BUCKETS for x in ((marked, marked[: GRAM - 1], *runs) if at == 0 else runs)})


def buckets_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word of one block."""
    return next(blocks_of(word), ())


def split_long(words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Words of at most BLOCK bytes, and those above."""
    if max(map(len, words)) <= BLOCK:
        return words, []
    return [w for w in words if len(w) <= BLOCK], [w for w in words if len(w) > BLOCK]


@dataclass
class Model:
    """buckets: of the features, sorted. weights: of the features. thresholds: ascending, one less than the grades."""

    buckets: list[int] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thresholds: np.ndarray = field(default_factory=lambda: np.full(2, np.inf))

    def severity(self, x: np.ndarray) -> np.ndarray:
        """(rows, thresholds) of P(grade > k) for scores w.x."""
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(self.thresholds[None, :] - x[:, None]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, clean and toxic."""
    clean, toxic, known = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32), Known(buckets_of)
    for batch in batches:
        for text, grade in zip(batch.column("text"), batch.column("grade").to_pylist()):
            own: set[int] = set()
            for words in word_chunks(text.as_py() or b""):
                words, long = split_long(words)
                own.update(*map(known.__getitem__, {*words}))
                for word in {*long}:
                    own.update(*blocks_of(word))
            (toxic if grade else clean)[np.fromiter(own, np.int64, len(own))] += 1
    used = np.flatnonzero(clean + toxic)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(clean[used].astype(np.int64)), pa.array(toxic[used].astype(np.int64))], names=["bucket", "clean", "toxic"])


class Features:
    """Counts of the model's features in a text. Words are known by the group of features that they hold."""

    def __init__(self, buckets: list[int]):
        self.place = {b: i for i, b in enumerate(buckets)}
        self.clear()

    def clear(self) -> None:
        self.groups: list[list[int]] = [[]]
        self.numbers: dict[tuple[int, ...], int] = {(): 0}
        self.known = Known(lambda word: self._group(buckets_of(word)))

    def _group(self, block: tuple[int, ...]) -> int:
        own = tuple(sorted(self.place[b] for b in block if b in self.place))
        if own not in self.numbers:
            self.numbers[own] = len(self.groups)
            self.groups.append([*own])
        return self.numbers[own]

    def __call__(self, text: bytes | None) -> tuple[list[int], list[int], int]:
        """(features in the text, count of each, number of words with a feature)."""
        if len(self.groups) > MAX_GROUPS:
            self.clear()
        out: Counter[int] = Counter()
        for words in word_chunks(text or b""):
            words, long = split_long(words)
            found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            out.update(found[found > 0].tolist())
            out.update(g for word in long for g in map(self._group, blocks_of(word)) if g)
        counts: Counter[int] = Counter()
        for g, n in out.items():
            for i in self.groups[g]:
                counts[i] += n
        at = sorted(counts)
        return at, [counts[i] for i in at], sum(out.values())


def _vectors(buckets: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            if not batch.num_rows:
                continue
            at, values, hits = zip(*[features(t.as_py()) for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(hits, pa.int64()), pa.array(at, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.int64()))], names=["grade", "hits", "at", "n"])

    return run


@dataclass
class Sparse:
    """Values at (row, column) of a matrix of the given shape, zero elsewhere."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.shape[1])


def _regress(x: np.ndarray | Sparse, y: np.ndarray, grades: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the most likely cumulative-link model, by gradient steps (Adam).

    ``weight`` says how many texts each row stands for: most texts hold no feature and are one row.
    """
    if not isinstance(x, Sparse):
        x = Sparse(*np.nonzero(x), x[np.nonzero(x)].astype(np.float64), x.shape)
    d = x.shape[1]
    weight = np.ones(x.shape[0]) if weight is None else weight
    weight = weight / weight.sum()
    share = np.array([weight[y <= k].sum() for k in range(grades - 1)]).clip(1e-6, 1 - 1e-6)
    start = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(d), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, cuts = p[:d], p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))
        score = x.times(w)
        low = np.concatenate(([-np.inf], cuts))[y] - score
        high = np.concatenate((cuts, [np.inf]))[y] - score
        f_low, f_high = 1 / (1 + np.exp(-low.clip(-500, 500))), 1 / (1 + np.exp(-high.clip(-500, 500)))
        f_low, f_high = np.where(np.isneginf(low), 0.0, f_low), np.where(np.isposinf(high), 1.0, f_high)
        chance = np.maximum(f_high - f_low, 1e-12)
        g_low, g_high = -weight * f_low * (1 - f_low) / chance, weight * f_high * (1 - f_high) / chance
        by_cut = np.array([g_high[y == k].sum() + g_low[y == k + 1].sum() for k in range(grades - 1)])
        tail = np.cumsum(by_cut[::-1])[::-1]
        g = -np.concatenate((-x.transposed_times(g_low + g_high) - L2 * w, tail[:1], tail[1:] * np.exp(p[d + 1 :])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:d], p[d] + np.concatenate(([0.0], np.cumsum(np.exp(p[d + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learn from labelled rows; ``grade_col`` is 0 for clean and more for toxic rows.

    Rows labelled only 0 and 1 are graded by what they hold: toxic rows with GRADE_AT or more toxic words get grade 2.
    Equal texts count once, by their largest grade. Null labels and labels of ids that no document has are left out, an id labelled twice counts by its largest grade.
    Without toxic or without clean texts, or without a telling feature: a model that gives every text severity 0.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    known = labels.select(named(id_col).alias("id"), named(grade_col).cast("int").alias("grade")).where("id is not null and grade is not null")
    known = known.groupBy("id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    known = spark.createDataFrame(known.collect(), known.schema)
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").cast("binary").alias("text")).join(F.broadcast(known), "id")
    rows = scratch.table(rows.groupBy("text").agg(F.max("grade").alias("grade")))
    size = {bool(g): n for g, n in rows.groupBy((F.col("grade") > 0).alias("g")).count().collect()}
    if len(size) < 2:
        scratch.drop(rows)
        return Model()
    counts = map_batches(rows, _count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, share = F.col("toxic") + F.col("clean"), size[True] / sum(size.values())
    g2 = 2 * (F.col("toxic") * F.log(F.col("toxic") / (n * share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0))
    chosen = counts.where((F.col("toxic") > 0) & (F.col("toxic") >= MIN_SHARE * n)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2)
    buckets = sorted(r[0] for r in chosen.select("bucket").collect())
    if not buckets:
        scratch.drop(rows)
        return Model()
    held = map_batches(rows.select("text", "grade"), _vectors(buckets), "grade int, hits bigint, at array<bigint>, n array<bigint>").collect()
    if max(r[0] for r in held) <= 1:
        held = [(max(0, r[0]) * (1 + (r[1] >= GRADE_AT)), *r[1:]) for r in held]
    alike = Counter((max(0, grade), tuple(at), tuple(n)) for grade, _, at, n in held)
    weight = np.array([*alike.values()], np.float64)
    row = np.repeat(np.arange(len(alike)), [len(at) for _, at, _ in alike])
    column, n = (np.array([i for k in alike for i in k[part]], np.int64) for part in (1, 2))
    x = Sparse(row, column, np.log1p(n), (len(alike), len(buckets)))
    y = np.unique([k[0] for k in alike], return_inverse=True)[1]
    scratch.drop(rows)
    weights, thresholds = _regress(x, y, int(y.max()) + 1, weight)
    return Model(buckets, weights, thresholds)


def predict(docs: DataFrame, model: Model, text_col: str = "text", flag_at: float = FLAG_AT) -> DataFrame:
    """``docs`` with expected_severity (0 to the highest grade), severity_grade (the likeliest) and toxic_flag.

    The flag is an expected severity of at least ``flag_at``. Whole texts are read, a block at a time. Null and empty
    texts hold no feature and are judged like any text without one; repeated rows are judged alike, an empty table stays
    empty. Existing columns of the new names are replaced, all others go along whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value
        features = Features(model.buckets)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            found = [features(t.as_py()) for t in batch.column("text")]
            x = np.array([np.log1p(n) @ model.weights[at] if at else 0.0 for at, n, _ in found], np.float64)
            above = model.severity(x)
            chance = np.hstack((np.ones((len(x), 1)), above)) - np.hstack((above, np.zeros((len(x), 1))))
            expected = above.sum(axis=1)
            return [pa.array(expected), pa.array(chance.argmax(axis=1).astype(np.int32)), pa.array(expected >= flag_at)]

        return work

    new = {"expected_severity": "double", "severity_grade": "int", "toxic_flag": "boolean"}
    return with_made(docs, {"text": named(text_col).cast("string").cast("binary")}, make, new)
