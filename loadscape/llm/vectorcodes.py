"""Compressing vectors to codes: each quarter of a vector becomes the place of its nearest codebook entry.

Components are integers and every distance that decides is exact. Most entries are ruled out by a float32 matrix product:
for each score there is an interval that holds the exact one whatever the order of the additions, and only entries whose
interval reaches the best interval are measured again in int64, ties going to the lower index. Codebooks are of fixed
size, so they are sent to all tasks; sums of a round are gathered within each task and come back as sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import free, map_batches, named, with_made
from loadscape.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose scores are held at once, and pairs of row and entry that are measured exactly at once.
ROWS, PAIRS = 4096, 1 << 18
#: Rounding of one float32 operation.
UNIT = 2.0**-24
MOST = (1 << 63) - 1


def limit(width: int) -> int:
    """Integers of vectors of this width lie within plus and minus this, so that a squared distance fits in 63 bits."""
    return min((1 << 31) - 1, math.isqrt(MOST // (4 * max(1, width))))


def _integers(batch: pa.RecordBatch) -> list[pa.Array]:
    vectors = batch.column("vector")
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    begin = vectors.offsets.to_numpy()
    size, out = np.diff(begin), np.full(len(vectors), None, object)
    valid = ~vectors.is_null().to_numpy(zero_copy_only=False) & (size > 0)
    for width in np.unique(size[valid]).tolist():
        most = limit(width)
        own = np.flatnonzero(valid & (size == width))
        for at in np.array_split(own, -(-len(own) * width // (1 << 20))):
            x = values[begin[at][:, None] + np.arange(width)]
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                rows = np.clip(np.floor(x[fine] * SCALE), -most, most).astype("<i4")
            for i, row in zip(at[fine].tolist(), rows):
                out[i] = row.tobytes()
    return [pa.array(out.tolist(), pa.binary())]


def integers(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with floor(1024 * x) of each component x, as little-endian int32, in place of the vector.

    Null and empty vectors and those with a null or non-finite component are left out. Integers beyond ``limit`` (for 64
    components about 190 million, of components of about 185,000) count as the limit, so distances stay exact.
    """
    made = with_made(vectors, {"vector": named(vector_col).cast("array<double>")}, lambda: _integers, {vector_col: "binary"})
    return made.where(named(vector_col).isNotNull())


@dataclass
class Codebooks:
    """entries: (entries, width) integers; every part has its columns, ``bounds`` tells where they begin and end."""

    entries: np.ndarray

    @property
    def bounds(self) -> list[tuple[int, int]]:
        ends = [self.entries.shape[1] * p // PARTS for p in range(PARTS + 1)]
        return [*zip(ends[:-1], ends[1:])]

    @property
    def sha256(self) -> str:
        numbers = np.concatenate([self.entries[:, a:b].ravel() for a, b in self.bounds])
        return hashlib.sha256(",".join(map(str, numbers.tolist())).encode()).hexdigest()


class Nearest:
    """The nearest entry of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        k = entries.shape[1] + 8
        self.gamma = k * UNIT / (1 - k * UNIT) if k * UNIT < 0.5 else np.inf
        squares = (self.entries.astype(np.float64) ** 2).sum(axis=1)
        self.longest = math.sqrt(float(squares.max(initial=0.0)))
        self.squares, self.columns = squares.astype(np.float32), np.ascontiguousarray(entries.T, np.float32)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for int64 rows."""
        index, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for at in range(0, len(x), ROWS):
            part = slice(at, at + ROWS)
            index[part], error[part] = self._block(x[part])
        return index, error

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A score is |c|^2 - 2 x.c. With |x.c| <= |x||c|, each computed one is off by at most ``off``: every product and
        sum, and each number's own rounding to float32, adds a unit relative to |c|^2 + 2 |x||c|."""
        scores = self.squares - 2 * (x.astype(np.float32) @ self.columns)
        length = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        off = self.gamma * 1.001 * (self.longest**2 + 2 * length * self.longest)
        reach = np.nextafter((scores.min(axis=1).astype(np.float64) + 2 * off).astype(np.float32), np.float32(np.inf))
        row, entry = np.nonzero(scores <= reach[:, None])
        error = np.concatenate([self._exact(x, row[k : k + PAIRS], entry[k : k + PAIRS]) for k in range(0, len(row), PAIRS)])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(error, first)
        hit = np.flatnonzero(error == best[row])
        hit = hit[np.diff(row[hit], prepend=-1) != 0]
        return entry[hit], best

    def _exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        off = x[row] - self.entries[entry]
        return np.einsum("ij,ij->i", off, off)


class Coder:
    def __init__(self, books: Codebooks):
        self.books, self.nearest = books, [Nearest(books.entries[:, a:b]) for a, b in books.bounds]

    def rows(self, column: pa.Array) -> np.ndarray:
        width = self.books.entries.shape[1]
        return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of indexes, and each row's error."""
        found = [n(x[:, a:b]) for n, (a, b) in zip(self.nearest, self.books.bounds)]
        return np.column_stack([f[0] for f in found]), np.sum([f[1] for f in found], axis=0)


def _sums(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)
        entries = coder.books.entries
        count, total = np.zeros((PARTS, len(entries)), np.int64), np.zeros(entries.shape, np.int64)
        for batch in batches:
            x = coder.rows(batch.column(0))
            index, _ = coder(x)
            for p, (a, b) in enumerate(coder.books.bounds):
                own = np.bincount(index[:, p], minlength=len(entries))
                count[p] += own
                order = np.argsort(index[:, p], kind="stable")
                used = np.flatnonzero(own)
                if len(used):
                    total[used, a:b] += np.add.reduceat(x[order, a:b], (np.cumsum(own) - own)[used], axis=0)
        for p, (a, b) in enumerate(coder.books.bounds):
            used = np.flatnonzero(count[p])
            for place, values in [(-1 - p, count[p][used]), *((k, total[used, k]) for k in range(a, b))]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), place)), pa.array(used), pa.array(values)], names=["place", "entry", "n"])

    return run


def fit(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks over all rows that ``integers`` made: the first from the smallest ids, then ``rounds`` rounds.

    The first row's width holds for all. Fewer rows than entries give fewer entries, no rows none. Ids may be null (last)
    and repeat; equal ids are ordered by vector. An entry that nothing is nearest to stays as it is. Of each round one sum
    for each entry and component comes to the driver.
    """
    order = [named(id_col).asc_nulls_last(), named(vector_col)]
    first = [np.frombuffer(r[0], "<i4").astype(np.int64) for r in rows.orderBy(*order).select(named(vector_col)).limit(entries).collect()]
    if not first:
        return Codebooks(np.zeros((0, 0), np.int64))
    books = Codebooks(np.array([x for x in first if len(x) == len(first[0])]))
    own = rows.select(named(vector_col).alias("v"))
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(books)
        sums = map_batches(own, _sums(held), "place bigint, entry bigint, n bigint").groupBy("place", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("string").alias("n")).toArrow()
        count, total = {}, {}
        for place, entry, n in zip(*(sums.column(c).to_pylist() for c in ("place", "entry", "n"))):
            (count if place < 0 else total)[place, entry] = int(n)
        after = books.entries.copy()
        for p, (a, b) in enumerate(books.bounds):
            for (place, entry), n in count.items():
                if place == -1 - p:
                    after[entry, a:b] = [total[k, entry] // n for k in range(a, b)]
        books = Codebooks(after)
    return books


def encode(rows: DataFrame, books: Codebooks, vector_col: str = "embedding", code_col: str = "code", error_col: str = "error") -> DataFrame:
    """``rows`` with the code (two hex digits a part) and the squared distance of every vector, in place of the vector.

    Equal vectors get equal codes; other columns go along, those of the new names are replaced.
    """
    held = rows.sparkSession.sparkContext.broadcast(books)

    def make():
        coder = Coder(held.value)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            index, error = coder(coder.rows(batch.column("v")))
            return [pa.array([bytes(r).hex() for r in index.astype(np.uint8)], pa.string()), pa.array(error)]

        return work

    gone = [c for c in rows.columns if c.lower() != vector_col.lower()]
    (v,) = free(rows, "_vector")
    moved = rows.select(*[named(c) for c in gone], named(vector_col).alias(v))
    return with_made(moved, {"v": named(v)}, make, {code_col: "string", error_col: "bigint"}).drop(v)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The kept rows of ``vectors`` with code, error, label_error and codebooks_sha256, in place of the vector.

    Vectors are dropped that ``integers`` leaves out, or whose width is not that of the smallest id (a width that is no
    multiple of 4 gives parts that differ by one). label_error adds the errors of equal labels, nulls together (above 63
    bits: the largest long). An empty table stays empty; repeated rows are coded alike; other columns go along, those of
    the new names are replaced. The integers are written once and read in every round, and the codes once, to be added up
    by label; sums of few labels are small, and Spark sends them to the rows instead of shuffling these.
    """
    scratch = Scratch(vectors.sparkSession, "codes")
    new = ["code", "error", "label_error", "codebooks_sha256"]
    plain = vectors.select(*[named(c) for c in vectors.columns if c.lower() not in new])
    kept = scratch.table(integers(plain, vector_col))
    first = kept.orderBy(named(id_col).asc_nulls_last(), named(vector_col)).select(F.octet_length(named(vector_col))).first()
    rows = kept.where(F.octet_length(named(vector_col)) == F.lit(first[0] if first else 0))
    books = fit(rows, id_col, vector_col)
    coded = scratch.table(encode(rows, books, vector_col))
    scratch.drop(kept)
    label, total = free(coded, "_label", "_total")
    sums = coded.groupBy(named(label_col).alias(label)).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias(total))
    sums = scratch.table(sums.select(label, F.least(F.col(total), F.lit(MOST).cast("decimal(38,0)")).cast("bigint").alias(total)))
    out = coded.join(sums, named(label_col).eqNullSafe(F.col(label)), "left")
    return out.select(*[named(c) for c in coded.columns], F.col(total).alias("label_error"), F.lit(books.sha256).alias("codebooks_sha256"))
