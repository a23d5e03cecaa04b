"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits.

Search is a byte-position inverted index with count filtering. Two fingerprints that differ in at most 3 bits differ in
at most 3 of their 8 bytes, so they share at least MIN_SHARED = 5 positional bytes. A list per single byte would hold
1/256 of everything, so lists are kept per group of three byte positions: positions 0-3 and 4-7 give 2 x 4 groups of
three, and of any 5 shared positions at least 3 lie in one half, so every wanted pair meets in one of the 8 lists. Within
a list the shared positional bytes of each pair are tallied, pairs below MIN_SHARED are let go, and the rest verified by
their differing bits. A list longer than ``list_cap`` is split by two of the five positions it leaves open (at least two
of those are shared too); what is then still too long has only three open bytes, and is searched by flipping bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadscape.llm.arrow import free, gathered, map_batches, named
from loadscape.llm.components import connected_components
from loadscape.llm.scratch import Scratch
from loadscape.llm.text import word_chunks

SHINGLE_WORDS, SEED, BITS, MAX_DIFF, MIN_SHARED = 3, 42, 64, 3, 5
#: Byte positions that key the lists: the triples within either half.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
LIST_CAP = 8192
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned integer; null or no word: zero."""
    votes, total, words = np.zeros(BITS, np.int64), 0, []
    for words in word_chunks((text or b"").lower(), SHINGLE_WORDS - 1):
        if len(words) < SHINGLE_WORDS:
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -SHINGLE_WORDS]))
        hashed = [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE_WORDS - 1 :] - 1).tolist())]
        bits = np.unpackbits(np.array(hashed, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes, total = votes + bits.sum(axis=0, dtype=np.int64), total + len(hashed)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column("text").cast(pa.large_binary())], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints)], names=["id", "row_a", "row_b", "fingerprint"])


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell a row's id and text."""
    one, text = named(id_col), named(text_col).cast("string")
    return [F.xxhash64(one, text).alias("row_a"), F.xxhash64(text, F.lit("b"), one).alias("row_b")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_a, row_b, fingerprint as signed long) of every row; row_a and row_b tell its id and text."""
    rows = docs.select(named(id_col).alias("id"), *_row_keys(id_col, text_col), named(text_col).cast("string").alias("text"))
    return map_batches(rows, _fingerprint_batches, f"id {rows.schema['id'].dataType.simpleString()}, row_a bigint, row_b bigint, fingerprint bigint")


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _pack(slot: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(slot).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def _forest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``labels`` (each row's smallest known row) along the links a-b, in place."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (jump := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = jump


def _linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Count filter, then verification, of fingerprint pairs that met in a list."""
    parts = np.bitwise_xor(x, y).view(np.uint8).reshape(-1, 8)
    out = (parts == 0).sum(axis=1) >= MIN_SHARED
    out[out] = _POPCOUNT[parts[out]].sum(axis=1) <= MAX_DIFF
    return out


def _lists(keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """For rows sorted by key: the first row that each row is linked to, directly or through others of its list."""
    labels, n = np.arange(len(keys)), len(keys)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    held, rows, lag = 0, np.arange(n), 1
    while len(rows := rows[rows + lag < n]) and len(rows := rows[keys[rows] == keys[rows + lag]]):
        open_ = rows[labels[rows] != labels[rows + lag]]
        found = open_[_linked(prints[open_], prints[open_ + lag])]
        a, b, held, lag = [*a, found], [*b, found + lag], held + len(found), lag + 1
        if held > 4 * n:
            _forest(labels, np.concatenate(a), np.concatenate(b))
            a, b, held = [], [], 0
    if a:
        _forest(labels, np.concatenate(a), np.concatenate(b))
    return labels


def _flips(prints: np.ndarray) -> np.ndarray:
    """As _lists for one list of distinct fingerprints that agree in five bytes: every flip of up to 3 open bits."""
    differ = np.bitwise_or.reduce(prints ^ prints[0])
    open_bits = [1 << i for i in range(BITS) if int(differ) >> i & 1]
    order = np.argsort(prints)
    ranked, labels = prints[order], np.arange(len(prints))
    for r in range(1, MAX_DIFF + 1):
        for bits in combinations(open_bits, r):
            want = prints ^ np.uint64(sum(bits))
            at = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
            hit = np.flatnonzero(ranked[at] == want)
            _forest(labels, hit, order[at[hit]])
    return labels


def _search(list_cap: int, last: bool):
    """Links within each list, as a forest; a list over the cap is searched by flips if ``last``, else only named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x, y, key):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(key, pa.int64())], names=["u", "v", "long_list"])

        def links(keys, prints):
            labels = _flips(prints) if len(prints) > list_cap else _lists(keys, prints)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            return out(prints[at].view(np.int64), prints[labels[at]].view(np.int64), [None] * len(at))

        held: list[tuple[np.ndarray, np.ndarray]] = []
        skip = None

        def close():
            if held:
                yield from _whole(*map(np.concatenate, zip(*held)), list_cap, last, links, out)
            held.clear()

        for batch in gathered(batches, 10_000):
            keys, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if skip is not None:
                keep = keys != skip
                keys, prints = keys[keep], prints[keep]
            if not len(keys):
                continue
            cut = np.searchsorted(keys, keys[-1])
            if cut:
                held.append((keys[:cut], prints[:cut]))
                yield from close()
            elif held and held[-1][0][-1] != keys[0]:
                yield from close()
            held.append((keys[cut:], prints[cut:]))
            if not last and sum(len(k) for k, _ in held) > list_cap:
                skip = keys[-1]
                yield out([None], [None], [skip])
                held.clear()
        yield from close()

    return run


def _whole(keys, prints, list_cap, last, links, out) -> Iterator[pa.RecordBatch]:
    firsts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(firsts, len(keys)))
    long_ = np.repeat(sizes > list_cap, sizes)
    if long_.any():
        for f, s in zip(firsts[sizes > list_cap], sizes[sizes > list_cap]):
            yield links(keys[f : f + s], prints[f : f + s]) if last else out([None], [None], [int(keys[f])])
    more = np.repeat(sizes > 1, sizes) & ~long_
    if more.any():
        at, kept = np.flatnonzero(more), keys[more]
        labels = _lists(kept, prints[at])
        tied = np.flatnonzero(labels != np.arange(len(labels)))
        yield out(prints[at][tied].view(np.int64), prints[at][labels[tied]].view(np.int64), [None] * len(tied))


_FOUND = "u bigint, v bigint, long_list bigint"


def links(prints: DataFrame, scratch: Scratch, list_cap: int = LIST_CAP) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints of column ``fingerprint`` as all links within 3 bits do.

    Every pair within 3 bits is connected by what is returned, and nothing else is; within a list only a spanning
    forest is given, so a group of n near copies costs n - 1 rows.
    """
    fp = prints.select(F.col("fingerprint").alias("fp")).distinct()
    keys = F.explode(F.array(*[_pack(i, t) for i, t in enumerate(TRIPLES)]))
    found = scratch.table(map_batches(_sorted(fp.select(keys.alias("key"), "fp")), _search(list_cap, False), _FOUND))
    out = found.where("long_list is null").select("u", "v")
    long_ = found.where("long_list is not null").select(F.col("long_list").alias("key"))
    if not long_.isEmpty():
        for i, t in enumerate(TRIPLES):
            rest = [p for p in range(8) if p not in t]
            inner = F.explode(F.array(*[F.shiftleft(F.shiftleft("key", 4).bitwiseOR(F.lit(j).cast("long")), 16).bitwiseOR(F.shiftleft(_byte(a), 8)).bitwiseOR(_byte(b)) for j, (a, b) in enumerate(combinations(rest, 2))]))
            members = fp.select(_pack(i, t).alias("key"), "fp").join(long_, "key", "left_semi").select(inner.alias("key"), "fp")
            out = out.union(map_batches(_sorted(members), _search(list_cap, True), _FOUND).select("u", "v"))
    return out


def _sorted(postings: DataFrame) -> DataFrame:
    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.repartition(n, "key").sortWithinPartitions("key", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_cap: int = LIST_CAP) -> DataFrame:
    """One row per input row: (id_col, fingerprint as 16 hex digits, component_id, class_fp, row_a, row_b).

    component_id is the smallest id reachable over links of at most 3 differing bits; class_fp names the same group by
    its smallest fingerprint (signed). Texts are taken whole, A-Z lower-cased, in words of anything but ASCII white
    space. Null, empty and blank texts have fingerprint zero and are linked like any other; fewer than 3 words are
    hashed as one sequence. Equal texts share a fingerprint, so copies never meet pair by pair; repeated rows stay
    repeated. A null id is kept and is never a component_id unless its group has no other. Other columns are not read.
    An empty table gives an empty result. A fingerprint that a third of all rows share, such as that of empty texts, is
    one row of the classes; Spark's skew handling (spark.sql.adaptive.skewJoin, on by default) splits its rows where they
    meet.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, id_col, text_col))
    comp = connected_components(links(prints, scratch, list_cap), "u", "v", scratch)
    classes = prints.groupBy("fingerprint").agg(F.min("id").alias("least")).join(comp.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    classes = scratch.table(classes.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("class_fp")))
    first = classes.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    classes = classes.select("fingerprint", "class_fp").join(first, "class_fp")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "fingerprint").select(F.col("id").alias(id_col), hexed, "component_id", "class_fp", "row_a", "row_b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_cap: int = LIST_CAP) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates one row with the smallest id, all its columns.

    Of rows that share that id one stays, whatever their other columns; a null id stays where its group has no other.
    Only ids and fingerprints are shuffled to find the groups; the texts move once, to meet the decision.
    """
    a, b, nth = free(docs, "_row_a", "_row_b", "_nth")
    seen = near_duplicates(docs.select(named(id_col).alias("id"), named(text_col).alias("text")), "id", "text", list_cap)
    kept = seen.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("class_fp").agg(F.min(F.struct("row_a", "row_b")).alias("row"))
    kept = kept.select(F.col("row.row_a").alias(a), F.col("row.row_b").alias(b))
    joined = docs.withColumns(dict(zip((a, b), _row_keys(id_col, text_col)))).join(kept, [a, b], "left_semi")
    turn = F.row_number().over(Window.partitionBy(a, b).orderBy(a))
    return joined.withColumn(nth, turn).where(F.col(nth) == 1).select(*map(named, docs.columns))
