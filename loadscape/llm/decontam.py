"""Benchmark decontamination: a BM25 index of test items is queried by every passage of every document.

Passages are windows of words, two strides long and one stride apart, so every run of words up to a stride lies within
one; items are indexed by length class, each class with its own stride. Search is block-max WAND over a batch of passages
at a time: each item's common, low-impact terms are set aside as long as their sum cannot decide, the posting lists of
its other terms hold the rest, summed first over blocks of items by the blocks' largest impacts. Only passages that reach
the bound in a block are scored by its items, and only those above an item's threshold are retrieved and verified by
their overlap with the whole item, its question and its answer. An item's threshold is the least score that a passage
with the wanted overlap can have, so retrieval loses none of them. The index is flat arrays of numbers: words and shingles are
told by 64-bit hashes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import kept_where, map_batches, named
from loadscape.llm.text import Known, plain, word_chunks

K1, B = 1.2, 0.75
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
#: Items in a block of the index; least stride; words of items that are indexed, and sent to all tasks, at once: an index
#: takes 60 bytes a word at most, so 60 MB. A benchmark of more words is searched in several passes.
BLOCK, STRIDE, INDEX_WORDS = 8, 32, 1_000_000
#: Texts searched at once.
ROWS = 256
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): cut at the last line break, else after the last sentence end that has words behind it."""
    text = text.strip()
    head, _, tail = text.rpartition("\n")
    if not head.strip():
        ends = [m.end() for m in re.finditer(r"[.?!]\s+(?=\S)", text)]
        head, tail = (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")
    return head, tail


def tokens(text: str) -> list[str]:
    return [w for w in map(plain, text.encode().split()) if w]


def shingles(terms: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` terms."""
    t = terms.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = sum((t[k : max(0, len(t) - n + 1) + k] + np.uint64(1)) * _ODD[k] for k in range(n))
    return h ^ (h >> np.uint64(31))


def share(part: np.ndarray, of: np.ndarray) -> float:
    return float(np.isin(part, of).mean()) if len(part) else 1.0


class Ragged:
    """Arrays of one type behind each other, told apart by their ends."""

    def __init__(self, rows: list[np.ndarray], kind: type):
        self.ends = np.cumsum([0, *map(len, rows)])
        self.flat = np.concatenate([np.empty(0, kind), *rows]).astype(kind)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[self.ends[k] : self.ends[k + 1]]

    @property
    def nbytes(self) -> int:
        return self.flat.nbytes + self.ends.nbytes


class LengthClass:
    """The index of the items of one length class. Impacts are relative to an item's score with itself."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], n_terms: int):
        words = [np.concatenate((q, a)) for _, q, a in items]
        lengths, n_items = np.array([*map(len, words)]), len(items)
        self.ids, self.stride = np.array([i for i, _, _ in items], np.int64), max(STRIDE, -(-int(lengths.max()) * 5 // 4))
        self.run = np.minimum(lengths, SHINGLE)
        self.whole = Ragged([np.unique(shingles(w, n)) for w, n in zip(words, self.run.tolist())], np.uint64)
        self.question, self.answer = (Ragged([np.unique(x[part]) for x in items], np.int32) for part in (1, 2))
        key, n = np.unique(np.repeat(np.arange(n_items), lengths) * n_terms + np.concatenate(words), return_counts=True)
        item, term = key // n_terms, key % n_terms
        df = np.bincount(term, minlength=n_terms)[term]
        weight = np.log(1 + (n_items - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * lengths[item] / lengths.mean()))
        impact = weight / np.bincount(item, weight)[item]
        self.item_begin, self.item_term, self.impact = np.searchsorted(item, np.arange(n_items + 1)), term.astype(np.int32), impact
        by = np.lexsort((term, impact, item))
        rising, size = impact[by], np.diff(self.item_begin)
        lost = ((1 - OVERLAP) * np.diff(self.whole.ends) + 1e-9).astype(np.int64)
        top = self.item_begin[1:][item] - np.arange(len(item)) <= lost[item]
        self.threshold = np.maximum(1e-9, 1 - np.bincount(item, rising * top) - 1e-6)
        total = np.cumsum(rising)
        total -= np.repeat(total[self.item_begin[:-1]] - rising[self.item_begin[:-1]], size)
        rest = total > self.threshold[item] / 2
        aside = np.bincount(item, rising * ~rest)
        term, item, need = term[by][rest], item[rest], (rising / (self.threshold - aside)[item])[rest]
        by = np.lexsort((item, term))
        term, self.item, self.need = term[by], item[by].astype(np.int32), need[by]
        self.begin = np.searchsorted(term, np.arange(n_terms + 1))
        block = self.item // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (np.diff(term) != 0) | (np.diff(block) != 0))))
        self.block, self.most = block[first], np.maximum.reduceat(self.need, first)
        self.block_begin = np.searchsorted(term[first], np.arange(n_terms + 1))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if hasattr(x, "nbytes"))

    @staticmethod
    def _expand(begin: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, posting) for every posting of every row's term."""
        n = begin[terms + 1] - begin[terms]
        row = np.repeat(np.arange(len(terms)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + begin[terms][row]

    def score(self, k: int, terms: np.ndarray) -> float:
        """Of item k, for a passage's distinct terms."""
        own = slice(self.item_begin[k], self.item_begin[k + 1])
        return float(self.impact[own][np.isin(self.item_term[own], terms)].sum())

    def retrieve(self, window: np.ndarray, terms: np.ndarray) -> list[tuple[int, int, float]]:
        """(window, item, score) at or above the item's threshold; the input has distinct (window, term), sorted."""
        row, at = self._expand(self.block_begin, terms)
        n_items, n_blocks = len(self.ids), len(self.ids) // BLOCK + 1
        key, inverse = np.unique(window[row] * n_blocks + self.block[at], return_inverse=True)
        open_ = key[np.bincount(inverse, self.most[at], len(key)) >= 1 - 1e-9]
        if not len(open_):
            return []
        near = np.isin(window, open_ // n_blocks)
        row, at = self._expand(self.begin, terms[near])
        own, item = window[near][row], self.item[at].astype(np.int64)
        place = np.minimum(np.searchsorted(open_, own * n_blocks + item // BLOCK), len(open_) - 1)
        inside = open_[place] == own * n_blocks + item // BLOCK
        key, inverse = np.unique(own[inside] * n_items + item[inside], return_inverse=True)
        reached = key[np.bincount(inverse, self.need[at][inside], len(key)) >= 1 - 1e-9]
        out = []
        for w, k in zip((reached // n_items).tolist(), (reached % n_items).tolist()):
            a, b = np.searchsorted(window, (w, w + 1))
            score = self.score(k, terms[a:b])
            if score >= self.threshold[k]:
                out.append((w, k, score))
        return out


class Index:
    """All items, in classes whose lengths differ by a factor of two at most. words: hashes, sorted; their place is the term."""

    def __init__(self, items: list[tuple[int, str]]):
        parts = {i: [np.array([xxhash.xxh64_intdigest(w) for w in tokens(x)], np.uint64) for x in split_item(text)] for i, text in sorted(items)}
        self.words = np.unique(np.concatenate([np.empty(0, np.uint64), *(x for p in parts.values() for x in p)]))
        by_length: dict[int, list] = {}
        for i, p in parts.items():
            if n := sum(map(len, p)):
                by_length.setdefault(n.bit_length(), []).append((i, *(np.searchsorted(self.words, x) for x in p)))
        self.classes = [LengthClass(x, len(self.words)) for _, x in sorted(by_length.items())]

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + sum(c.nbytes for c in self.classes)


class Search:
    def __init__(self, index: Index):
        self.index, self.known, self.words = index, Known(self._term), memoryview(index.words)
        self.keep = 2 * max((c.stride for c in index.classes), default=0)

    def _term(self, word: bytes) -> int:
        """The term of a word; -1 for a word of no item, -2 for what is no word."""
        if not (p := plain(word)):
            return -2
        h = xxhash.xxh64_intdigest(p)
        at = bisect_left(self.words, h)
        return at if at < len(self.words) and self.words[at] == h else -1

    def __call__(self, texts: list[bytes | None]) -> list[dict[int, tuple[float, float, float, float]]]:
        """For each text the verified items: score, overlap, question and answer overlap of the best passage."""
        out: list[dict] = [{} for _ in texts]
        held, rows = [], []
        for i, text in enumerate(texts):
            for words in word_chunks(text or b"", self.keep):
                found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
                held.append(found[found != -2])
                rows.append(i)
        for c in self.index.classes if held else ():
            self._search(c, held, rows, out)
        return out

    def _search(self, c: LengthClass, held: list[np.ndarray], rows: list[int], out: list[dict]) -> None:
        sizes = np.array([len(x) for x in held])
        windows = np.maximum(1, -(-sizes // c.stride))
        base = np.cumsum(windows) - windows
        terms = np.concatenate(held)
        place = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = place // c.stride + np.repeat(base, sizes)
        seen = terms >= 0
        back = seen & (place >= c.stride)
        n = len(self.index.words)
        key = np.sort(np.concatenate((window[seen] * n + terms[seen], (window[back] - 1) * n + terms[back])))
        key = key[np.diff(key, prepend=-1) != 0]
        for w, k, score in c.retrieve(key // n, key % n):
            part = int(np.searchsorted(base, w, "right")) - 1
            start = (w - int(base[part])) * c.stride
            passage = held[part][start : start + 2 * c.stride]
            found = score, share(c.whole[k], shingles(passage, int(c.run[k]))), share(c.question[k], passage), share(c.answer[k], passage)
            if found[1] >= OVERLAP and min(found[2:]) >= PART_OVERLAP:
                at, item_id = out[rows[part]], int(c.ids[k])
                at[item_id] = max(at.get(item_id, found), found, key=lambda x: (x[1], x[0]))


def _indexes(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """Indexes of bounded size, one at a time; a benchmark over INDEX_WORDS is cut into several by a hash of the item."""
    items = benchmark.select(named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    n = 1 + (items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0) // INDEX_WORDS
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i)
        yield Index([tuple(r) for r in part.collect()])


def _found(held):
    """The verified items of each text of a batch."""
    search = Search(held.value)

    def work(texts: pa.Array) -> list[dict]:
        return [r for at in range(0, len(texts), ROWS) for r in search([t.as_py() for t in texts.slice(at, ROWS)])]

    return work


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id_col, item_col, score, overlap, question_overlap, answer_overlap): documents that hold a benchmark item.

    A document holds an item if a passage of it has at least OVERLAP of the item's runs of 5 words (of an item of fewer
    words, the whole item) and PART_OVERLAP of the words of its question and of its answer; words are lower-cased, without
    punctuation around them. score is the passage's BM25 score relative to the item's own. Null or empty texts hold
    nothing; a null id is kept; repeated rows are each reported. Item ids are integers, null items are left out, and an
    item given twice counts once. Documents are not shuffled; an empty table of documents or items gives no rows. A
    benchmark of over INDEX_WORDS words takes one pass over the documents for each so many words.
    """
    names, numbers = ("score", "overlap", "question_overlap", "answer_overlap"), None
    rows = docs.select(named(id_col).alias("id"), named(text_col).cast("string").cast("binary").alias("text"))
    for index in _indexes(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            work = _found(held)
            for batch in batches:
                found = [(i, item, *x) for i, r in enumerate(work(batch.column(1))) for item, x in sorted(r.items())]
                columns = [*zip(*found)] or [[]] * 6
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[2:]]], names=["id", "item", *names])

        one = map_batches(rows, run, f"id {rows.schema[0].dataType.simpleString()}, item bigint, " + ", ".join(f"{n} double" for n in names))
        numbers = one if numbers is None else numbers.union(one)
    return numbers.toDF(id_col, item_col, *names)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (see ``leaks``), with all their columns, whatever their names.

    It is decided where the rows lie; rows with null or empty texts, and all rows where there is no item, stay.
    """
    for index in _indexes(benchmark, item_col, item_text_col):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def make(held=held):
            work = _found(held)
            return lambda batch: [not r for r in work(batch.column("text"))]

        docs = kept_where(docs, {"text": named(text_col).cast("string").cast("binary")}, make)
    return docs
