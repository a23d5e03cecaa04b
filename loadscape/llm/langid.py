"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

A text is its maximal runs of letters, lower-cased; each run, marked at its start, is written as pieces of the public
vocabulary in every possible way. A language gives each piece a probability, and a run's probability is the sum over all
its segmentations of the product of their pieces, computed forward one letter at a time. Piece probabilities are learned
by expectation-maximisation (forward-backward expected counts) from labelled texts. Beside the languages stands one model
of unknown text: single letters as all languages use them, and any piece a little likelier than in a language that never
uses it. What it explains better than every language is in none of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadscape.llm.arrow import gathered, map_batches, named, with_made
from loadscape.llm.scratch import Scratch

START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Runs of more letters are summed in logarithms, one at a time (40 letters of the least probability still fit a double).
LONG = 40
#: Labelled rows that are learned from, about so many of each language.
ROWS_PER_LANG, ROUNDS, SMOOTH = 1000, 2, 0.1
#: Probability of a letter that is no piece, in a language and in unknown text, and the share of unknown text's letters
#: that are any letter of the vocabulary alike. In unknown text a piece is at least so many times as likely as in a
#: language that never uses it.
LONE, UNKNOWN_LONE, ANY_LETTER, UNSEEN = 1e-7, 1e-4, 0.1, 10
#: Numbers (runs times languages) and letters of runs that a task remembers; numbers that it computes at once; letters of
#: a text that are read at once, and of a run over LONG letters that are looked up at once.
CACHED, CACHED_LETTERS, AT_ONCE, BLOCK, LOOKED_UP = 1_000_000, 4_000_000, 1 << 17, 1 << 20, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str) -> Iterator[list[str]]:
    """The lower-cased letter runs of a text, a block at a time, so that long texts stay small."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and text[end].isalpha():
            end += 1
        yield LETTERS.findall(text[at:end].lower())
        at = end


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters, with or without the start mark, of a sentencepiece file."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p for i in range(sp.get_piece_size()) if LETTERS.fullmatch((p := sp.id_to_piece(i).lower()).replace(START, "", 1))}
    return sorted(pieces | {START})


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


class Lattice:
    """Looks up every substring of many runs at once: substrings are told by a rolling hash of their code points."""

    def __init__(self, pieces: list[str]):
        hashes, lengths = np.zeros(len(pieces), np.uint64), np.fromiter(map(len, pieces), np.int64, len(pieces))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for codes in _codes("".join([pieces[i] for i in at.tolist()])).reshape(-1, n).T:
                hashes[at] = self._step(hashes[at], codes)
        self.order = np.argsort(hashes)
        self.hashes, self.n, self.longest = hashes[self.order], len(pieces), int(lengths.max())
        bits = 18
        self.shift = np.uint64(64 - bits)
        self.slot = np.searchsorted(self.hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift)
        self.most = int(np.bincount((self.hashes >> self.shift).astype(np.int64)).max())

    @staticmethod
    def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h ^ codes) * _MIX
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or n."""
        at = self.slot[(h >> self.shift).astype(np.int64)]
        out = np.full(len(h), self.n, np.int32)
        for _ in range(self.most):
            here = np.minimum(at, self.n - 1)
            hit = self.hashes[here] == h
            out[hit] = self.order[here[hit]]
            at = at + 1
        return out

    def edges(self, codes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For runs of one length (a row of code points each): the pieces from i to j, for all i < j."""
        out, n = {}, codes.shape[1]
        for i in range(n):
            h = np.zeros(len(codes), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = self._step(h, codes[:, j - 1])
                out[i, j] = self.find(h)
        return out

    def ending(self, codes: np.ndarray, begin: int = 0) -> np.ndarray:
        """For one run: row j holds the pieces of 1, 2, ... letters that end with letter ``begin + j``."""
        n = len(codes)
        out, h = np.full((n, self.longest), self.n, np.int32), np.zeros(n, np.uint64)
        for k in range(min(n, self.longest)):
            h = self._step(h[: n - k], codes[k:])
            out[k:, k] = self.find(h)
        return out[begin:]

    def blocks(self, run: str, backward: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(first letter, ``ending`` of the letters from there) of a marked run, so many letters at a time."""
        starts = range(0, len(run), LOOKED_UP)
        for at in reversed(starts) if backward else starts:
            begin = max(0, at - self.longest + 1)
            yield at, self.ending(_codes(run[begin : at + LOOKED_UP]), at - begin)


def _by_length(runs: list[str], rows: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray | str]]:
    """(places, code points) of the runs of each length, marked at the start, so many at a time; a long one alone, as text."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    for i in np.flatnonzero(lengths > LONG):
        yield np.array([i]), START + runs[i]
    for n in np.unique(lengths[lengths <= LONG]):
        for at in np.array_split(found := np.flatnonzero(lengths == n), -(-len(found) // rows)):
            yield at, _codes("".join([START + runs[i] for i in at.tolist()])).reshape(len(at), -1)


def _forward(lattice: Lattice, edges: dict, n: int, size: int, probs: np.ndarray, lone: np.ndarray) -> np.ndarray:
    """Probability of each run by each column of ``probs``, whose last row is for what is no piece."""
    alpha = [np.ones((size, probs.shape[1]))]
    for j in range(1, n + 1):
        total = np.zeros((size, probs.shape[1]))
        for i in range(max(0, j - lattice.longest), j):
            piece = edges[i, j]
            if i == j - 1:
                total += alpha[i] * np.where((piece == lattice.n)[:, None], lone, probs[piece])
            else:
                hit = np.flatnonzero(piece < lattice.n)
                total[hit] += alpha[i][hit] * probs[piece[hit]]
        alpha.append(total)
    return alpha[n]


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    return top + np.log(np.exp(x - top).sum(axis=0))


def _log_forward(lattice: Lattice, run: str, logs: np.ndarray, lone: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """As _forward, for one marked run of any length, in logarithms. Only the sums up to the last letters are held, the
    latest first; ``keep``, if given, takes the sum up to every letter by the only column."""
    last = np.zeros((1, logs.shape[1]))
    for at, ending in lattice.blocks(run):
        for j, pieces in enumerate(ending, at + 1):
            step = logs[pieces[: len(last)]]
            if pieces[0] == lattice.n:
                step[0] = lone
            now = _log_sum(last + step)
            last = np.concatenate((now[None], last[: lattice.longest - 1]))
            if keep is not None:
                keep[j] = now[0]
    return last[0]


def _log_expected(lattice: Lattice, run: str, logs: np.ndarray, lone: float) -> np.ndarray:
    """Expected uses of each piece in one marked run of any length by one language (forward, then backward sums)."""
    n, uses = len(run), np.zeros(lattice.n + 1)
    alpha = np.zeros(n + 1)
    whole = _log_forward(lattice, run, logs[:, None], np.array([lone]), alpha)[0]
    beta = np.full(n + 1, -np.inf)
    beta[n] = 0.0
    for at, ending in lattice.blocks(run, backward=True):
        steps = logs[ending]
        steps[ending[:, 0] == lattice.n, 0] = lone
        for j in range(at + len(ending), at, -1):
            k = min(lattice.longest, j)
            before = beta[j - k : j]
            np.logaddexp(before, (beta[j] + steps[j - at - 1, :k])[::-1], out=before)
        for k in range(ending.shape[1]):
            row = np.flatnonzero(ending[:, k] < lattice.n)
            end = at + row + 1
            piece = ending[row, k]
            uses += np.bincount(piece, np.exp(alpha[end - k - 1] + logs[piece] + beta[end] - whole), lattice.n + 1)
    return uses


@dataclass
class Model:
    """langs: values that can be predicted. probs: pieces x langs. unknown: of the pieces, in unknown text.

    lone, unknown_lone: probability of a letter that is no piece. The model takes 8 bytes for each piece and language.
    """

    pieces: list[str]
    langs: list[str]
    probs: np.ndarray
    unknown: np.ndarray | None = None
    lone: float = LONE
    unknown_lone: float = UNKNOWN_LONE

    def columns(self) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities with a last row for what is no piece, lone) by language and, if learned, unknown text."""
        probs, lone = self.probs, [self.lone] * len(self.langs)
        if self.unknown is not None:
            probs, lone = np.column_stack((probs, self.unknown)), [*lone, self.unknown_lone]
        return np.vstack((probs, np.zeros((1, probs.shape[1])))).astype(np.float64), np.array(lone)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(model.pieces)
        self.table, self.lone = model.columns()
        with np.errstate(divide="ignore"):
            self.log_table, self.log_lone = np.log(self.table), np.log(self.lone)
        self.width = max(1, self.table.shape[1])
        self.most = max(1000, CACHED // self.width)
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.letters = 0
        self.logs = np.empty((0, self.table.shape[1]), np.float32)

    def log_probabilities(self, runs: list[str]) -> np.ndarray:
        """Of each run by each language (and unknown text), summed over all segmentations."""
        out = np.empty((len(runs), self.table.shape[1]), np.float32)
        for at, codes in _by_length(runs, max(64, AT_ONCE // self.width // 4)):
            if isinstance(codes, str):
                out[at] = _log_forward(self.lattice, codes, self.log_table, self.log_lone)
            else:
                out[at] = np.log(np.maximum(_forward(self.lattice, self.lattice.edges(codes), codes.shape[1], len(at), self.table, self.lone), 1e-320))
        return out

    def judged(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """(language, score, evidence) of each text; null or without a letter: und, 0 and 0.

        Evidence is the log-probability of the whole text by its language less that by unknown text.
        """
        total, count = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts), np.int64)
        new: list[str] = []
        waiting: list[tuple[int, np.ndarray]] = []

        def settle() -> None:
            if new:
                self.logs = np.vstack((self.logs, self.log_probabilities(new)))
                new.clear()
            for i, at in waiting:
                place, n = np.unique(at, return_counts=True)
                total[i] += n @ self.logs[place].astype(np.float64)
                count[i] += len(at)
            waiting.clear()
            if len(self.seen) > self.most or self.letters > CACHED_LETTERS:
                self.clear()

        for i, text in enumerate(texts):
            for runs in letter_runs(text or ""):
                for k in range(0, len(runs), self.most):
                    part, seen = runs[k : k + self.most], self.seen
                    at = list(map(seen.get, part))
                    if None in at:
                        for r in part:
                            if r not in seen:
                                seen[r] = len(seen)
                                self.letters += len(r)
                                new.append(r)
                        at = list(map(seen.get, part))
                    waiting.append((i, np.array(at, np.int64)))
                    if len(new) > self.most or self.letters > CACHED_LETTERS:
                        settle()
        settle()
        langs, scores, evidence = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        k = len(self.model.langs)
        for i in np.flatnonzero(count).tolist() if k else ():
            mean = total[i, :k] / count[i]
            best = int(mean.argmax())
            langs[i], scores[i] = self.model.langs[best], float(1 / np.exp(mean - mean[best]).sum())
            evidence[i] = float(total[i, best] - total[i, -1]) if self.model.unknown is not None else 0.0
        return langs, scores, evidence

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        return self.judged(texts)[:2]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, run) in each batch."""
    for batch in batches:
        counts: dict[tuple[str, str], int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for run in (r for runs in letter_runs(text) for r in runs):
                counts[lang, run] = counts.get((lang, run), 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in counts], pa.string()), "run": pa.array([k[1] for k in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})


def expected_uses(model: Model, lattice: Lattice, runs: list[str], langs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(languages, pieces + 1): expected uses of each piece over runs of given languages and weights (forward-backward)."""
    probs, _ = Model(model.pieces, model.langs, model.probs, None, model.lone).columns()
    with np.errstate(divide="ignore"):
        logs, lone = np.log(probs), np.log(model.lone)
    uses = np.zeros((len(model.langs), lattice.n + 1))
    for at, codes in _by_length(runs):
        if isinstance(codes, str):
            uses[langs[at[0]]] += _log_expected(lattice, codes, logs[:, langs[at[0]]], lone) * weight[at[0]]
            continue
        n, lang = codes.shape[1], langs[at]
        edges = lattice.edges(codes)
        chance = {k: np.where(p == lattice.n, model.lone if k[1] - k[0] == 1 else 0.0, probs[p, lang]) for k, p in edges.items()}
        alpha = [np.ones(len(at))]
        for j in range(1, n + 1):
            alpha.append(sum(alpha[i] * chance[i, j] for i in range(max(0, j - lattice.longest), j)))
        beta = [np.ones(len(at))]
        for i in range(n - 1, -1, -1):
            beta.insert(0, sum(chance[i, j] * beta[j - i - 1] for j in range(i + 1, min(n, i + lattice.longest) + 1)))
        for (i, j), piece in edges.items():
            hit = np.flatnonzero(piece < lattice.n)
            gamma = alpha[i][hit] * chance[i, j][hit] * beta[j][hit] / np.maximum(alpha[n][hit], 1e-320) * weight[at][hit]
            np.add.at(uses, (lang[hit], piece[hit]), gamma)
    return uses


def letter_counts(lattice: Lattice, runs: list[str], weight: np.ndarray) -> np.ndarray:
    """Uses of each piece of one letter, and of the start mark, when every run is written in single letters."""
    out = np.zeros(lattice.n + 1)
    for at, codes in _by_length(runs):
        for part in (_codes(codes[k : k + BLOCK])[None] for k in range(0, len(codes), BLOCK)) if isinstance(codes, str) else (codes,):
            piece = lattice.find(lattice._step(np.zeros(part.size, np.uint64), part.ravel()))
            out += np.bincount(piece, np.repeat(weight[at], part.shape[1]), lattice.n + 1)
    return out


def _expected(held, letters: bool):
    """Expected uses of each piece by each language over counted runs, summed within a task; a null language: letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        lattice, place = Lattice(model.pieces), {x: i for i, x in enumerate(model.langs)}
        uses, single = np.zeros((len(model.langs), lattice.n + 1)), np.zeros(lattice.n + 1)
        for batch in gathered(batches, 10_000):
            runs, weight = batch.column("run").to_pylist(), batch.column("n").to_numpy().astype(np.float64)
            uses += expected_uses(model, lattice, runs, np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64), weight)
            if letters:
                single += letter_counts(lattice, runs, weight)
        for lang, n in [*zip(model.langs, uses), (None, single)]:
            used = np.flatnonzero(n[:-1] > 1e-6)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(n[used])], names=["lang", "piece", "uses"])

    return run


def fit(docs: DataFrame, vocabulary_path: str, learn: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG, rounds: int = ROUNDS) -> Model:
    """Learn from rows where ``learn`` holds and text and language are not null.

    About ``rows_per_lang`` rows of each language are taken, those with the smallest hash of their id; a language with
    fewer gives all it has, and every labelled language is learned. What reaches the driver is one number per piece and
    language. No labelled row, as in an empty table: a model without languages, which predicts und only.
    """
    spark, scratch, pieces = docs.sparkSession, Scratch(docs.sparkSession, "langid"), vocabulary(vocabulary_path)
    rows = docs.where(learn).select(named(lang_col).cast("string").alias("lang"), named(text_col).cast("string").alias("text"), named(id_col).alias("id"))
    rows = rows.where("text is not null and lang is not null")
    size = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(size)
    if not langs:
        return Model(pieces, [], np.zeros((len(pieces), 0)))
    share = spark.createDataFrame([(x, min(1.0, rows_per_lang / size[x])) for x in langs], "lang string, share double")
    u = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.join(F.broadcast(share), "lang").where(u < F.col("share"))
    counted = scratch.table(map_batches(chosen.select("lang", "text"), _runs, "lang string, run string, n bigint").groupBy("lang", "run").agg(F.sum("n").alias("n")))
    model = Model(pieces, langs, np.full((len(pieces), len(langs)), 1.0 / len(pieces)))
    single = np.array([len(p) == 1 for p in pieces])
    place = {x: i for i, x in enumerate(langs)}
    for r in range(rounds):
        uses, letters = np.full_like(model.probs, SMOOTH), np.zeros(len(pieces))
        held = spark.sparkContext.broadcast(model)
        found = map_batches(counted, _expected(held, r == 0), "lang string, piece bigint, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("n")).toArrow()
        for lang, piece, n in zip(*(found.column(c).to_pylist() for c in ("lang", "piece", "n"))):
            if lang is None:
                letters[piece] += n
            else:
                uses[piece, place[lang]] += n
        if r == 0:
            alone = (1 - ANY_LETTER) * letters / max(letters.sum(), 1) + ANY_LETTER * single / single.sum()
        model = Model(pieces, langs, uses / uses.sum(axis=0), np.maximum(alone, UNSEEN * (SMOOTH / uses.sum(axis=0)).max()))
    scratch.drop(counted)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", evidence_out: str | None = None) -> DataFrame:
    """``docs`` with a language and a score between 0 and 1 for the whole text of every row, and evidence if asked for.

    The score is the share of the best language when run probabilities are averaged (geometrically) over the text.
    Evidence, in nats over the whole text, is how much better the language explains it than unknown text does; below
    zero, no learned language explains it. Null texts and texts without a letter: und, 0 and 0. Repeated rows are judged
    alike; existing columns of the new names are replaced, all others go along. The model goes to every task.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = held.value.scorer()

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            langs, scores, evidence = scorer.judged(batch.column("text").to_pylist())
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(evidence, pa.float64())][: 2 + bool(evidence_out)]

        return work

    new = {lang_out: "string", score_out: "double"} | ({evidence_out: "double"} if evidence_out else {})
    return with_made(docs, {"text": named(text_col).cast("string")}, make, new)
