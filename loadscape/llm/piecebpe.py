"""SentencePiece BPE encoding by a table of last tokens, and decoding.

The encoding of a text is settled prefix by prefix: exactly one token can end the encoding of a prefix, namely the one
that ends there (an automaton over the vocabulary finds all that do) and is compatible with the last token of the prefix
before it, which means that merging the two tokens' letters anew gives these two tokens. The table holds that token for
every prefix; walking it backwards from the end gives the ids.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loadscape.llm.arrow import named, with_made

#: The sign that stands for a space in vocabulary files. Inside this module pieces bear a plain space in its place.
MARK = "▁"
NORMAL, UNKNOWN_TYPE, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6
UNKNOWN_TEXT = " ⁇ "
#: A worker remembers runs of up to so many characters, up to so many characters in all, and so many pairs of tokens.
REMEMBERED_CHARS, CACHE_CHARS, CACHE_PAIRS = 64, 8_000_000, 1_000_000
#: Latin letters, and patterns of runs: cut before spaces and between Latin letters and other signs, before spaces, not.
_LATIN = "a-zA-ZÀ-ɏ"
_CUTS = [re.compile(f" *[{_LATIN}]+| *[^{_LATIN} ]+| +"), re.compile(" *[^ ]+| +"), re.compile("(?s).+")]


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    """Every byte that is not part of a character becomes one replacement character."""
    if not isinstance(error, UnicodeDecodeError):
        raise error
    return "�" * (error.end - error.start), error.end


codecs.register_error("loadscape-each-byte", _each_byte)


def merged(symbols: list[str], rank: dict[str, int]) -> list[str]:
    """Adjacent symbols merged while their concatenation is ranked: lowest rank first, leftmost among equals."""
    n = len(symbols)
    text, before, after = [*symbols], [*range(-1, n - 1)], [*range(1, n), -1]
    waiting: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (r := rank.get(text[i] + text[after[i]])) is not None:
            heapq.heappush(waiting, (r, i, len(text[i]) + len(text[after[i]])))

    for i in range(n):
        offer(i)
    while waiting:
        _, i, size = heapq.heappop(waiting)
        j = after[i]
        if not text[i] or j < 0 or len(text[i]) + len(text[j]) != size:
            continue
        text[i], text[j], after[i] = text[i] + text[j], "", after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [x for x in text if x]


#: Beyond all ranks.
NEVER = 1 << 62


def kept_apart(a: str, b: str, rank: dict[str, int]) -> bool:
    """Whether the letters of a and b merge into just these two, as ``merged`` would: over once a merge joins both.

    Tokens are short, so the lowest rank is looked for in a list; among equals that gives the leftmost.
    """
    parts, edge, get = [*a, *b], len(a) - 1, rank.get
    ranks = [get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
    while (least := min(ranks)) < NEVER:
        i = ranks.index(least)
        if i == edge:
            return False
        parts[i] += parts.pop(i + 1)
        del ranks[i]
        if i < edge:
            edge -= 1
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], NEVER)
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], NEVER)
    return len(parts) == 2


@dataclass
class Vocabulary:
    """What a vocabulary file says; small enough to be sent to every task (about a megabyte for 32,000 pieces).

    pieces: text of each id, with plain spaces. types: kind of each id. rank: order of merges of the normal pieces, equal
    for equal scores. prefix: whether a space is put before every text.
    """

    pieces: list[str]
    types: list[int]
    rank: dict[str, int]
    prefix: bool = True
    byte_ids: list[int] = field(default_factory=list)
    digest: str = ""

    @property
    def unknown(self) -> int:
        return self.types.index(UNKNOWN_TYPE)


def load(path: str) -> Vocabulary:
    """Read a SentencePiece BPE file on the driver. Only texts taken as they are can be encoded: files with a table of
    character replacements, user-defined symbols, removal of white space or another kind of model are refused."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(data := f.read())
    rules, train = proto.normalizer_spec, proto.trainer_spec
    types = [int(p.type) for p in proto.pieces]
    known = {NORMAL, UNKNOWN_TYPE, CONTROL, BYTE}
    if train.model_type != train.BPE or not set(types) <= known or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or train.treat_whitespace_as_suffix:
        raise ValueError(f"{path} is not a plain BPE vocabulary")
    pieces = [p.piece.replace(MARK, " ") for p in proto.pieces]
    scores = sorted({p.score for p in proto.pieces if p.type == NORMAL}, reverse=True)
    order = {s: i for i, s in enumerate(scores)}
    rank = {x: order[p.score] for x, p in zip(pieces, proto.pieces) if p.type == NORMAL}
    by_byte = {x: i for i, (x, t) in enumerate(zip(pieces, types)) if t == BYTE}
    byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if train.byte_fallback else []
    return Vocabulary(pieces, types, rank, rules.add_dummy_prefix, byte_ids, hashlib.sha256(data).hexdigest())


class Encoder:
    """Tokens are numbered: the ids of normal pieces, and numbers beyond all ids for letters that are no piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.text = [*v.pieces]
        normal = [i for i, t in enumerate(v.types) if t == NORMAL]
        letters = {v.pieces[i] for i in normal if len(v.pieces[i]) == 1}
        inside = sorted({c for i in normal for c in v.pieces[i]} - letters)
        self.lone = {c: len(v.pieces) + k for k, c in enumerate(inside)}
        self.text += inside
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            piece = v.pieces[i]
            if len(piece) == 1 or len(merged([*piece], v.rank)) == 1:
                self.automaton.add_word(piece, (i, len(piece)))
        for c, i in self.lone.items():
            self.automaton.add_word(c, (i, 1))
        self.automaton.make_automaton()
        #: Runs are encoded alone, so no piece may reach over a place where the pattern cuts.
        whole = [v.pieces[i] for i in normal]
        self.runs = next(c for c in _CUTS if all(c.fullmatch(x) and len(c.findall(x)) == 1 for x in whole))
        self.length = [*map(len, self.text)]
        self.bigrams = {v.pieces[i][k : k + 2] for i in normal for k in range(len(v.pieces[i]) - 1)}
        self.pairs: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self.seen: dict[str, int] = {}
        self.chars, self.flat, self.ends = 0, array("i"), array("q", [0])

    def compatible(self, left: int, right: int) -> bool:
        """Whether the letters of the two tokens merge into just these two; kept in pairs."""
        a, b = self.text[left], self.text[right]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = a[-1] + b[0] not in self.bigrams or kept_apart(a, b, self.v.rank)
        return known

    def tokens(self, run: str) -> list[int]:
        """Ids of a run: the table of last tokens, filled forwards and read backwards."""
        n, pairs = len(run), self.pairs
        last = [-1] * (n + 1) if n <= REMEMBERED_CHARS else array("i", [-1]) * (n + 1)
        for end, (token, length) in self.automaton.iter(run):
            if last[end + 1] >= 0:
                continue
            if length <= end and (before := last[end + 1 - length]) >= 0:
                known = pairs.get(before << 32 | token)
                if not (self.compatible(before, token) if known is None else known):
                    continue
            last[end + 1] = token
        out, j, ids, n_ids, length = [], n, self.v.byte_ids, len(self.v.pieces), self.length
        while j:
            token = last[j]
            if 0 <= token < n_ids:
                out.append(token)
                j -= length[token]
                continue
            j -= 1
            if ids:
                out += [ids[b] for b in reversed(run[j].encode())]
            elif not out or out[-1] != self.v.unknown:
                out.append(self.v.unknown)
        out.reverse()
        return out

    def _number(self, run: str) -> int:
        """The place of a run's ids in flat; a run that is not remembered is encoded each time it comes."""
        number = len(self.ends) - 1
        if len(run) <= REMEMBERED_CHARS:
            self.seen[run] = number
            self.chars += len(run)
        self.flat.extend(self.tokens(run))
        self.ends.append(len(self.flat))
        return number

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ends of each text's ids)."""
        numbers: list[np.ndarray] = []
        ends, total = np.zeros(len(texts) + 1, np.int64), 0
        if self.chars > CACHE_CHARS or len(self.flat) > CACHE_CHARS:
            self.clear()
        for i, text in enumerate(texts):
            if text:
                whole = (" " if self.v.prefix else "") + text.replace(MARK, " ")
                runs = self.runs.findall(whole)
                seen = self.seen
                places = [*map(seen.get, runs)]
                if None in places:
                    places = [(seen[r] if r in seen else self._number(r)) if p is None else p for p, r in zip(places, runs)]
                found = np.array(places, np.int64)
                numbers.append(found)
                total += len(found)
            ends[i + 1] = total
        at = np.concatenate([np.empty(0, np.int64), *numbers])
        flat, bounds = np.frombuffer(self.flat, np.int32) if self.flat else np.empty(0, np.int32), np.frombuffer(self.ends, np.int64)
        size = bounds[at + 1] - bounds[at]
        into = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.arange(into[-1]) + np.repeat(bounds[at] - into[:-1], size)]
        return ids, into[ends]


#: The encoder of this Python worker: workers are used again, and what one has learned of runs and pairs with them.
_encoder: list[Encoder] = []


def _shared(vocabulary: Vocabulary) -> Encoder:
    if not _encoder or not vocabulary.digest or _encoder[0].v.digest != vocabulary.digest:
        _encoder[:] = [Encoder(vocabulary)]
    return _encoder[0]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        plain = {CONTROL: b"", UNKNOWN_TYPE: UNKNOWN_TEXT.encode()}
        value = {i: b for b, i in enumerate(v.byte_ids)}
        self.bytes = [plain.get(t, bytes([value[i]]) if i in value else p.encode()) for i, (p, t) in enumerate(zip(v.pieces, v.types))]
        self.silent = {i for i, t in enumerate(v.types) if t == CONTROL}
        self.spaced = {i for i, t in enumerate(v.types) if t == NORMAL and v.pieces[i].startswith(" ")} if v.prefix else set()

    def text(self, ids: list[int]) -> str:
        """The text of the ids; the space put before it is taken away, bytes that are no character are replaced."""
        k = 0
        while k < len(ids) and ids[k] in self.silent:
            k += 1
        data = b"".join([self.bytes[i] for i in ids[k:]])
        return (data[1:] if k < len(ids) and ids[k] in self.spaced else data).decode("utf-8", "loadscape-each-byte")


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, an array of int, without begin or end ids.

    Null and empty texts have no ids; repeated rows fare alike, an empty table stays empty, other columns go along
    whatever their names and ``out_col`` is replaced. Each text is read by one task, in time and memory in proportion to
    its length; what a task remembers is bounded by its characters. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        encoder = _shared(held.value)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, ends = encoder.encode(batch.column("text").to_pylist())
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]

        return work

    return with_made(docs, {"text": named(text_col).cast("string")}, make, {out_col: "array<int>"})


def decode(rows: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of each row's ids.

    No ids, and a null, give the empty text; control ids say nothing, the unknown id has its own sign, byte ids that make
    no character give one replacement character each; a null or foreign id among the ids is an error. Other columns go
    along and ``out_col`` is replaced.
    """
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        decoder = Decoder(held.value)
        return lambda batch: [pa.array([decoder.text(x or []) for x in batch.column("ids").to_pylist()], pa.string())]

    return with_made(rows, {"ids": named(ids_col).cast("array<int>")}, make, {out_col: "string"})
