"""Ids against the sentencepiece library, codes against plain integer arithmetic, cuts against a pattern; odd rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import DATA
from loadscape.llm import fillmiddle, piecebpe, vectorcodes
from loadscape.llm.queries import QUERIES, VOCABULARY

SHA = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return piecebpe.load(VOCABULARY)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return piecebpe.Encoder(vocabulary)


def test_ids_of_documents(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op11_sentencepiece"](spark, DATA).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), SHA(",".join(map(str, ids))), SHA(library.decode(ids)))


LETTERS = st.one_of(st.sampled_from(" ▁aab eeinrst.,\n\t'é你ſ²½Ж\U0001f600\x00<s>019=-_#"), st.characters(exclude_categories=["Cs"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(LETTERS, max_size=60), max_size=5))
def test_ids_of_any_text(library, vocabulary, encoder, texts):
    ids, ends = encoder.encode(texts)
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    assert got == library.encode(texts)
    decoder = piecebpe.Decoder(vocabulary)
    assert [decoder.text(x) for x in got] == [library.decode(x) for x in got]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.integers(0, 31999)), max_size=15))
def test_text_of_any_ids(library, vocabulary, ids):
    assert piecebpe.Decoder(vocabulary).text(ids) == library.decode(ids)


def test_long_runs_and_repeats(library, encoder):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(1_000_000)), "=" * 5000, " " * 777, "\n" * 333, "a" * 1234, "你好" * 5000, "x " * 3000]
    ids, ends = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == library.encode(texts)


def test_what_is_remembered_is_bounded(vocabulary, library, monkeypatch):
    monkeypatch.setattr(piecebpe, "CACHE_CHARS", 2000)
    monkeypatch.setattr(piecebpe, "CACHE_PAIRS", 50)
    small, rng = piecebpe.Encoder(vocabulary), random.Random(5)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randrange(1, 90))) for _ in range(20)) for _ in range(5)]
        ids, ends = small.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == library.encode(texts)
        assert len(small.pairs) <= 50 and small.chars < 2000 + 5 * 20 * 90


def test_vocabulary_where_letters_are_no_pieces():
    """A letter without a piece still merges; places where pieces reach over spaces are not cut."""
    pieces = ["<unk>", " ", "a", "xy", "a b", "a ", "b"]
    v = piecebpe.Vocabulary(pieces, [2, 1, 1, 1, 1, 1, 1], {" ": 9, "a": 8, "xy": 0, "a b": 2, "a ": 1, "b": 7}, prefix=False)
    e = piecebpe.Encoder(v)
    ids, _ = e.encode(["a bxyx"])
    assert [pieces[i] for i in ids] == ["a b", "xy", "<unk>"]


def test_odd_rows_of_ids(spark, vocabulary):
    rows = spark.createDataFrame([(1, None, 7, "t"), (2, "", 7, "t"), (None, "ab c", 7, "t"), (None, "ab c", 7, "t")], "`doc.id` int, text string, IDS int, batch string")
    got = piecebpe.decode(piecebpe.encode(rows, vocabulary), vocabulary)
    assert got.columns == ["doc.id", "text", "batch", "ids", "decoded"]
    assert sorted((r[1] or "", r.decoded) for r in got.collect()) == [("", ""), ("", ""), ("ab c", "ab c"), ("ab c", "ab c")]
    assert piecebpe.encode(rows.limit(0), vocabulary).collect() == []
    assert piecebpe.decode(spark.createDataFrame([(None,)], "ids array<int>"), vocabulary).first().decoded == ""


def plain_codes(rows, entries=256, rounds=4):
    """rows: (id, label, components or None); the contract, in Python integers."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], np.array(r[2], "<i4").tobytes()))
    width = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    ends = [width * p // 4 for p in range(5)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in zip(ends, ends[1:])]

    def nearest(p, v):
        return min((sum((x - y) ** 2 for x, y in zip(v[ends[p] : ends[p + 1]], c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, r[2])[1] for r in kept] for p in range(4)]
        for p in range(4):
            for k in {*found[p]}:
                own = [r[2][ends[p] : ends[p + 1]] for r, f in zip(kept, found[p]) if f == k]
                books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    out = []
    for i, label, v in kept:
        best = [nearest(p, v) for p in range(4)]
        out.append([i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)])
    total = {}
    for _, label, _, e in out:
        total[label] = total.get(label, 0) + e
    numbers = [str(x) for p in range(4) for c in books[p] for x in c]
    return sorted([(i, code, e, total[label], SHA(",".join(numbers))) for i, label, code, e in out], key=str)


def coded(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    return sorted(map(tuple, vectorcodes.compress(df.repartition(3)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)) if i % 7 else None, rng.normal(size=8).tolist()) for i in range(330)]
    rows += [(1000 + i, 1, [0.25, -0.25, 1.0, 0.0, 0.5, 0.5, 0.5, -1.5]) for i in range(120)] + [(-5, 1, [0.25, -0.25, 1.0, 0.0, 0.5, 0.5, 0.5, -1.5])] * 3
    rows += [(2000, 1, None), (2001, 1, []), (2002, 1, [None] * 8), (2003, 1, [float("nan")] + [0.0] * 7), (2004, 1, [float("inf")] + [0.0] * 7), (2005, 1, [1.0] * 4), (None, None, [0.1] * 8)]
    assert coded(spark, rows) == plain_codes(rows)


@pytest.mark.parametrize("width", [4, 6, 1])
def test_codes_of_few_vectors_and_other_widths(spark, width):
    rows = [(i, 0, [(i * k % 7) / 3 for k in range(1, width + 1)]) for i in range(9)]
    assert coded(spark, rows) == plain_codes(rows)


def test_no_vectors(spark):
    assert coded(spark, [(1, 1, None)]) == []
    assert coded(spark, []) == []


def test_huge_components_stay_exact(spark):
    rows = [(i, 0, [1e30 if i % 2 else -1e30, 3.0, 4.0, float(i)] * 2) for i in range(20)]
    got = coded(spark, rows)
    assert len(got) == 20 and all(0 <= r[2] <= vectorcodes.MOST for r in got)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([3, 40, 100_000, 180_000_000]), st.integers(1, 20), st.integers(1, 60))
def test_screening_loses_no_nearest_entry(seed, spread, width, n):
    """Numbers so large that float32 cannot tell entries apart, ties, and equal entries."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(-spread, spread + 1, width)
    entries = np.clip(centre + rng.integers(-3, 4, (n, width)) * rng.choice([1, 1, spread], (n, 1)), -spread, spread)
    x = np.concatenate([entries, np.clip(centre + rng.integers(-4, 5, (50, width)), -spread, spread)])
    index, error = vectorcodes.Nearest(entries)(x)
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == exact.argmin(axis=1).tolist() and error.tolist() == exact.min(axis=1).tolist()


def test_columns_of_codes(spark):
    df = spark.createDataFrame([(1, [0.5] * 4, None, 8, "t"), (1, [0.5] * 4, None, 8, "t")], "vec_id int, embedding array<float>, label int, Code int, `_label` string")
    got = vectorcodes.compress(df)
    assert got.columns == ["vec_id", "label", "_label", "code", "error", "label_error", "codebooks_sha256"]
    assert [r.code for r in got.collect()] == ["00000000"] * 2


TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_cut(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    digest = SHA(f"42:{'null' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def check_cuts(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = fillmiddle.transform(df, **how).withColumn("back", fillmiddle.restored(F.col("form"), F.col("output"))).collect()
    want = sorted([(i, *plain_cut(i, t), t or "") for i, t in rows], key=str)
    assert sorted([tuple(r) for r in got], key=str) == want


ODD = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, " \t\x0b"), (4, "x"), (5, "no <P> here a b c"), (6, "a  b\n\nc  "), (7, "é你\U0001f600  \U0001f600 \xa0 b\x1c c"), (8, "<P"), (9, "<S > <"), (10, "y" * 300_000)]


def test_cuts_of_odd_rows_and_copies(spark):
    words = ["a", "bb ", "\n c", "<P", "S>", "é", "  ", "你好"]
    rng = random.Random(2)
    rows = ODD + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(200)]
    rows += [(1000 + i, "one text of many copies " + "z " * (i % 3)) for i in range(300)]
    check_cuts(spark, rows)


@pytest.mark.parametrize("bits", [0, 64])
def test_a_full_or_missing_filter_changes_nothing(spark, bits, monkeypatch):
    """Every row goes through the index, or hot texts are met by many tasks."""
    if bits:
        monkeypatch.setattr(fillmiddle, "HOT_BYTES", 200)
        monkeypatch.setattr(fillmiddle, "_filter", lambda *_: fillmiddle.Filter(np.full(1, -1, np.int64)))
    check_cuts(spark, ODD + [(i, f"copy of a text {i % 4} " * 5) for i in range(20, 90)], **({"max_bits": bits} if bits else {}))


def test_filter_holds_every_repeated_hash(spark):
    rng = np.random.default_rng(1)
    for n, most in ((5, 1 << 20), (300, 1 << 20), (300, 256)):
        hashes = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        held = fillmiddle._filter(spark.createDataFrame([(int(h),) for h in hashes], "hash bigint"), n, most)
        assert held(hashes).all() and held.words.nbytes * 8 <= max(64, most)


def test_no_rows_and_columns(spark):
    check_cuts(spark, [])
    df = spark.createDataFrame([(1, "a b", 3, 4, 5)], "doc_id int, text string, N int, `_text` int, `a.b` int")
    assert fillmiddle.transform(df).columns == ["doc_id", "_text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fillmiddle.transform(df).first()["a.b"] == 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=200, unique=True))
def test_selected_numbers(numbers):
    numbers = sorted(numbers)
    held = fillmiddle.EliasFano.of(np.array(numbers))
    assert [held.select(k) for k in range(len(numbers))] == numbers
    assert len(held.low) + len(held.high) <= len(numbers) * (2 + max(1, numbers[-1] // len(numbers)).bit_length()) / 8 + 3


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a b\n\t\x0b\x1c\xa0é\U0001f600"), max_size=40))
def test_token_ends(text):
    ends = np.cumsum([len(x) for x in TOKEN.findall(text)]).tolist()
    assert fillmiddle.token_ends(text).tolist() == ends


def test_pairs_kept_apart_equal_merging():
    """Two tokens stay two exactly where merging all their letters gives them, equal ranks too; a long list needs no heap."""
    import random as _random

    from loadscape.llm import piecebpe

    draw = _random.Random(11)
    for _ in range(300):
        rank = {"".join(draw.choices("abc", k=draw.randint(2, 5))): draw.randint(0, 8) for _ in range(draw.randint(1, 25))}
        for _ in range(40):
            a, b = ("".join(draw.choices("abc", k=draw.randint(1, 5))) for _ in "ab")
            assert piecebpe.kept_apart(a, b, rank) == (piecebpe.merged([*a, *b], rank) == [a, b])
