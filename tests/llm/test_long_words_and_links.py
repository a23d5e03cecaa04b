"""Words and runs of any length in bounded memory; links as an independent reader of HTML finds them."""

import random
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loadscape.llm import decontam, langid, quality, toxicity, urlfilter
from loadscape.llm.text import Known

TEXTS, WORD = 300, 48_000


def long_words(n=TEXTS):
    rng = np.random.default_rng(8)
    for i in range(n):
        yield (f"few words {i} before " + "".join(map(chr, rng.integers(97, 123, 40))) * (WORD // 40)).encode()


def grown(run):
    tracemalloc.start()
    run()
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return size


def test_words_that_are_remembered_are_bounded():
    calls = []
    known = Known(lambda w: calls.append(w) or len(w), most=1000, most_bytes=5000)
    for w in [b"x" * 101] * 3 + [b"%d" % i for i in range(5000)] + [b"y" * 100] * 60:
        assert known[w] == len(w) and known.bytes <= 5000 and len(known) <= 1000
    assert calls.count(b"x" * 101) == 3 and calls.count(b"y" * 100) == 1


def test_long_words_do_not_fill_the_memory_of_quality_and_decontamination():
    grams = quality.Grams()
    assert grown(lambda: [grams(t) for t in long_words()]) < 4 << 20
    search = decontam.Search(decontam.Index([(1, "who wrote the long book of words\nnobody knows who wrote it")]))
    assert grown(lambda: [search([t]) for t in long_words()]) < 4 << 20
    features = toxicity.Features([1, 2, 3])
    assert grown(lambda: [features(t) for t in long_words(20)]) < 4 << 20
    text = next(long_words(1))
    assert grams(text).tolist() == quality.Grams()(text).tolist()


def model(langs=3, seed=1):
    rng = np.random.default_rng(seed)
    pieces = sorted({langid.START, *"abcdefgh", *("".join(rng.choice([*"abcdefgh"], n)) for n in (2, 2, 3, 3, 4, 5) for _ in range(8)), langid.START + "ab"})
    probs = rng.random((len(pieces), langs))
    return langid.Model(pieces, [f"l{i}" for i in range(langs)], probs / probs.sum(axis=0), probs[:, 0] / probs[:, 0].sum())


def test_long_runs_do_not_fill_the_memory_of_language_id():
    scorer = model().scorer()
    assert grown(lambda: [scorer.judged([t.decode()[k : k + 60]]) for t in long_words(20) for k in range(0, 3000, 60)]) < 4 << 20


@pytest.mark.parametrize("block", [5, 7, 4096])
def test_blocks_of_a_run_give_the_sums_of_the_whole(block, monkeypatch):
    monkeypatch.setattr(langid, "LOOKED_UP", block)
    m, rng = model(), random.Random(2)
    scorer = m.scorer()
    for n in (41, 60, 80):
        run = "".join(rng.choice("abcdefghz") for _ in range(n))
        monkeypatch.setattr(langid, "LONG", 40)
        split = scorer.log_probabilities([run])
        uses = langid.expected_uses(m, scorer.lattice, [run], np.array([1]), np.array([2.0]))
        monkeypatch.setattr(langid, "LONG", 1000)
        assert np.allclose(split, scorer.log_probabilities([run]), rtol=1e-5)
        assert np.allclose(uses, langid.expected_uses(m, scorer.lattice, [run], np.array([1]), np.array([2.0])))


def test_a_long_run_in_bounded_memory():
    scorer, rng = model(20).scorer(), random.Random(3)
    run = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    tracemalloc.start()
    got = scorer.log_probabilities([run])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and np.isfinite(got).all()
    a, b = (scorer.log_probabilities([run[:k]])[0, 0] for k in (50_000, 99_900))
    assert np.isclose(got[0, 0] / 100_000, a / 50_000, rtol=0.01) and b > got[0, 0]


BAD = "http://bad.test/x"
BLOCKED = [
    f'<link title="a>b" rel="canonical" href="{BAD}">',
    '<base href="http://bad.test/"><link rel=canonical href="x">',
    '<link rel="canonical" href="http&#58;//bad.test/x">',
    f'<link/rel="canonical"/href="{BAD}">',
    f'<meta http-equiv=refresh content="0; {BAD}">',
    "<link rel=canonical href='http&#x3a;&sol;/bad.test:80/x'/>",
    f"<META HTTP-EQUIV='Refresh' CONTENT=\"0;URL='{BAD}'\">",
    '<base href="/a/"><link rel=canonical href="https://bad.test:443/x">',
]
ALLOWED = [
    f'<!-- <link rel="canonical" href="{BAD}"> -->',
    f"<script>var a = '<link rel=\"canonical\" href=\"{BAD}\">'</script>",
    f'<link title=" rel=canonical " href="{BAD}">',
    '<meta http-equiv="refresh" content="5">',
    f'<link rel="canonical" href="{BAD.replace(":", "&amp;#58;")}">',
    f"<title><link rel=canonical href={BAD}></title>",
    f'<!-- <link rel="canonical" href="{BAD}">',
]


def test_lost_and_false_links(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.ok/p", h) for i, h in enumerate(BLOCKED + ALLOWED)], "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, [urlfilter.Rule("block", "bad.test", "/x")]).collect()}
    assert [got[i] for i in range(len(got))] == ["block"] * len(BLOCKED) + ["allow"] * len(ALLOWED)


class Links(HTMLParser):
    """Canonical links of a page, by the standard library's reader."""

    def __init__(self, page):
        super().__init__()
        self.found = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        values = dict(reversed(attrs))
        if tag == "link" and "canonical" in (values.get("rel") or "").lower().split():
            self.found.append(values.get("href") or "")


def test_random_pages_against_another_reader(spark):
    rng = random.Random(11)
    quote = lambda v: rng.choice([f'"{v}"', f"'{v}'", v if " " not in v and ">" not in v else f'"{v}"'])

    def tag():
        attributes = [("rel", rng.choice(["canonical", "Canonical nofollow", "icon"])), ("href", f"http://t{rng.randrange(40)}.test/{rng.choice(['', 'a', 'b&amp;c', 'd&#37;'])}"), ("title", rng.choice(["x", "a > b", "rel=canonical", "it is"]))]
        rng.shuffle(attributes)
        return rng.choice(["<link ", "<LINK\n"]) + " ".join(f"{rng.choice([k, k.upper()])}{rng.choice(['=', ' = '])}{quote(v)}" for k, v in attributes) + rng.choice([">", " />"])

    def page():
        return "".join(rng.choice([tag, tag, lambda: f"<!-- {tag()} -->", lambda: f"<script>{tag()}</script>", lambda: "<p>text &amp; more</p>", lambda: "<br>"])() for _ in range(rng.randrange(6)))

    pages = [page() for _ in range(300)]
    df = spark.createDataFrame([(f"n{i}", f"http://h{i}.ok/p", h) for i, h in enumerate(pages)], "node string, url string, html string")
    got = {}
    for r in urlfilter.alias_edges(df.select("node", "url", urlfilter.telling_tags(F.col("html")).alias("tags"))).collect():
        got.setdefault(r.a, []).append(r.b)
    for i, h in enumerate(pages):
        want = [x.removeprefix("http://") for x in Links(h).found]
        assert sorted(got.get(f"n{i}", [])) == sorted(want), h


def test_long_pages_do_not_overflow(spark):
    many = " ".join(f'a{i}="b{i}"' for i in range(20_000))
    pages = [f'<link {many} rel=canonical href="{BAD}">', "<!--" + "x" * 3_000_000 + f'--><link rel="canonical" href="{BAD}">', "<script>" + "'<" * 1_000_000, "<meta " * 100_000 + " refresh", '<link rel="canonical" title="' + "z" * 2_000_000 + f'" href="{BAD}">']
    df = spark.createDataFrame([(i, f"http://h{i}.ok/p", h) for i, h in enumerate(pages)], "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, [urlfilter.Rule("block", "bad.test", "/x")]).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "block"}


def test_hash_of_long_words_is_that_of_the_index():
    word = b"w" * 300
    index = decontam.Index([(1, f"{word.decode()} is what the question asks\nand {word.decode()} the answer")])
    search = decontam.Search(index)
    assert index.words[search._term(word)] == xxhash.xxh64_intdigest(word)
    assert search([b"so " + word + b" is what the question asks and " + word + b" the answer here"])[0]
