"""Operators on texts against brute force, exact round trips and held-out accuracy, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA, compare
from loadscape.llm import chat, decontam, langid, linededup, mixing, quality, sharding, toxicity, urlfilter
from loadscape.llm.queries import ORACLE_SQL, QUERIES, VOCABULARY, held_out
from loadscape.llm.scratch import Scratch


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return docs.toPandas()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    compare(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df())


ODD = ["", None, "\\", "###", "####", "</turn>", "<\\/turn>", "\\### Assistant: </turn> ok", "a\n### user: b</turn>\n", "#", "<", "é\U0001f600#\\##", "x" * 5000]


def test_chat_round_trip(spark):
    data = [(c, t, r, ODD[(c * 3 + t) % len(ODD)]) for c in range(12) for t, r in enumerate(("user", "assistant", "as:sis###tant", None))]
    data += [(None, 0, "user", "n"), (1, None, "assistant", "first"), (1, 0, "user", ODD[3])]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").withColumn("key", F.lit(1))
    for part_bytes in (1, 16 << 20):
        made = chat.format_conversations(df, part_bytes=part_bytes)
        found = defaultdict(list)
        for r in made.orderBy("conv_id", "part").collect():
            found[r.conv_id] += chat.turns_of(r.formatted.encode())
            data_ = r.formatted.encode()
            assert r.n_turns == len(chat.turns_of(data_))
            assert [chat.unescape(data_[a : a + n]) for a, n in zip(r.loss_start, r.loss_length)] == [x for role, x in chat.turns_of(data_) if role == b"assistant"]
        want = defaultdict(list)
        for c, t, role, text in sorted(data, key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
            want[c].append(((role or "").encode(), (text or "").encode()))
        assert found == want
        back = {r.conv_id: r for r in chat.read_back(made).collect()}
        for c, turns in want.items():
            assert back[c].turns_sha256 == hashlib.sha256(b"".join(r + b"\n" + t + b"\n" for r, t in turns)).hexdigest()
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_toxicity_separates(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [*rng.choice(words, 40)]
        toxic = i % 5 == 0
        if toxic:
            for k in range(1 + i % 4):
                text[k * 7] = ("Badword!", "viletonge,")[k % 2]
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    rows += [(601, None), (602, ""), (603, "badword " * 50_000), (None, "w1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("toxic_flag", F.lit("own"))
    model = toxicity.fit(df, spark.createDataFrame([*labels, (None, 1), (4, None), (9999, 1)], "doc_id bigint, toxic int"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    got = {r.doc_id: r for r in toxicity.predict(df, model).collect()}
    assert all(got[i].toxic_flag == (i % 5 == 0) for i in range(600))
    assert got[603].toxic_flag and not got[601].toxic_flag and not got[602].toxic_flag and not got[None].toxic_flag
    many, one = (np.mean([got[i].expected_severity for i in range(0, 600, 5) if i % 4 == k]) for k in (3, 0))
    assert many > one
    empty = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.predict(df, empty).where("toxic_flag").count() == 0


def test_ordinal_regression_is_the_likeliest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2)).astype(np.float32)
    score = x @ np.array([1.5, -1.0]) + rng.logistic(size=3000)
    w, cuts = toxicity._regress(x, np.digitize(score, [-1.0, 1.0]), 3)
    assert np.allclose(w, [1.5, -1.0], atol=0.15) and np.allclose(cuts, [-1.0, 1.0], atol=0.15)


def test_url_aliases(spark):
    link = '<html><link href="{}" rel="canonical"></html>'
    pages = [
        (1, "http://a.com/en/x", None), (2, "https://b.zz/1", link.format("http://a.com/en/x")), (3, "https://c.zz/2#top", "<META http-equiv=refresh content='0; url=//b.zz/1'>"),
        (4, "http://d.example.com/en/71", link.format("http://e.zz/3")), (5, "https://e.zz/3", ""), (6, "http://f.com/en/", link.format("https://e.zz/3")),
        (7, None, None), (8, "no-scheme", "x"), (9, "HTTP://EX.COM/EN/", None), (10, "http://sub.org/es/?q", None), (11, "http://g.zz/4", link.format("/5")), (12, "http://g.zz/5", None), (2, "https://b.zz/1", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("node", F.lit(1))
    from loadscape.llm.queries import URL_RULES

    rows = urlfilter.judge(df, URL_RULES, redirects=spark.createDataFrame([("http://g.zz/5", "http://sub.org/es/?q"), (None, "http://x.zz/")], "from_url string, to_url string")).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages)
    assert {i: r.verdict for i, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "block", 12: "block"}
    assert (got[1].rule, got[4].rule, got[6].rule, got[7].host, got[9].host) == ("com/en/", "example.com/en/7", "com/en/", "", "ex.com")
    many = [*URL_RULES, *(urlfilter.Rule("block", f"h{i}.zz", "/") for i in range(300))]
    again = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df, many).collect()}
    assert {i: x[0] for i, x in again.items()} == {i: r.rule for i, r in got.items()}
    assert urlfilter.judge(df.limit(0), URL_RULES).count() == 0


def test_line_dedup_small_and_full_filters(spark):
    line = "This is a line that is rather long, for sure it is"
    data = [(i, f"{line.upper() if i % 2 else line}  \nown {i}\n{line}\r") for i in range(6)] + [(6, None), (7, ""), (8, "\n".join(["short"] * 9)), (None, line), (9, line * 20_000), (3, line)]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("n_lines", F.lit("own")).withColumn("id", F.lit(1))
    for bits in (1 << 20, 1 << 30):
        got = {(r.doc_id, r.n_lines): r for r in linededup.drop_repeated_lines(df, max_bits=bits).collect()}
        assert len(got) == len(data)
        assert got[5, 3].n_dropped == 0 and all(got[i, 3].n_dropped == 2 and got[i, 3].text == f"own {i}" for i in range(5))
        assert got[3, 1].n_dropped == 1 and got[3, 1].text == "" and got[None, 1].n_dropped == 1
        assert (got[6, 1].text, got[7, 1].text, got[8, 9].n_dropped) == ("", "", 0)
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0


def test_mixing(spark, docs, local):
    got = mixing.assign_copies(docs.select("doc_id", "text", "source")).toPandas()
    assert (got._llm_copies <= 3).all() and abs(got.groupby("source")._llm_target.first().sum() - got._llm_size.sum()) < 1e-3
    assert (mixing.assign_copies(docs).toPandas().set_index("doc_id")._llm_copies == got.set_index("doc_id")._llm_copies).all()
    assert mixing.mix(docs).count() == got._llm_copies.sum() and mixing.mix(docs).columns == docs.columns
    big = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    for r in mixing.assign_copies(big).groupBy("source").agg(F.sum(F.col("_llm_size") * F.col("_llm_copies")).alias("taken"), F.first("_llm_target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.05
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (None, "x y", "a"), (3, "z", "b"), (3, "z", "b")], "doc_id bigint, text string, source string").withColumn("size", F.lit(0))
    assert mixing.assign_copies(odd).count() == 5 and mixing.mix(odd.limit(0)).count() == 0


def test_langid(spark, docs, local):
    model = langid.fit(docs, VOCABULARY, ~held_out(F.col("doc_id")))
    got = langid.predict(docs.withColumn("score", F.lit("own")), model).toPandas()
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    assert (got[held].lang == got[held].lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the " * 300_000), (None, "the")], "doc_id bigint, text string")
    found = {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    none = langid.fit(docs.limit(0), VOCABULARY, F.lit(True))
    assert {r.lang_pred for r in langid.predict(odd.limit(3), none).collect()} == {"und"} and langid.predict(odd.limit(0), model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = sorted({langid.START, langid.START + "a", "a", "b", "ab", "ba", "bab"})
    probs = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    model = langid.Model(pieces, ["x", "y"], probs)

    def brute(s, k):
        if not s:
            return 1.0
        total = 0.0
        for n in range(1, len(s) + 1):
            p = probs[pieces.index(s[:n]), k] if s[:n] in pieces else (model.lone if n == 1 else 0.0)
            total += p * brute(s[n:], k) if p else 0.0
        return total

    runs = ["ab", "bab", "abba", "cab", "a", "babab"]
    got = np.exp(model.scorer().log_probabilities(runs))
    want = np.array([[brute(langid.START + r, k) for k in range(2)] for r in runs])
    assert np.allclose(got, want, rtol=1e-4)


def test_sharding(spark, docs, local):
    got = QUERIES["op7_sharding"](spark, DATA).toPandas()
    assert sorted(got.doc_id) == sorted(local.doc_id)
    text = local.set_index("doc_id").text
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 1 for _, r in got.iterrows())
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    moved = got[got.shard != got.grown_shard]
    assert (moved.grown_shard == 16).all() and set(got.shard) <= set(range(16))

    def best(key, n):
        return max(range(n), key=lambda i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16), -i))

    assert all(r.shard == best(r.doc_id, 16) and r.grown_shard == best(r.doc_id, 17) for r in got.itertuples())
    many = spark.range(30_000).withColumnRenamed("id", "doc_id")
    n = Counter(r[0] for r in sharding.assign_shards(many, shards=[1.0, 3.0]).select("shard").collect())
    assert abs(n[1] / n[0] - 3) < 0.2
    hot = spark.createDataFrame([(1, "a")] * 50 + [(None, None)] * 20, "doc_id bigint, g string")
    slots = sharding.number_within(hot, "g", ["doc_id"], "slot", Scratch(spark, "test")).toPandas()
    assert sorted(slots[slots.g == "a"].slot) == list(range(50)) and sorted(slots[slots.g.isna()].slot) == list(range(20))


def test_quality_base(spark, local):
    texts = {int(i): t for i, t in zip(local.doc_id, local.text)} | {-1: None, -2: "", -3: "a b c d e f a b c d e g h i j", -4: "x\n \nx\ny\nx", -5: "é b # $ %", -6: "one two three " * 30_000}
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string").withColumn("score", F.lit("own"))
    model = quality.fit(df, spark.createDataFrame([(int(i),) for i in local.doc_id[::2]] + [(None,)], "doc_id bigint"))
    got = {r.doc_id: r for r in quality.judge(df, model).collect()}
    for i, t in texts.items():
        words, lines = re.findall(r"[^\x20\x09-\x0D]+", t or ""), [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        inside = {k + d for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for d in range(5)}
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        want = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len({*lines}), len(inside), failed
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, i
        assert r.kept == (not failed and r.score >= model.threshold)
    assert quality.judge(df.limit(0), model).count() == 0



def brute_leaks(texts, items):
    """(id, item) where the text holds 0.8 of the item's runs of five words, or all of a shorter one; nothing of the library is used."""

    def words(text):
        found = (re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        return [w for w in found if w]

    def runs(w, n):
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    read = {i: words(t) for i, t in texts.items()}
    by_length = {n: {i: runs(w, n) for i, w in read.items()} for n in range(1, 6)}
    out = set()
    for item, text in items:
        own = words(text)
        if own:
            n = min(5, len(own))
            whole = runs(own, n)
            out |= {(i, item) for i, r in by_length[n].items() if len(whole & r) >= 0.8 * len(whole)}
    return out


def test_decontamination(spark, docs, local):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    words = items[0][1].split()
    edited = " ".join([*words[:10], "changed", *words[11:]])
    filler = " ".join(f"z{i}" for i in range(3000))
    texts = {int(i): t for i, t in zip(local.doc_id, local.text)} | {-1: None, -2: "", -3: f"{filler} {edited.upper()} {filler}", -4: filler, -5: " ".join(words[: len(words) // 2])}
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string").withColumn("score", F.lit("own"))
    bench = spark.createDataFrame([*items, (None, "x"), (900, None), (901, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got == brute_leaks(texts, items) and any(i == -3 for i, _ in got)
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*texts} - {i for i, _ in got}
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_short_items_are_found_within_longer_texts(spark, monkeypatch):
    items = [(1, "Two plus two"), (2, "Paris"), (3, "a b c d"), (4, "one two three four five"), (5, "What is two plus two?\nFour"), (6, "")]
    texts = {1: "Why, two plus two, equals four today", 2: "two two plus", 3: "from PARIS.", 4: "x a b c d y", 5: "a b c x d", 6: "zero one two three four five six", 7: None, 8: "one two three four", 9: "what is two plus two? four", 10: "d c b a " * 500 + "two plus two"}
    df, bench = spark.createDataFrame([*texts.items()], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = {(1, 1), (3, 2), (4, 3), (6, 4), (9, 1), (9, 5), (10, 1)}
    assert brute_leaks(texts, items) == want
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == want
    monkeypatch.setattr(decontam, "INDEX_WORDS", 6)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == want
    assert sorted(r.doc_id for r in decontam.drop_leaks(df, bench).collect()) == [2, 5, 7, 8]


def test_scores_are_bm25_and_the_index_is_bounded():
    """Scores against the formula, word by word; the index takes at most 60 bytes a word."""
    rng = np.random.default_rng(4)
    items = [(i, " ".join(rng.choice([f"w{k}" for k in range(60)], 16))) for i in range(40)]
    index = decontam.Index(items)
    (c,) = index.classes
    for i, text in items:
        n, words = Counter(text.split()), sorted({w for _, t in items for w in t.split()})
        idf = {w: np.log(1 + (len(items) - d + 0.5) / (d + 0.5)) for w in words for d in [sum(w in t.split() for _, t in items)]}
        part = {w: idf[w] * m * 2.2 / (m + 1.2) for w, m in n.items()}
        half = text.split()[:9]
        place = np.array([int(np.flatnonzero(index.words == decontam.xxhash.xxh64_intdigest(w))[0]) for w in half])
        assert np.isclose(c.score(i, np.unique(place)), sum(part[w] for w in {*half}) / sum(part.values()))
    many = [(i, " ".join(rng.choice([f"v{k}" for k in range(9000)], 30))) for i in range(3000)]
    assert decontam.Index(many).nbytes <= 60 * 90_000


def test_leaks_across_blocks_of_a_long_text(spark, monkeypatch):
    item = " ".join(f"k{i}" for i in range(40))
    text = f"{'pad ' * 262_100}{item} {'pad ' * 1000}"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert decontam.leaks(df, spark.createDataFrame([(1, item)], "item_id bigint, text string")).count() == 1
