"""Columns of any name, links of both kinds, and the models against versions that use nothing of the library."""

import os
import random
import zlib
from collections import Counter, defaultdict
from urllib.parse import urljoin, urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from loadscape.llm import chat, decontam, langid, linededup, mixing, quality, scratch, sharding, simhash, toxicity, urlfilter
from loadscape.llm.arrow import named
from loadscape.llm.queries import URL_RULES, VOCABULARY, held_out
from loadscape.llm.scratch import Scratch

ODD = ["a.b", "_llm_text", "_llm_id", "_llm_size", "_llm_copies", "_llm_a", "_0", "text_", "b`c", "N_LINES"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the cat and the dog went to the sea", "en", "s"), (2, "der Hund und die Katze gehen an das Meer", "de", "s"), (None, None, None, None), (2, "", "de", "t"), (2, "", "de", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(f"own {c}") for c in ODD})


def carried(df, but=()):
    """Every odd column still holds what it held."""
    names = [c for c in ODD if c not in but]
    assert {*names} <= {*df.columns}
    for row in df.collect():
        assert all(row[c] == f"own {c}" for c in names)
    return df


def test_odd_columns_go_along(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    n = docs.count()
    assert carried(toxicity.predict(docs, toxicity.fit(docs, labels.withColumn("_llm_id", F.lit(0))))).count() == n
    assert carried(quality.judge(docs, quality.fit(docs, labels))).count() == n
    assert carried(linededup.drop_repeated_lines(docs), ["N_LINES"]).count() == n
    assert carried(langid.predict(docs, langid.fit(docs, VOCABULARY, F.lit(True)))).count() == n
    assert carried(sharding.assign_shards(docs)).columns == [*docs.columns, "shard"]
    mixed = carried(mixing.mix(docs))
    assert mixed.columns == docs.columns
    assert carried(mixing.assign_copies(docs), ["_llm_size", "_llm_copies"]).count() == n
    kept = carried(simhash.keep_one(docs))
    assert kept.columns == docs.columns and kept.count() == 3
    bench = spark.createDataFrame([(9, "dog went to")], "item_id bigint, text string")
    clean = carried(decontam.drop_leaks(docs, bench))
    assert clean.columns == docs.columns and clean.count() == n - 1
    assert [r.doc_id for r in decontam.leaks(docs, bench).collect()] == [1]
    pages = docs.select(*map(named, ODD), F.col("doc_id").alias("page_id"), F.lit("http://a.com/en/").alias("url"), F.lit("").alias("html"))
    assert {r.verdict for r in urlfilter.judge(pages, URL_RULES).collect()} == {"block"}
    turns = docs.select(*map(named, ODD), F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert sum(r.n_turns for r in chat.format_conversations(turns).collect()) == n


def test_names_of_other_columns_may_be_parameters(spark):
    df = spark.createDataFrame([(1, "a b c", "x")], "`my.id` bigint, `my.text` string, `my.source` string")
    assert mixing.mix(df, "my.id", "my.text", "my.source").count() == 1
    assert linededup.drop_repeated_lines(df, "my.id", "my.text").first()["my.text"] == "a b c"
    assert simhash.keep_one(df, "my.id", "my.text").count() == 1 and sharding.assign_shards(df, "my.id").count() == 1


def test_scratch_is_shared_or_local(spark, monkeypatch):
    made = Scratch(spark, "probe")
    made.table(spark.range(3))
    assert made.base.startswith(scratch.scratch_dir(spark)) and made.base in scratch._written
    monkeypatch.setattr(scratch, "_written", [made.base])
    assert os.path.isdir(made.base)
    scratch.clean(spark)
    assert not os.path.exists(made.base) and not scratch._written

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Far)


def test_aliases_against_union_find(spark):
    """Random pages with any number of links of both kinds, relative ones too; components by urllib and union-find."""
    rng = random.Random(5)
    hosts, segments = ["a.com", "b.zz", "c.org", "d.example.com", "e.yy", "f.example.net"], ["en", "de", "es", "x", "8"]
    url = lambda: f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(segments) for _ in range(rng.randrange(3))) + rng.choice(["", "?q=1&r=2"])
    tags = [
        '<link rel="canonical" href="{}"/>', "<LINK href='{}' rel='alternate canonical'>", '<meta http-equiv="Refresh" content="0; url={}">', "<meta content='3;URL={}' http-equiv=refresh>",
    ]
    pages, links = [], []
    for i in range(150):
        own, html = url(), '<link rel=stylesheet href="/s.css"><meta name=x content="url=/no">'
        for _ in range(rng.choice([0, 0, 1, 2])):
            to = rng.choice([url(), "//" + url()[7:], f"/{rng.choice(segments)}/{rng.choice(segments)}", f"../{rng.choice(segments)}", "./x", "..", "?q=1", "#top", "mailto:x@y", "x?r=http://a.com/", "../../en/./8"])
            html += rng.choice(tags).format(to.replace("&", "&amp;"))
            links.append((own, to))
        pages.append((i, own, html))

    def node(u):
        p = urlsplit(u)
        return p.netloc + (p.path or "/") + (f"?{p.query}" if p.query else "") if p.netloc else None

    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for own, to in links:
        if to[0] != "#" and (far := node(urljoin(own, to))):
            parent[find(far)] = find(node(own))

    def rule(host, path):
        fits = [(len(h) + len(p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=(0, None, None))[1:]

    groups = defaultdict(set)
    for x in parent:
        groups[find(x)].add(x)
    verdicts = {}
    for members in groups.values():
        found = {rule(m.partition("/")[0], urlsplit("http://" + m).path)[1] for m in members}
        verdicts |= {m: "block" if "block" in found and "allow" not in found else "allow" for m in members}
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(df, URL_RULES).collect()}
    by_group = 0
    for i, own, _ in pages:
        p = urlsplit(own)
        name, verdict = rule(p.netloc, p.path)
        want = verdict or verdicts.get(node(own), "allow")
        by_group += verdict is None and want == "block"
        assert (got[i].rule, got[i].verdict) == (name, want), own
        mates = groups[find(node(own))] if node(own) in parent else None
        assert got[i].component == (min(mates) if mates and len(mates) > 1 else None)
    assert by_group > 5


def test_a_page_with_a_canonical_link_keeps_its_redirect(spark):
    html = '<link rel="canonical" href="http://good.test/b"><meta http-equiv="refresh" content="0; url={}">'
    pages = [(1, "http://p.test/a", html.format("http://bad.test/x")), (2, "http://p.test/d/e", html.replace("good", "fine").format("../x")), (3, "http://q.test/", None)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rules = [urlfilter.Rule("block", "bad.test", "/"), urlfilter.Rule("block", "p.test", "/x")]
    assert {r.page_id: r.verdict for r in urlfilter.judge(df, rules).collect()} == {1: "block", 2: "block", 3: "allow"}


def brute_sum(s, p):
    """Probability of a string over all segmentations, one after another."""
    return 1.0 if not s else sum(p(s[:n]) * brute_sum(s[n:], p) for n in range(1, len(s) + 1) if p(s[:n]))


def test_long_pieces_and_long_runs_are_summed_whole():
    long = "qrstuvwxyzabcdef"
    pieces = sorted({langid.START, langid.START + "a", "a", "b", "ab", "ba", long, *long})
    probs = np.random.default_rng(0).dirichlet(np.ones(len(pieces)), 2).T
    model = langid.Model(pieces, ["x", "y"], probs)
    chance = lambda k: lambda s: probs[pieces.index(s), k] if s in pieces else (model.lone if len(s) == 1 else 0.0)
    runs = [f"ab{long}a", long]
    got = model.scorer().log_probabilities(runs)
    assert np.allclose(np.exp(got), [[brute_sum(langid.START + r, chance(k)) for k in range(2)] for r in runs], rtol=1e-4)
    run, k = "".join(np.random.default_rng(1).choice([*"abz"], 200)), 1
    table, s, p = [1.0], langid.START + run, chance(k)
    scale = 0.0
    for j in range(1, len(s) + 1):
        table.append(sum(table[i] * p(s[i:j]) for i in range(max(0, j - 20), j)))
        if table[j] < 1e-200:
            table, scale = [x * 1e200 for x in table], scale - 200 * np.log(10)
    assert np.isclose(model.scorer().log_probabilities([run])[0, k], np.log(table[-1]) + scale, rtol=1e-5)
    short, whole = "ab" * 10, "ab" * 40
    lattice = langid.Lattice(pieces)
    uses = [langid.expected_uses(model, lattice, [r], np.array([0]), np.array([1.0]))[0] for r in (short, whole)]
    assert np.isclose(uses[1] @ [*map(len, pieces), 0], 81) and np.isclose(uses[0] @ [*map(len, pieces), 0], 21)


def test_expected_uses_by_enumeration():
    pieces = sorted({langid.START, langid.START + "a", "a", "b", "ab", "ba"})
    probs = np.random.default_rng(3).dirichlet(np.ones(len(pieces)), 2).T

    def ways(s):
        return [[s[:n], *rest] for n in range(1, len(s) + 1) if s[:n] in pieces for rest in ways(s[n:])] if s else [[]]

    runs, langs, weight = ["ab", "abba", "a", "babab"], np.array([0, 1, 0, 1]), np.array([1.0, 2.0, 3.0, 1.0])
    want = np.zeros((2, len(pieces) + 1))
    for r, lang, w in zip(runs, langs, weight):
        found = ways(langid.START + r)
        chance = np.array([np.prod([probs[pieces.index(x), lang] for x in way]) for way in found])
        for way, c in zip(found, chance / chance.sum()):
            for x in way:
                want[lang, pieces.index(x)] += w * c
    got = langid.expected_uses(langid.Model(pieces, ["x", "y"], probs), langid.Lattice(pieces), runs, langs, weight)
    assert np.allclose(got, want)


def test_every_labelled_language_is_learned(spark):
    rng = np.random.default_rng(0)
    letters = [*"abcdefghijklmnopqrstuvwxyz"]
    words = [["".join(rng.choice(letters, 7)) for _ in range(6)] for _ in range(101)]
    rows = [(i, " ".join(rng.choice(words[i % 101], 30)), f"l{i % 101:03}") for i in range(505)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(df, VOCABULARY, F.col("doc_id") < 404)
    assert len(model.langs) == 101
    got = langid.predict(df.where("doc_id >= 404"), model)
    assert got.where("lang = lang_pred").count() >= 100


def test_three_given_grades(spark):
    rng = np.random.default_rng(1)
    mild, harsh, clean = ([f"{k}{i}" for i in range(5)] for k in ("mildword", "harshterm", "plainly"))
    grade = lambda i: i % 3
    texts = [" ".join([*rng.choice(clean, 20), *rng.choice(mild if grade(i) == 1 else harsh, 3 if grade(i) else 0)]) for i in range(900)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, grade(i)) for i in range(0, 600)], "doc_id bigint, severity int"), grade_col="severity")
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.predict(df, model).collect()}
    assert np.mean([got[i].severity_grade == grade(i) for i in range(600, 900)]) > 0.95
    assert all(got[i].expected_severity < got[j].expected_severity for i, j in zip(range(600, 900, 3), range(601, 900, 3)))


def test_quality_score_by_counting(spark):
    """Ratios, scores and verdicts from n-gram counts taken one by one."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"w{k}" for k in range(30 if i % 4 else 60)], 25)) for i in range(60)] + ["", None]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    trusted, size = [i for i in range(60) if i % 4][:30], 1 << 10
    model = quality.fit(df, spark.createDataFrame([(i,) for i in trusted], "doc_id bigint"), buckets=size)

    def grams(text):
        one = [zlib.crc32(w.encode()) for w in (text or "").lower().split()]
        two = [((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64) >> 40 for a, b in zip(one, one[1:])]
        return [x % size for x in one + two]

    counts = [Counter(g for i in ids for g in grams(texts[i])) for ids in (trusted, range(len(texts)))]
    log_p = lambda c, g: np.log((c[g] + 1) / (sum(c.values()) + size))
    got = {r.doc_id: r for r in quality.judge(df, model).collect()}
    for i, t in enumerate(texts):
        g = grams(t)
        want = np.mean([log_p(counts[0], x) - log_p(counts[1], x) for x in g]) if g else 0.0
        assert np.isclose(got[i].score, want) and got[i].kept == (not got[i].base_failed and got[i].score >= model.threshold)
    assert {i for i in got if got[i].kept} >= {i for i in range(60) if i % 4}


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_toxic_rows_that_were_not_learned_from(larger):
    docs, labels = larger
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = toxicity.fit(docs, labels.where(half))
    seen = toxicity.predict(docs.join(labels.where(~half), "doc_id"), model).groupBy("toxic").agg(F.avg(F.col("toxic_flag").cast("int")).alias("flagged")).collect()
    share = {r.toxic: r.flagged for r in seen}
    print(share)
    assert share[1] >= 0.85 and share[0] <= 0.01


def test_junk_and_trusted_rows_that_were_not_learned_from(larger):
    docs, labels = larger
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = quality.fit(docs, labels.where("quality = 1").where(half))
    judged = quality.judge(docs.join(labels.where(~half), "doc_id"), model).where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r.quality: r.kept for r in judged}
    print(share)
    assert share[1] >= 0.98 and share[0] <= 0.1


def test_shard_weights_and_odd_ids(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (2,), (2,)], "doc_id bigint")
    got = sharding.assign_shards(df).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 2}) == 1
    assert sharding.assign_shards(df.limit(0)).count() == 0
    many = spark.range(300).withColumnRenamed("id", "doc_id").withColumn("Shard", F.lit("own"))
    out = sharding.assign_shards(many, shards=[1.0, 0.0, 2.0])
    assert out.columns == ["doc_id", "Shard"] and {r.Shard for r in out.collect()} == {0, 2}
    for bad in ([], 0, [0.0], [1.0, -1.0], [float("nan")], [float("inf"), 1.0]):
        with pytest.raises(ValueError):
            sharding.assign_shards(df, shards=bad)


def test_parts_of_a_conversation_by_turns(spark):
    turns = spark.range(30_000).select((F.col("id") % 7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x#é").alias("text"))
    whole = sorted(chat.read_back(chat.format_conversations(turns)).collect())
    parted = chat.format_conversations(turns, part_turns=500)
    assert parted.groupBy("conv_id").count().where("count > 3").count() == 7
    assert sorted(chat.read_back(parted).collect()) == whole
    mixed = spark.createDataFrame(sorted(parted.collect(), key=lambda r: (-r.part, r.conv_id)), parted.schema).coalesce(1)
    assert sorted(chat.read_back(mixed, ordered=False).collect()) == whole
    with pytest.raises(Exception, match="does not follow"):
        chat.read_back(mixed).collect()


@pytest.mark.parametrize("kind", ["path", "star", "tree", "pairs", "none"])
def test_components_of_shapes(spark, kind):
    from loadscape.llm.components import connected_components

    rng = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 40)] + [(100, i) for i in range(101, 120)],
        "tree": [(rng.randrange(i), i) for i in range(1, 80)], "pairs": [(2 * i, 2 * i + 1) for i in range(20)] + [(3, 3), (None, 5)], "none": [(7, 7)],
    }[kind]
    ids = [*range(130)]
    rng.shuffle(ids)
    named_ = [(a if a is None else ids[a], ids[b]) for a, b in edges]
    parent = {x: x for e in named_ for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in named_:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(named_, "a int, b int"), "a", "b", Scratch(spark, "shapes")).collect()}
    assert got == {x: find(x) for x in parent if x is not None and find(x) != x}
