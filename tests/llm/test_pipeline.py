"""Each stage of the pipeline against a brute-force version of it, on the rows that the stage before kept."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from loadscape.llm import langid
from loadscape.llm.queries import VOCABULARY, held_out
from test_simhash import groups, plain_fingerprint
from test_text_operators import brute_leaks

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the result of each stage, written and read again as the pipeline does."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [d.toPandas() for d in out]


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert all(list(d.columns) == COLUMNS for d in stages[:-1]) and list(stages[-1].columns) == [*COLUMNS, "shard"]


def test_language_id(spark, stages):
    before, after = stages[0], stages[1]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scorer = langid.fit(docs, VOCABULARY, ~held_out(F.col("doc_id"))).scorer()
    langs, _, evidence = scorer.judged(before.text.tolist())
    want = {i for i, lang, e in zip(before.doc_id, langs, evidence) if lang != "und" and e > -corpus_pipeline.REJECT}
    assert set(after.doc_id) == want == set(before.doc_id)


def test_language_id_rejects_and_fills_in(spark):
    """Other languages, other scripts and letter salad go, though given as English (not learned from: ids held out)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = {r.lang: r for r in docs.where("length(text) between 300 and 3000").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).collect()}
    salad = "".join(np.random.default_rng(2).choice([*"abcdefghijklmnopqrstuvwxyz     "], 300))
    foreign = [
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan",
        "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью и должны поступать в отношении друг друга",
        "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待", salad, "12 345 !?", "", None,
    ]
    unseen = (i for i in range(-1, -99, -1) if zlib.crc32(str(i).encode()) % 3 == 1)
    extra = [(i, t, "en", "new", 0) for i, t in zip(unseen, foreign)] + [(-100 - k, r.text, None, "new", 0) for k, r in enumerate(own.values())]
    more = docs.select(*COLUMNS).union(spark.createDataFrame(extra, docs.select(*COLUMNS).schema))
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, more, DATA).where("source = 'new'").collect()}
    assert got == {-100 - k: lang for k, lang in enumerate(own)}


def test_near_dedup(stages):
    before, after = stages[1].sort_values("doc_id"), stages[2]
    ids = before.doc_id.tolist()
    assert sorted(after.doc_id) == sorted({ids[g] for g in groups([plain_fingerprint(t) for t in before.text])})


def test_decontamination(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = stages[2], stages[3]
    leaky = {i for i, _ in brute_leaks(dict(zip(before.doc_id, before.text)), items)}
    assert leaky and set(after.doc_id) == set(before.doc_id) - leaky


def test_mixing(stages):
    before, after = stages[3], stages[4]
    sizes = before.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    by = sizes.groupby(before.source).sum().sort_index()
    weight = dict(zip(by.index, [(5, 2, 1)[k % 3] for k in range(len(by))]))
    full: set = set()
    while True:
        level = (by.sum() - 3 * sum(by[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in by.index if s in full or weight[s] * level > 3 * by[s]}
        if more == full:
            break
        full = more
    want = Counter()
    for i, s in zip(before.doc_id, before.source):
        rate = 3.0 if s in full else weight[s] * level / by[s]
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) / 2**48
        want[i] = int(rate) + (u < rate - int(rate))
    assert Counter(after.doc_id) == +want


def test_sharding(stages):
    after = stages[5]
    assert len(after) == len(stages[4])
    best = lambda key: max(range(16), key=lambda i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16), -i))
    assert (after.shard == after.doc_id.map(best)).all()


def test_run_and_extra_columns(spark, stages):
    assert sorted(corpus_pipeline.run(spark, DATA).toPandas().doc_id) == sorted(stages[5].doc_id)
    docs = spark.createDataFrame([(1, "The cat and the dog, of course.", "en", "a", 1, 7), (2, None, "en", None, 1, 7), (2, "", None, "b", 1, 7)], "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns or sorted(got.columns) == sorted(docs.columns)
        got.collect()
        stage(spark, docs.limit(0), DATA).collect()
