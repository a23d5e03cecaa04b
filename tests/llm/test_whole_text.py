"""Text operators do the whole job: no switch by size, no cut of long words, long vocabularies or second links."""

import numpy as np

from loadscape.llm import quality, toxicity


def test_quality_threshold_follows_one_rule_on_few_trusted_rows(spark):
    """The threshold is the low percentile of trusted rows, each scored by a model that does not trust it."""
    rng = np.random.default_rng(5)
    good, junk = ([f"{c}{i}" for i in range(40)] for c in "gj")
    texts = [" ".join(rng.choice(junk if i % 3 == 0 else good, 30)) for i in range(36)] + [""]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    trusted = [i for i in range(37) if i % 3][:20]
    fit = lambda ids: quality.fit(df, spark.createDataFrame([(i,) for i in ids], "doc_id bigint"), buckets=1 << 10)
    model, grams = fit(trusted), quality.Grams(1 << 10)
    alone = [fit([k for k in trusted if k != i]).scores(grams, [texts[i].encode()])[0] for i in trusted]
    assert np.isclose(model.threshold, np.quantile(alone, quality.UNSEEN_SHARE) - quality.MARGIN)
    kept = {r.doc_id for r in quality.judge(df, model).where("kept").collect()}
    assert kept == {i for i in range(36) if i % 3}
    assert quality.fit(df, df.select("doc_id").limit(0)).threshold == -np.inf


def test_toxicity_reads_unspaced_texts_to_their_end(spark):
    rng = np.random.default_rng(6)
    letters = [chr(0x4E00 + i) for i in range(400)]
    texts = ["".join(rng.choice(letters, 150)) + "\u9fa0\u9fa1\u9fa2\u9fa3\u9fa4" * (i % 4 == 0) + "".join(rng.choice(letters, 60)) for i in range(200)]
    texts += ["\u4e01" * 3_000_000 + "\u9fa0\u9fa1\u9fa2\u9fa3\u9fa4"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200) if i % 8 < 5], "doc_id bigint, toxic int"))
    got = {r.doc_id for r in toxicity.predict(df, model).where("toxic_flag").collect()}
    assert got >= {i for i in range(200) if i % 4 == 0} and not any(i % 4 for i in got if i < 200)
    w = "ab\u0301c" * 70
    runs = [b for block in toxicity.blocks_of(w.encode()) for b in block]
    marked = f"<{w}>"
    assert {*runs} == {toxicity.zlib.crc32(x.encode()) % toxicity.BUCKETS for x in (marked, marked[:4], *(marked[i : i + 5] for i in range(len(marked) - 4)))}
    assert [*toxicity.blocks_of(b"!!")] == [] and len([*toxicity.blocks_of(b"a")]) == 1


def test_toxicity_learns_every_toxic_word(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], 8))
    clean, toxic = [word() for _ in range(300)], [word() for _ in range(400)]
    texts = [" ".join([*rng.choice(clean, 20), *(toxic[(i // 4 * 5 + k) % 400] for k in range(5 * (i % 4 == 0)))]) for i in range(4000)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    model = toxicity.fit(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(4000)], "doc_id bigint, toxic int"))
    assert len(model.buckets) > 1024
    place = {*model.buckets}
    used = {w for i in range(0, 4000, 4) for w in texts[i].split()[20:]}
    assert all(place & {*toxicity.buckets_of(w.encode())} for w in used)
    new = sorted(used)
    df = spark.createDataFrame([(" ".join(new[i::80]),) for i in range(80)], "text string")
    assert toxicity.predict(df, model).where("toxic_flag").count() == 80
