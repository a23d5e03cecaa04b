"""Fingerprints, links and groups against brute force; odd rows; components."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import DATA
from loadscape.llm import simhash
from loadscape.llm.components import connected_components
from loadscape.llm.scratch import Scratch


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints):
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(prints))]


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == [ids[g] for g in groups(prints)]
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).select("doc_id").collect())
    assert kept == sorted({ids[g] for g in groups(prints)})


@pytest.mark.parametrize("cap", [2, 8, 8192])
def test_dense_groups_of_prints(spark, cap):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(120)}
    prints = [*prints, *(int(x) for x in rng.integers(1 << 62, size=40))]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    scratch = Scratch(spark, "test")
    comp = connected_components(simhash.links(df, scratch, cap), "u", "v", scratch)
    found = {r.node % (1 << 64): r.component % (1 << 64) for r in comp.collect()}
    got, want = [found.get(p, p) for p in prints], groups(prints)
    assert len({*zip(got, want)}) == len({*got}) == len({*want})


def test_odd_rows(spark):
    long_ = "ab " * 700_000
    data = [(5, None), (3, ""), (4, " \n"), (9, "One two"), (8, "one TWO"), (None, "one two"), (7, long_), (7, long_), (2, "É x"), (1, "a")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").withColumn("fingerprint", F.lit("own")).withColumn("id", F.lit(0))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == "0" * 16 and by[5].component_id == 3 == by[4].component_id
    assert by[9].component_id == 8 == by[None].component_id and by[7].component_id == 7
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in got})
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, None), (7, 7), (1, 0)]
    comp = connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b", Scratch(spark, "test"))
    found = {r.node: r.component for r in comp.collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and all(found[i] == 100 for i in range(101, 160))
