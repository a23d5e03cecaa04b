"""Toxicity recomputed word by word: which features tell, what each text holds of them, its grade, its severity."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import DATA
from loadscape.llm import toxicity


def _bucket(x):
    return zlib.crc32(x.encode()) % toxicity.BUCKETS


def _features(word):
    """Buckets of <word>, of its first four marked letters and of every five marked letters in a row."""
    w = re.sub(r"^[\W_]+|[\W_]+$", "", word.lower())
    if not w:
        return set()
    marked = f"<{w}>"
    return {_bucket(x) for x in [marked, marked[:4], *(marked[i : i + 5] for i in range(len(marked) - 4))]}


def _words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def case(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.predict(docs, model).select("doc_id", "expected_severity", "severity_grade", "toxic_flag").collect()}
    return texts, {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}, model, got


def test_features_that_tell(case):
    texts, labels, model, _ = case
    grade = defaultdict(int)
    for i, toxic in labels.items():
        if i in texts:
            grade[texts[i]] = max(grade[texts[i]], toxic)
    clean, toxic = Counter(), Counter()
    for text, g in grade.items():
        (toxic if g else clean).update({b for w in _words(text) for b in _features(w)})
    share = sum(g > 0 for g in grade.values()) / len(grade)
    told = []
    for b, t in toxic.items():
        c = clean[b]
        g2 = 2 * (t * math.log(t / ((t + c) * share)) + (c * math.log(c / ((t + c) * (1 - share))) if c else 0))
        assert abs(g2 - toxicity.MIN_G2) > 1e-9
        if g2 >= toxicity.MIN_G2 and t >= toxicity.MIN_SHARE * (t + c):
            told.append(b)
    assert told and sorted(told) == model.buckets


def test_severities(case):
    texts, _, model, got = case
    assert got.keys() == texts.keys() and list(model.thresholds) == sorted(model.thresholds)
    weight = dict(zip(model.buckets, model.weights))
    for i, text in texts.items():
        counts = Counter(b for w in _words(text) for b in _features(w) if b in weight)
        score = sum(weight[b] * math.log(1 + n) for b, n in counts.items())
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        chance = -np.diff([1.0, *above, 0.0])
        assert abs(got[i].expected_severity - sum(above)) < 1e-9
        assert got[i].severity_grade == int(chance.argmax()) and got[i].toxic_flag == (sum(above) >= toxicity.FLAG_AT)


def test_weights_are_the_most_likely(case):
    """Grades by counted toxic words; no small move of a weight or threshold makes the grades likelier."""
    texts, labels, model, _ = case
    held, place = {}, {b: k for k, b in enumerate(model.buckets)}
    for i, toxic in labels.items():
        if i not in texts:
            continue
        found = [{place[b] for b in _features(w) if b in place} for w in _words(texts[i])]
        n = Counter(k for f in found for k in f)
        old = held.get(texts[i], (0, None))[0]
        held[texts[i]] = (max(old, toxic), n, sum(map(bool, found)))
    y = np.array([g * (1 + (hits >= toxicity.GRADE_AT)) for g, _, hits in held.values()])
    assert set(y) == {0, 1, 2}
    x = np.zeros((len(y), len(place)))
    for row, (_, n, _) in enumerate(held.values()):
        for k, v in n.items():
            x[row, k] = math.log1p(v)

    def loss(w, cuts):
        upto = 1 / (1 + np.exp(-(np.concatenate(([-np.inf], cuts, [np.inf]))[None, :] - (x @ w)[:, None])))
        p = upto[np.arange(len(y)), y + 1] - upto[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean() + toxicity.L2 / 2 * (w @ w)

    best = loss(model.weights, model.thresholds)
    rng = np.random.default_rng(2)
    for _ in range(200):
        w = model.weights + 0.05 * rng.normal(size=len(place))
        cuts = model.thresholds + 0.05 * rng.normal(size=2)
        assert cuts[0] >= cuts[1] or loss(w, cuts) > best - 1e-4
    assert best < 0.5 * loss(np.zeros(len(place)), model.thresholds)
