import itertools
import random
import zlib

import numpy as np
import pytest

from nichespark.llm import common, quality, toxicity
from nichespark.llm.labelled import sample

BAD = ["idiot", "moron", "pathetic", "scum", "worthless"]
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 120))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        for _ in range(rng.randint(2, 5) * toxic):
            w.insert(rng.randint(0, len(w)), rng.choice(BAD))
        if not good:
            w = rng.choice([lambda: [x.upper() + "!!" for x in w], lambda: [x for x in w for _ in range(6)], lambda: [y for x in w for y in (x, "|")]])()
        rows.append((i, " ".join(w)))
        labels.append((i, good, toxic))
    return rows, labels


EXTRA = [(None, "no id"), (9001, None), (9002, ""), (9003, "x " * 100_000), (1, "again"), (1, "again"), (9004, "1d10t m0r0n and you w o r t h l e s s $cum"), (9005, "p@th3t1c iiidiot m.o.r.o.n")]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + EXTRA], "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame([*labels, (9002, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, lab, dict((i, (q, t)) for i, q, t in labels)


def check(rows, truth, k, modulus, rest, threshold, least):
    assert len(rows) == 600 + len(EXTRA)
    hits = []
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        if r.held_out and r.doc_id in truth:
            hits.append(truth[r.doc_id][k] == r.predicted)
    assert np.mean(hits) > least


def test_very_long_tokens_take_linear_time():
    n = 1_000_000
    model = toxicity.Model(np.zeros((toxicity.CLASSES,) * 3), 50, 50, {"moron": (50, 0), "^mor": (50, 0), "ab": (50, 0)}, np.ones(5))
    for text in ("a" + "-" * n + "b", "-" * n + "a1" + "!" * n, "a1" + "!" * n + "_" * n, "a" * n, "a1" * 1000 + "_" * n + "b", "m0r0n " + "1" * n + "_"):
        restored = toxicity.Restorer(model.characters)(text)
        assert 0 <= toxicity.Scorer(model)(restored) <= 1
    assert [common.bare(x) for x in ("_a-b_", "--", "", "É1!", "a\n")] == ["a-b", "", "", "é1", "a"]
    s = toxicity.Scorer(model)
    assert [s.evidence(x) > 0 for x in ("Moron!", "mor", "more", "ab", "abc", "xmor")] == [True, False, True, True, False, False]


def test_toxicity(spark, tables):
    docs, labels, truth = tables
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, keep_restored=True).collect()
    check(rows, truth, 1, 3, 1, 0.7, 0.97)
    for r in rows:
        if r.doc_id in (9004, 9005):
            assert r.predicted == 1, r.restored
        if r.doc_id in (9001, 9002, 9003) or r.doc_id is None:
            assert r.predicted == 0
    assert toxicity.score(docs.limit(0), model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, blank).collect()} == {0.0}
    empty = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs, empty).count() == 600 + len(EXTRA)


def test_viterbi_matches_brute_force():
    rng = random.Random(3)
    model = -np.log(np.random.default_rng(1).dirichlet(np.ones(28), (28, 28)))

    def cost(parts):
        a = b = 0
        total = sum(c for _, c in parts)
        for c in "".join(s for s, _ in parts):
            k = toxicity.char_class(c)
            total += model[a, b, k]
            a, b = b, k
        return total + model[a, b, 0]

    for _ in range(80):
        spaced = rng.random() < 0.4
        span = "".join(rng.choice("ab1!0 zzz" if spaced else "ab1!0$zzz") for _ in range(rng.randint(1, 8))).strip()
        lattice = toxicity.readings(span, spaced)
        best = min(itertools.product(*lattice), key=cost)
        got = toxicity.decode(span, model, spaced)
        fits = [p for p in itertools.product(*lattice) if "".join(s for s, _ in p) == got]
        assert abs(min(map(cost, fits)) - cost(best)) < 1e-9


def test_plain_text_is_untouched():
    r = toxicity.Restorer(np.zeros((28, 28, 28)))
    for t in ["", "plain text, with 12 numbers: 555-3138", "HEING,!! THE!!", "a--b", "é à"]:
        assert r(t) == t


def test_quality(spark, tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    check(quality.score(docs, model).collect(), truth, 0, 5, 0, 0.3, 0.97)
    assert quality.score(docs.limit(0), model).count() == 0
    blank = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, blank).collect()} == {0.5}


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.flatnonzero(rng.random(12) < 0.4).astype(np.int32) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    values, cost = rng.standard_normal(12), np.full(60, 0.7)
    w, b = quality.dual_coordinate_descent(rows, values, y, cost, passes=3000)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = values[r] / max(1, np.sqrt(len(r)))
        x[i, 12] = 1
    f = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    v = np.append(w, b)
    assert all(f(v) <= f(v + rng.standard_normal(13) * s) + 1e-3 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_sample_is_bounded(spark, tables):
    docs, labels, _ = tables
    assert sample(docs, labels, "toxic", 3, 1, limit=50).count() <= 55
