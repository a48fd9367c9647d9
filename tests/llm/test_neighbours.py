import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nichespark.llm import embeddings, simhash
from nichespark.llm.common import connected_components


def smallest(n, pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == smallest(0, [p for p in pairs if p[0] != p[1]], ids)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint(spark):
    rng = random.Random(5)
    for _ in range(60):
        t = " ".join(rng.choice(["A", "b", "É", "漢", "Zz,", "q\x1cr"]) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t)
    one = spark.createDataFrame([("abc déf ghi",)], "t string").select(F.xxhash64("t")).first()[0]
    assert simhash.fingerprint("abc déf ghi".encode()) == one % 2**64


@pytest.mark.parametrize("group", [4096, 3])
def test_links_match_brute_force(spark, group):
    rng = random.Random(7)
    fps = {0}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            fps.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randint(0, 63)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    links = simhash.similar_links(spark.createDataFrame(signed, "fp long, node long"), group=group).collect()
    brute = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    ids = range(len(fps))
    assert smallest(0, [(r.a, r.b) for r in links], ids) == smallest(0, brute, ids)


def test_documents(spark):
    base = [" ".join(random.Random(k).choices("alpha beta gamma delta eps".split(), k=200)) for k in range(3)]
    rows = [(10, base[0]), (11, base[0].upper()), (12, base[0] + " end"), (20, base[1]), (21, base[1]), (30, None), (31, ""), (32, " \n"), (None, base[2]), (40, "x " * 40_000), (40, "y"), (41, "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component int")
    out = simhash.report(df).collect()
    assert len(out) == len(rows)
    fp = {r: plain_fingerprint(t) for r, (_, t) in enumerate(rows)}
    real = [i for i, r in enumerate(rows) if r[0] is not None]
    pairs = [(rows[i][0], rows[j][0]) for i in real for j in real if i < j and ((fp[i] ^ fp[j]).bit_count() <= 3 or rows[i][0] == rows[j][0])]
    want = smallest(0, [p for p in pairs if p[0] != p[1]], {rows[i][0] for i in real})
    for r in out:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    assert sorted((r.doc_id or -1, r.fingerprint) for r in out) == sorted((rows[i][0] or -1, f"{fp[i]:016x}") for i in fp)
    kept = {r.doc_id for r in simhash.keep_first(df).collect()}
    assert kept == {None} | {i for i, c in want.items() if i == c}
    assert simhash.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [2048, 7])
def test_embeddings_match_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(25):
        c = rng.standard_normal(16)
        rows += [(len(rows) + i, (c + rng.standard_normal(16) * 0.08 * (k % 4)).tolist()) for i in range(8)]
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[1][1]]), (902, [0.0] * 16), (903, None), (904, [1.0, None]), (905, [float("nan")] * 16), (906, [float("inf")] + [0.0] * 15), (907, []), (908, [1.0, 0.0]), (909, [3.0, -0.0]), (0, rows[0][1]), (None, rows[0][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n_links int")
    good = [(i, r[0], np.array(r[1], float)) for i, r in enumerate(rows) if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    links, pairs = {i: 0 for i in range(len(rows))}, []
    for i, a, x in good:
        for j, b, y in good:
            if i != j and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[i] += 1
                pairs.append((a, b))
    want = smallest(0, [p for p in pairs if p[0] != p[1]], {r[0] for r in rows if r[0] is not None})
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, tile=tile, recall=0.999999).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, links[i], want.get(r[0]), r[0] is not None and want[r[0]] == r[0]) for i, r in enumerate(rows))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_planted_pairs(spark):
    """Pairs between 0.95 and 0.97, found through the query's own path and settings."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((600, 48))
    y -= (x[:600] * y).sum(1, keepdims=True) * x[:600]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.9505, 0.97, (600, 1))
    both = np.concatenate([x, c * x[:600] + np.sqrt(1 - c * c) * y])
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")).collect()}
    found = sum(got[3000 + i].component_id == i and got[i].n_links == 1 for i in range(600))
    assert found >= 0.99 * 600
    assert sum(r.n_links for r in got.values()) == 2 * found


def test_components_with_hot_nodes(spark):
    rng = random.Random(2)
    pairs = [(0, i) for i in range(1, 300)] + [(500 + i % 3, 600 + i) for i in range(200)] + [(rng.randint(0, 900), rng.randint(0, 900)) for _ in range(100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), hot_rows=20).collect()}
    own = [p for p in pairs if p[0] != p[1]]
    assert got == smallest(0, own, {x for p in own for x in p})


def test_recall_at_the_threshold():
    rng = np.random.default_rng(0)
    for rows in (1000, 1_000_000, 10**9):
        bits, tables = embeddings.shape(rows)
        x = rng.standard_normal((400, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((400, 64))
        y -= (x * y).sum(1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        z = 0.95 * x + np.sqrt(1 - 0.95**2) * y
        p = rng.standard_normal((64, bits * tables))
        same = (((x @ p) >= 0) == ((z @ p) >= 0)).reshape(400, tables, bits).all(axis=2).any(axis=1)
        assert same.mean() > 0.97
