"""The registered queries on the driver's smallest tables, against brute force or SQL."""

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest

from nichespark.llm import lm, packing, queries
from tests.llm.test_lm_decontam import brute as lm_brute
from tests.llm.test_neighbours import plain_fingerprint, smallest
from tests.llm.test_substring import brute as cut_brute

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name):
    return queries.queries()[name](spark, str(DATA)).collect()


def test_op1(spark, docs):
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op1_substring"))
    assert got == [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in cut_brute(docs, 20)]


def test_op2(spark, docs):
    enc = packing.encoder(packing.default_tokenizer())
    got, bins = {}, {}
    for r in rows(spark, "op2_pack"):
        got.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in docs:
        ids = enc.ids(t or "") + b"\x02\0\0\0"
        own = sorted(got[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and own[0].start == 0
        assert sum(r.length for r in own) * 4 == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in own)
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()] and sum(n for _, n in parts) <= 1024
    assert len(bins) <= 1.01 * sum(n for p in bins.values() for _, n in p) / 1024 + 1


@pytest.mark.parametrize("name", ["op3_shard", "op10_urlrules"])
def test_sql_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.queries()[name](spark, str(DATA))
    cols = ", ".join(df.columns)
    want = con.execute(f"SELECT {cols} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_op4(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in rows(spark, "op4_decontam")}
    assert {(d, i) for d, t in docs for i, x in items if x and t and x in t} <= got
    for d, i in got:  # five words in a row of every leaked item are in its document
        w = dict(items)[i].lower().split()
        assert " ".join(w[2:7]).strip(".,;:!?") in " ".join(dict(docs)[d].lower().split())


def test_op5(spark, docs):
    fp = {i: plain_fingerprint(t) for i, t in docs}
    want = smallest(0, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op5_simhash")} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_op6(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in v], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [r.vec_id for r in v]
    want = smallest(0, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)], ids)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows(spark, "op6_embeddings")}
    assert got == {i: (int(n), want[i], want[i] == i) for i, n in zip(ids, near.sum(axis=1), strict=True)}


@pytest.mark.parametrize(("name", "modulus", "rest", "threshold"), [("op7_toxicity", 3, 1, 0.7), ("op9_quality", 5, 0, 0.3)])
def test_scores(spark, docs, name, modulus, rest, threshold):
    got = rows(spark, name)
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)


def test_op8(spark, docs):
    got = {r.doc_id: (r.n_tokens, r.log_sum) for r in rows(spark, "op8_lm")}
    for i, n, s in lm_brute(docs, lm.ORDER, lm.ALPHA, lm.MIN_COUNT):
        assert got[i][0] == n and abs(got[i][1] - s) < 1e-4 * (1 + abs(s))
