import random

import pytest

from nichespark.llm.substring import Passages, dedup_substrings, runs


def brute(rows, window):
    out, seen = [], set()
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ws = (t or "").encode().split()
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        out.append((-1 if i is None else i, len(ws), sum(gone), b" ".join(x for x, g in zip(ws, gone, strict=True) if not g).decode()))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    voc = ["a", "b", "c", "dé", "e,", "f.", "漢", "gg", "hh\x1ci j"]
    pool = [[rng.choice(voc) for _ in range(rng.randint(5, 60))] for _ in range(30)]
    rows = []
    for i in range(300):
        ws = []
        for _ in range(rng.randint(0, 4)):
            ws += rng.choice(pool) if rng.random() < 0.5 else [rng.choice(voc) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 40))]
        rows.append((i * 3 % 401, rng.choice(["", "  "]) + rng.choice([" ", "\n", "  \t"]).join(ws)))
    long = " ".join(str(i % 997) for i in range(30_000))
    return [*rows, (500, None), (501, ""), (502, " ".join(["x"] * 200)), (503, " ".join(["x"] * 150)), rows[0], (2, rows[5][1]), (None, rows[7][1]), (600, long), (601, long)]


@pytest.mark.parametrize(("window", "phrase", "shard_bytes"), [(20, 8, None), (20, 8, 20_000), (6, 3, 5_000)])
def test_matches_brute_force(spark, window, phrase, shard_bytes):
    rows = corpus()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, source string, kept_text int")
    out = dedup_substrings(df, window=window, phrase=phrase, shard_bytes=shard_bytes).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out)
    assert got == brute(rows, window)
    for r in out:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed and r.source == "z"


def test_occurrences_come_from_the_hits():
    rng = random.Random(8)
    voc = [b"w%d" % i for i in range(6)]
    passages = [[rng.choice(voc) for _ in range(rng.randint(6, 30))] for _ in range(20)]
    p = Passages(passages, 6, 3)
    known = {tuple(x[i : i + 6]) for x in passages for i in range(len(x) - 5)}
    found = 0
    for _ in range(40):
        text = [rng.choice(voc) for _ in range(50)]
        text[20:20] = rng.choice(passages)[1:]
        ids = p.numbers(text)
        want = [i for i in range(len(text) - 5) if tuple(text[i : i + 6]) in known]
        at, key = p.hits(ids)
        assert p.windows(ids, at, key).tolist() == want and p.windows(ids, at, key, block=2).tolist() == want
        assert p.windows(ids, at[:0], key[:0]).tolist() == []  # no hits, no occurrences
        found += len(want)
    assert found > 200


def test_runs():
    import numpy as np

    assert runs(np.array([1, 0, 1, 1]), np.array([5, 7, 4, 9]), 3) == [(0, 7, 10), (1, 4, 8), (1, 9, 12)]
    assert runs(np.zeros(0, np.int32), np.zeros(0, np.int32), 3) == []


def test_empty_table(spark):
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
