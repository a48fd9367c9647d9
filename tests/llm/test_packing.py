import random
import zlib

import numpy as np
import pytest

from nichespark.llm import packing

TEXTS = [None, "", " ", "  ", "a", "a  b", "a \n b", "tail ", "tail\n", "\u00a0x\u2003y", "don't we'll", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>  b ", "<|endoftext", "é ü ß 漢字 😀", "x\n\n  y\tz", "1234 5.6 $%^", "word " * 3000, "a" * 5000]
LONG = TEXTS.index("word " * 3000)


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.encoder(packing.default_tokenizer())
    rng = random.Random(1)
    more = ["".join(rng.choice(" \n\t'aé1.s😀") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text in [*filter(None, TEXTS), *more]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_slices_and_long_runs_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    enc = packing.encoder(packing.default_tokenizer())
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice([" ", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "'s", "a", "é", "1", ".", "😀", "word", "   ", " \n "]) for _ in range(rng.randint(1, 40)))
        want = t.encode(text, add_special_tokens=False).ids
        for size in (1, 2, 3, 7):
            assert np.frombuffer(enc.ids(text, size), "<u4").tolist() == want, (size, repr(text))
    n = 1_100_000
    for text in (" " * n, "a" + " " * n + "b", "\n \t" * (n // 3) + "x", "x y " * (n // 4) + "\u3000" * n + "z", "a" * n, "a \n" * (n // 3)):
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text[:20])


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_respects_every_capacity(rule):
    rng = random.Random(2)
    counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 65), 30)}
    runs = packing.plan(counts, 64, 5, 2000, (1.0, 0.2, 0.3), rule) if max(counts) ** 2 <= 2000 else None
    if runs is None:
        counts = {n: c for n, c in counts.items() if n * n <= 2000}
        runs = packing.plan(counts, 64, 5, 2000, (1.0, 0.2, 0.3), rule)
    bins, seen = {}, {n: set() for n in counts}
    for n, rank, count, seq, off in runs.tolist():
        for k in range(count):
            bins.setdefault(seq + k, []).append((off, n))
            assert rank + k not in seen[n]
            seen[n].add(rank + k)
    assert {n: len(s) for n, s in seen.items()} == counts
    for parts in bins.values():
        parts.sort()
        at = 0
        for off, n in parts:
            assert off == at
            at += n
        assert at <= 64 and len(parts) <= 5 and sum(n * n for _, n in parts) <= 2000


def test_pack_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "  "), (None, "no id"), (4, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(docs).collect()
    enc = packing.encoder(packing.default_tokenizer())
    want = sorted(enc.ids(t or "") + b"\x02\0\0\0" for _, t in rows)
    by = {}
    for r in out:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32 and r.length <= 1024
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert b"".join(sorted(bytes(r.ids) for r in out if r.doc_id is None)) == enc.ids("no id") + b"\x02\0\0\0"
    long = [r for r in out if r.doc_id == LONG]
    assert b"".join(bytes(r.ids) for r in sorted(long, key=lambda r: r.piece)) == enc.ids(TEXTS[LONG]) + b"\x02\0\0\0"
    assert [r.start for r in sorted(long, key=lambda r: r.piece)] == [0, *np.cumsum([r.length for r in sorted(long, key=lambda r: r.piece)])[:-1].tolist()]
    assert all(r.length == 1024 for r in long if r.piece > 0)
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
    assert sum(len(w) for w in want) == sum(4 * r.length for r in out)
    total = sum(r.length for r in out)
    assert len(by) == -(-total // 1024)
    seqs = packing.sequences(spark.createDataFrame(out)).collect()
    assert sum(len(s.ids) for s in seqs) == 4 * total


def test_a_plan_as_a_table_gives_the_same_places(spark):
    rng = random.Random(4)
    pieces = spark.createDataFrame([(i // 2, i % 2, rng.randint(1, 64)) for i in range(3000)], "doc_id long, piece int, length int")
    how = dict(max_tokens=64, max_docs=64, max_cost=64 * 64)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(packing.place(pieces, **how)) == key(packing.place(pieces, max_runs=0, **how))


def test_weights_of_documents_and_cost_take_no_further_sequence():
    rng = np.random.default_rng(3)
    for make in (lambda: rng.integers(1, 1025, 5000), lambda: np.minimum(1024, rng.geometric(0.004, 5000)), lambda: rng.choice([300, 340, 372, 512, 700], 5000)):
        n, c = np.unique(make(), return_counts=True)
        counts = dict(zip(n.tolist(), c.tolist(), strict=True))
        bins = lambda w: max(r[3] + r[2] for r in packing.plan(counts, weights=w).tolist())
        assert bins(packing.WEIGHTS) <= bins((1.0, 0.0, 0.0))


def test_weights_decide_between_bins():
    counts = {40: 1, 30: 1, 29: 1, 10: 1}  # after 40 + 30 and 29: 10 fits a bin of two pieces and one of a single piece
    roomy = packing.plan(counts, 80, 80, 6400, (0.01, 1.0, 0.0)).tolist()
    tight = packing.plan(counts, 80, 80, 6400, (1.0, 0.0, 0.0)).tolist()
    where = lambda runs: {r[0]: r[3] for r in runs}
    assert where(tight)[10] == where(tight)[40] and where(roomy) != {} and packing.plan(counts, 80, 2, 6400, (1.0, 0.05, 0.05)).tolist() != tight


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
