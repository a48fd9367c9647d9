import math
import random
from collections import Counter

import pytest

from nichespark.llm import decontam, lm


def words(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()


def brute(rows, order, alpha, least):
    c = [Counter() for _ in range(order + 1)]
    for _, t in rows:
        w = words(t)
        for n in range(1, order + 1):
            c[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total, out = sum(c[1].values()), []
    for i, t in rows:
        w, s = words(t), 0.0
        for k in range(len(w)):
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1 or c[n][g] >= least:
                    s += math.log(c[n][g] / (c[n - 1][g[:-1]] if n > 1 else total)) + (order - n) * math.log(alpha)
                    break
        out.append((i, len(w), round(s, 6)))
    return sorted(out, key=str)


# with 8 or 12 bits most n-grams share theirs with others: counts must stay exact
@pytest.mark.parametrize(("order", "shard_bytes", "bits"), [(3, None, None), (3, 900, 8), (1, 900, None), (4, 2000, 12)])
def test_scores_match_brute_force(spark, order, shard_bytes, bits):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "B", "b", "é", "dd\x1c", "漢\n"]) + str(rng.randint(0, 3)) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "a b"), (3, rows[4][1]), (202, "w " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    out = lm.score(df, order=order, shard_bytes=shard_bytes, filter_bits=bits).collect()
    assert all(r.score is None if not r.n_tokens else abs(r.score - r.log_sum / r.n_tokens) < 1e-9 for r in out)
    got = sorted(((r.doc_id, r.n_tokens, round(r.log_sum, 6)) for r in out), key=str)
    want = brute(rows, order, lm.ALPHA, lm.MIN_COUNT)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(x[2] - y[2]) <= 1e-9 * (1 + abs(y[2])) + 2e-6 for x, y in zip(got, want, strict=True))
    assert lm.score(df.limit(0), order=order).count() == 0


def plain_index(items):
    """BM25 impacts as shares of each item's score, from the formula: {item: {word: impact}}."""
    bags = {i: decontam.item_words(t) for i, t in items if decontam.item_words(t)}
    n, mean = len(bags), sum(map(len, bags.values())) / max(1, len(bags))
    df = Counter(w for b in bags.values() for w in set(b))
    out = {}
    for i, b in bags.items():
        tf = Counter(b)
        x = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(b) / mean)) for w in tf}
        out[i] = (len(b), {w: v / sum(x.values()) for w, v in x.items()})
    return out


def plain_matches(text, index, threshold):
    """{item: best score over passages} of the items retrieved."""
    w, best = decontam.item_words(text), {}
    for i, (n, x) in index.items():
        half = 4 ** decontam.level(n)
        for s in range(0, max(1, -(-len(w) // half) * half - half), half):
            score = sum(x.get(t, 0.0) for t in set(w[s : s + 2 * half]))
            if score >= threshold:
                best[i] = max(best.get(i, 0.0), score)
    return best


@pytest.mark.parametrize(("part_words", "limit"), [(2_000_000, None), (700, 50)])
def test_block_max_retrieves_all_above_the_threshold(spark, monkeypatch, part_words, limit):
    if limit:
        plain = decontam.Index.matches
        monkeypatch.setattr(decontam.Index, "matches", lambda self, ids, off=None: plain(self, ids, off, limit))
    rng = random.Random(9)
    voc = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choices(voc, k=rng.choice([1, 5, 16, 17, 30, 64, 90])))) for i in range(60)]
    own = plain_index(items)
    texts = []
    for _ in range(60):
        text = rng.choices([*voc, "zz"], k=rng.randint(1, 400))
        text[3:3] = rng.choice(items)[1].split()
        texts.append(" ".join(text))
    got = [set() for _ in texts]
    for part in decontam.indexes(spark.createDataFrame(items, "item_id long, text string"), threshold=0.3, part_words=part_words):
        for k, i, *_ in decontam._search(part, texts, decontam._Numbers(part.vocabulary)):
            got[k].add(i)
    assert got == [set(plain_matches(t, own, 0.3)) for t in texts]


def test_leaks(spark):
    rng = random.Random(2)
    voc = [f"t{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(voc, k=25)) + ". " + " ".join(rng.choices(voc, k=8)) + ".") for i in range(50)] + [(90, None), (91, ""), (92, "Two words"), (93, "?!")]
    noise = lambda n: " ".join(rng.choices(voc, k=n))
    rows, planted = [], set()
    for d in range(80):
        k = rng.randint(0, 49)
        body = items[k][1]
        if d % 4 == 0:
            rows.append((d, noise(rng.randint(0, 300)) + " " + body.upper().replace(" ", "\n") + " " + noise(50)))
            planted.add((d, k))
        elif d % 4 == 1:
            rows.append((d, noise(100) + " " + " ".join(body.split()[:25])))  # the question alone
        else:
            rows.append((d, noise(rng.randint(0, 400))))
    rows += [(500, None), (501, ""), (None, items[0][1]), (502, items[1][1]), (502, items[1][1]), (503, noise(20_000) + " " + items[2][1] + " " + noise(20_000))]
    planted |= {(None, 0), (502, 1), (503, 2)}
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id != 92} == planted
    key = lambda rows: sorted(map(tuple, rows), key=str)
    for part_words in (2000, 200):
        assert key(decontam.leaks(docs, bench, part_words=part_words).collect()) == key(got)
    left = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert left >= {500, 501} and not left & {d for d, _ in planted}
    assert {r.doc_id for r in decontam.decontaminate(docs, bench, part_words=100).collect()} == left
    assert decontam.leaks(docs.limit(0), bench).count() == 0
    assert decontam.leaks(docs, bench.limit(0)).count() == 0


def test_very_long_items_and_texts(spark):
    """An item of 30,000 words matches, and changes what is found for others in no way but through the statistics of all items."""
    rng = random.Random(5)
    long = " ".join(f"l{rng.randint(0, 9000)}" for _ in range(30_000)) + ". " + " ".join(f"m{i}" for i in range(50))
    items = [(1, long), (2, "what is the name of the tallest bird in the quiet old zoo? the grey heron of the north")]
    noise = " ".join(f"n{rng.randint(0, 999)}" for _ in range(150_000))
    rows = [(10, "a b " + long.upper() + " c"), (11, noise + " " + items[1][1]), (12, noise), (12, items[1][1]), (13, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()} == {(10, 1), (11, 2), (12, 2)}
    left = decontam.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id, r.text is None) for r in left) == [(12, False), (13, True)]
