"""Benchmark decontamination: a BM25 index of test items with block-max bounds, then overlap checks.

Items are the indexed documents, passages of the training texts are the queries. Items of up to 16, 64,
256, ... words form a class with passages of its own: windows of twice that many words, every such half;
an item that occurs in a text therefore lies whole in one of them, and what is found for it doesn't
depend on the length of others. Impacts are BM25 weights as a share of the item's own score, so one
threshold serves all items; document frequencies, item number and mean length are taken over all items.
Items form blocks. A block's bound for a passage is the sum of the block's largest impacts over the
passage's rarer words, by their postings of blocks, and the most that any of its items can take from
common words; blocks whose bound is under the threshold are skipped unscored. The bounds are exact upper
bounds: every item at or above the threshold is retrieved. Retrieved items are verified by the share of
five-word shingles of their question and of their answer (last sentence, or last quarter of a single
sentence) in the passage.

The index is sent to the executors in parts of about PART_WORDS words of items, each of which takes a
scan of the texts; how items are dealt into parts changes no result.

Cases: null texts are empty; items that are null or have no words never match; items of fewer than
five words are verified by the words they have; very long texts are searched in slices of PASSAGES
entries, whole, and very long items belong to a class of long passages; repeated documents each give
their rows, and so do repeated items; of equally good passages the first is named; an empty table gives
an empty result; columns named like a result are not carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, durable, lookup, tidied

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that retrieves it.
THRESHOLD = 0.5
#: Share of five-word shingles of question and of answer that confirms it.
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 2
#: Words in more than this share of the items are common.
COMMON = 0.05
#: Words of the items that one scan of the texts looks for (the vocabulary and postings that are sent out).
PART_WORDS = 2_000_000
#: Postings of blocks that are added up at once.
PASSAGES = 4_000_000
KNOWN = 150_000


def normal(token: bytes) -> str:
    return bare(token.decode("utf-8", "replace"))


def item_words(text: str) -> list[str]:
    return [w for w in map(normal, (text or "").encode().split()) if w]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of the item's question and answer."""
    ends = [m.end() for m in re.finditer(r"[.!?:]+\s+|\n+", text.strip())]
    if ends:
        q, a = item_words(text.strip()[: ends[-1]]), item_words(text.strip()[ends[-1] :])
        if q and a:
            return q, a
    w = item_words(text)
    cut = max(1, len(w) - max(1, len(w) // 4))
    return w[:cut], w[cut:]


def level(n: int) -> int:
    """The class of an item of n words: 16, 64, 256, ... words at most."""
    k = 2
    while 4**k < n:
        k += 1
    return k


class Index:
    """Some items of one class. n, mean and df (items that hold each word of the vocabulary) are those of all items."""

    def __init__(self, items: list[tuple[int, str]], threshold: float, n: int, mean: float, vocabulary: dict[str, int], df: np.ndarray, half: int):
        self.threshold, self.half, self.vocabulary = threshold, half, vocabulary
        self.items, bags = [i for i, _ in items], []
        self.parts: list[tuple[np.ndarray, ...]] = []
        for _, t in items:
            bags.append(np.array([vocabulary[x] for x in item_words(t)], np.int64))
            self.parts.append(tuple(np.array([vocabulary[x] for x in p], np.int64) for p in question_answer(t)))
        own = df.astype(float)
        idf = np.log(1 + (n - own + 0.5) / (own + 0.5))
        common = own > max(1.0, COMMON * n)
        self.blocks = max(1, -(-len(bags) // BLOCK))
        self.common_bound = np.zeros(self.blocks)
        words, who, impacts = [], [], []
        for i, b in enumerate(bags):
            ids, tf = np.unique(b, return_counts=True)
            impact = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(b) / mean))
            impact /= impact.sum()
            words.append(ids), who.append(np.full(len(ids), i)), impacts.append(impact)
            self.common_bound[i // BLOCK] = max(self.common_bound[i // BLOCK], float(impact[common[ids]].sum()))
        word, item, x = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((words, np.int64), (who, np.int64), (impacts, float)))
        by = np.lexsort((item, word))
        word, self.item, self.impact = word[by], item[by], x[by]
        self.first_item = np.searchsorted(word, np.arange(len(self.vocabulary) + 2))
        # for each rarer word the blocks that hold it and their largest impacts; the last word stands for all others
        rare = ~common[word]
        key = word[rare] * self.blocks + self.item[rare] // BLOCK
        head = np.flatnonzero(np.diff(key, prepend=-1))
        self.largest = np.maximum.reduceat(self.impact[rare], head) if len(head) else np.zeros(0)
        self.block = key[head] % self.blocks
        self.first = np.searchsorted(key[head] // self.blocks, np.arange(len(self.vocabulary) + 2))
        self.always = np.flatnonzero(self.common_bound >= threshold - 1e-9)

    def matches(self, ids: np.ndarray, off: np.ndarray | None = None, limit: int = PASSAGES) -> list[tuple[int, int, float, float, float, int, int]]:
        """(text, item, score, question overlap, answer overlap, first word, end word) of some texts.

        ids: numbers in the vocabulary (its size for any other word) of all texts, text k from off[k] to off[k + 1].
        """
        off = np.array([0, len(ids)]) if off is None else off
        half, size = self.half, np.diff(off)
        cells = np.maximum(-(-size // half), 1)  # of half a passage each; a passage is two in a row
        first = np.concatenate([[0], np.cumsum(cells)])
        n = self.first[ids + 1] - self.first[ids]
        at = np.flatnonzero(n)
        text = np.searchsorted(off, at, "right") - 1
        cell = first[text] + (at - off[text]) // half
        last = np.zeros(int(first[-1]), bool)
        last[first[1:] - 1] = True
        best: dict[tuple[int, int], tuple] = {}
        edge = np.searchsorted(cell, np.arange(int(first[-1]) + 1))  # of each cell's words in `at`
        total = np.concatenate([[0], np.cumsum(n[at])])[edge]
        c = 0
        while c < first[-1]:
            z = max(c + 1, int(np.searchsorted(total, total[c] + limit, "right")) - 1)
            self._passages(c, min(z, int(first[-1])), ids, off, first, last, at, cell, edge, n, best)
            c = z
        return [(k, self.items[i], x, q, w, a, z) for (k, i), (_, x, q, w, a, z) in best.items()]

    def _passages(self, c: int, z: int, ids, off, first, last, at, cell, edge, n, best: dict) -> None:
        """Passages that begin in the cells from c to z."""
        own = at[edge[c] : edge[min(z + 1, len(edge) - 1)]]
        m = n[own]
        entry = np.repeat(self.first[ids[own]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
        in_cell = np.repeat(cell[edge[c] : edge[c] + len(own)], m)
        key, x = in_cell * self.blocks + self.block[entry], self.largest[entry]
        back = (in_cell > c) & ~last[in_cell - 1]  # the second half of the passage before
        key, x = np.concatenate([key, key[back] - self.blocks]), np.concatenate([x, x[back]])
        found, inv = np.unique(key, return_inverse=True)
        bound = np.bincount(inv, x, minlength=len(found)) + self.common_bound[found % self.blocks]
        found = found[bound >= self.threshold - 1e-9]
        begins = np.unique(np.concatenate([found // self.blocks, np.arange(c, z)])) if len(self.always) else np.unique(found // self.blocks)
        for p in begins[begins < z].tolist():
            k = int(np.searchsorted(first, p, "right")) - 1
            if last[p] and p > first[k]:
                continue  # the passage before holds it whole
            alive = np.unique(np.concatenate([self.always, found[np.searchsorted(found, p * self.blocks) : np.searchsorted(found, (p + 1) * self.blocks)] % self.blocks]))
            a = int(off[k]) + (p - int(first[k])) * self.half
            self._score(k, a - int(off[k]), ids[a : min(a + 2 * self.half, int(off[k + 1]))], alive, best)

    def _score(self, text: int, a: int, own: np.ndarray, alive: np.ndarray, best: dict) -> None:
        """Exact scores of one passage for the items of the blocks alive; the best passage of every item stays."""
        terms = np.unique(own)
        terms = terms[terms < len(self.vocabulary)]
        lo, m = self.first_item[terms], self.first_item[terms + 1] - self.first_item[terms]
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum()) if len(m) else np.zeros(0, np.int64)
        item = self.item[entry]
        ok = alive[np.minimum(np.searchsorted(alive, item // BLOCK), len(alive) - 1)] == item // BLOCK
        got, inv = np.unique(item[ok], return_inverse=True)
        score = np.bincount(inv, self.impact[entry][ok], minlength=len(got))
        sets: dict[int, set] = {}
        words = own.tolist()
        for i, x in zip(got.tolist(), score.tolist(), strict=True):
            if x < self.threshold - 1e-9:
                continue
            shares = []
            for part in self.parts[i]:
                if not len(part):  # a one-word item has no answer
                    shares.append(1.0)
                    continue
                k, p = min(SHINGLE, len(part)), part.tolist()
                if k not in sets:
                    sets[k] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
                sh = {tuple(p[j : j + k]) for j in range(len(p) - k + 1)}
                shares.append(sum(y in sets[k] for y in sh) / len(sh))
            now = (min(shares), round(x, 9), *shares, a, a + len(own))  # rounded: sums differ with the order of words
            was = best.get((text, i))
            if was is None or (now[:2], -a) > (was[:2], -was[4]):
                best[text, i] = now


class _Numbers(dict):
    """Raw token -> word number, or -1 for tokens without a word."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary, self.other = vocabulary, len(vocabulary)

    def __missing__(self, token: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        w = normal(token)
        self[token] = k = self.vocabulary.get(w, self.other) if w else -1
        return k


class Part:
    """The indexes, by class, of the items that one scan looks for; they share a vocabulary."""

    def __init__(self, rows, threshold: float, n: int, mean: float):
        by: dict[int, list] = {}
        df: dict[str, int] = {}
        for r in rows:
            by.setdefault(r["level"], []).append((r["item"], r["text"]))
            df.update((x["word"], x["df"]) for x in r["df"])
        self.vocabulary = {w: k for k, w in enumerate(df)}
        counts = np.array(list(df.values()), np.int64)
        self.indexes = [Index(items, threshold, n, mean, self.vocabulary, counts, 4**k) for k, items in sorted(by.items())]


def indexes(items: DataFrame, item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> Iterator[Part]:
    """The index in parts. Statistics of all items are aggregates; one part at a time passes through the driver."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [item_words(t) for t in b.column(1).to_pylist()]
            n = pa.array([len(w) for w in bags], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n, pa.array([level(len(w)) for w in bags], pa.int32()), pa.array([sorted(set(w)) for w in bags], pa.list_(pa.string()))], ["item", "text", "n", "level", "words"])

    src = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    kind = src.schema["item"].dataType.simpleString()
    bags = src.mapInArrow(split, f"item {kind}, text string, n long, level int, words array<string>").where("n > 0").withColumn("row", F.monotonically_increasing_id())
    bags = durable(bags, "items")
    total, words = bags.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return
    seen = bags.select("row", F.explode("words").alias("word"))
    df = lookup(seen, seen.groupBy("word").agg(F.count("*").alias("df")), ["word"]).groupBy("row").agg(F.collect_list(F.struct("word", "df")).alias("df"))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-words // part_words))))
    parts = bags.drop("words", "n").withColumn("part", part).join(df, "row").orderBy("part", "row")
    for _, rows in groupby(parts.toLocalIterator(), key=lambda r: r["part"]):
        yield Part(rows, threshold, total, words / total)


def _search(part: Part, texts: list[str | None], number: _Numbers) -> Iterator[tuple]:
    """(row, item, ...) as Index.matches gives them."""
    rows, held, size = [], [], 0
    for k, t in enumerate([*texts, None]):
        if t:
            ids = np.array(list(map(number.__getitem__, t.encode().split())), np.int64)
            ids = ids[ids >= 0]
            if len(ids):
                rows.append(k), held.append(ids)
                size += len(ids)
        if rows and (size > 200_000 or k == len(texts)):
            off = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            flat = np.concatenate(held)
            for index in part.indexes:
                yield from ((rows[m[0]], *m[1:]) for m in index.matches(flat, off))
            rows, held, size = [], [], 0


def matches(docs: DataFrame, items: DataFrame, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, part_words: int = PART_WORDS) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap, first_word, end_word): all items retrieved, verified or not."""
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string"))
    kind, ikind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, `{item_id}` {ikind}, score double, question_overlap double, answer_overlap double, first_word int, end_word int"
    names = [id_col, item_id, "score", "question_overlap", "answer_overlap", "first_word", "end_word"]
    item_type = pa.int64() if ikind == "bigint" else pa.int32() if ikind == "int" else pa.string()
    kinds = [item_type, pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
    spark, out = docs.sparkSession, docs.sparkSession.createDataFrame([], ddl)
    for part in indexes(items, item_id, item_text, threshold, part_words):
        sent = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number = _Numbers(sent.value.vocabulary)
            for b in batches:
                at, *cols = list(zip(*_search(sent.value, b.column(1).to_pylist(), number), strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(list(at), pa.int64())), *[pa.array(c, x) for c, x in zip(cols, kinds, strict=True)]], names)

        out = out.unionByName(src.mapInArrow(tidied(run), ddl))
    return out


def leaks(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, **how) -> DataFrame:
    """The matches whose question and answer overlap by `overlap` at least."""
    return matches(docs, items, **how).where((F.col("question_overlap") >= overlap) & (F.col("answer_overlap") >= overlap))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, overlap: float = OVERLAP, part_words: int = PART_WORDS) -> DataFrame:
    """docs without the rows that leak an item. Each row is judged by its own text, whatever ids are null or shared."""
    where, out = docs.columns.index(text), docs
    for part in indexes(items, item_id, item_text, threshold, part_words):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number = _Numbers(sent.value.vocabulary)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for row, _, _, q, w, _, _ in _search(sent.value, b.column(where).to_pylist(), number):
                    keep[row] &= min(q, w) < overlap
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(tidied(run), docs.schema)
    return out
