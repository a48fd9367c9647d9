"""Substring dedup with repeated-phrase automata.

A passage recurs if a window of `window` consecutive words of one document starts at more than one
place. Every word covered by a window that also starts earlier (smaller id, or same document and
earlier start) is removed; windows are judged on the input.

1. Sample. Each window is represented by the phrase of `phrase` words in it whose hash is smallest,
   so equal windows have the same phrase and a document has about one phrase in seven words. Shards
   of documents send their distinct phrase hashes, in blocks by hash range, and get back those that
   occur again anywhere.
2. Confirm. Windows around recurring phrases, one of each kind per shard, are compared by 96-bit
   hashes in blocks by these hashes; shards get back those of their windows that recur anywhere, and
   which of them is the first of all. A hot passage is sent once per shard, however often it occurs.
3. Locate. Windows in a row form passages. Every shard compiles an Aho-Corasick automaton over words
   from the phrases of its passages, spaced so that every window of a passage holds one, and streams
   all its documents through it; each hit is extended word by word along the passages that it may
   belong to, and where a whole window agrees that is an occurrence. All but the first are removed.

Texts are shuffled once (by shard) and everything else is a few bytes per phrase.

Cases: null text has no words; texts shorter than a window lose nothing; very long texts go through
the automaton whole; rows with equal ids are ordered by text, and null ids come before all others; equal rows are ordered by place, so all but one
lose what they share; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, buffers, freeze, gram_hashes, in_sorted, scaled, slices, text_array, text_bytes, thaw, tidy, without, word_hashes, words

WINDOW = 20
PHRASE = 8
RESULTS = ("n_words", "n_removed", "removed", "kept_text")
NO_ID = np.iinfo(np.int64).min


def _ordered(table: pa.Table, id_col: str, text: str) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """The rows by (id, text), their ids, their texts."""
    ids = table.column(id_col).cast(pa.int64()).fill_null(NO_ID).to_numpy()
    texts = text_array(table.column(text))
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (np.diff(ids[order]) == 0).any():
        raw = texts.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], raw[i])), np.int64)
    return table.take(pa.array(order)), ids[order], texts.take(pa.array(order))


class _Slice:
    """Words, phrases and windows of some documents of a shard."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int, window: int, phrase: int):
        self.starts, self.ends, row = words(data, off)
        self.row = row + first
        self.h = word_hashes(data, self.starts, self.ends)
        n = len(self.h) - window + 1
        self.windows = np.zeros(0, np.int64)
        if n > 0:
            self.windows = np.flatnonzero(self.row[:n] == self.row[window - 1 :])
        self.first_word = np.searchsorted(self.row, np.arange(first, first + len(off)))  # of each row, and the end
        if len(self.windows):
            grams = gram_hashes(self.h, phrase, 1)
            near = np.lib.stride_tricks.sliding_window_view(grams, window - phrase + 1)
            self.anchor = self.windows + near[self.windows].argmin(axis=1)  # leftmost of equal ones
            self.anchor_hash = grams[self.anchor]
        else:
            self.anchor, self.anchor_hash = self.windows, np.zeros(0, np.uint64)


def _each(texts: pa.Array, window: int, phrase: int):
    data, off = buffers(texts)
    for i, j in slices(off):
        yield i, j, _Slice(data[off[i] : off[j]], off[i : j + 1] - off[i], i, window, phrase)


def _letters(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(letters, place of each word's last letter). A known word is three digits of its number, each from
    an alphabet of its own, so that no automaton node has more than `base` successors; other words are 0."""
    known = ids > 0
    end = np.cumsum(np.where(known, 3, 1))
    out = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
    at, k = end[known] - 3, ids[known]
    out[at], out[at + 1], out[at + 2] = 1 + k % base, 1 + base + k // base % base, 1 + 2 * base + k // (base * base)
    return out, end - 1


class Passages:
    """An automaton over the phrases of some passages, each a run of words whose windows all recur."""

    def __init__(self, passages: list[list[bytes]], window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        ids = [np.array([number(x, len(self.vocabulary) + 1) for x in p], np.int32) for p in passages]
        self.words = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        size = np.array([len(p) for p in ids], np.int64)
        self.end = np.repeat(np.cumsum(size), size)  # of the passage of each word
        self.begin = self.end - np.repeat(size, size)
        # each window of a passage holds one of the phrases that begin `window - phrase + 1` words apart
        place = np.flatnonzero(((np.arange(len(self.words)) - self.begin) % (window - phrase + 1) == 0) & (np.arange(len(self.words)) + phrase <= self.end))
        self.base = max(2, int(np.ceil((len(self.vocabulary) + 1) ** (1 / 3))))
        keys = self.words[place[:, None] + np.arange(phrase)]
        own, inv = np.unique(keys, axis=0, return_inverse=True) if len(place) else (keys, np.zeros(0, np.int64))
        order = np.argsort(inv.reshape(-1), kind="stable")
        self.place, self.first = place[order], np.searchsorted(inv.reshape(-1)[order], np.arange(len(own) + 1))
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        if len(own):
            for k, x in enumerate(_letters(own.reshape(-1), self.base)[0].reshape(len(own), -1).tolist()):
                self.machine.add_word(tuple(x), k)
            self.machine.make_automaton()

    def numbers(self, text: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(x, 0) for x in text], np.int32)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every occurrence of a phrase in a text."""
        if not len(self.place) or len(ids) < self.window:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        letters, last = _letters(ids.astype(np.int64), self.base)
        found = list(self.machine.iter(tuple(letters.tolist())))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e, k = np.array(found, np.int64).T
        return np.searchsorted(last, e) - self.phrase + 1, k

    def windows(self, ids: np.ndarray, at: np.ndarray, key: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """First words of the windows of a text that agree with a passage around one of the hits."""
        n = self.first[key + 1] - self.first[key]
        total, out, i = np.cumsum(n), [], 0
        back, w = self.window - self.phrase, self.window
        offset = np.arange(-back, w)
        while i < len(at):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + block, "right")))
            m = n[i:j]
            entry = np.repeat(self.first[key[i:j]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            for lo in range(0, len(entry), block):  # a phrase of very many passages
                p = self.place[entry[lo : lo + block]]
                x = np.repeat(at[i:j], m)[lo : lo + block]
                u, v = x[:, None] + offset, p[:, None] + offset
                ok = (u >= 0) & (u < len(ids)) & (v >= self.begin[p][:, None]) & (v < self.end[p][:, None])
                same = ok & (ids[np.where(ok, u, 0)] == self.words[np.where(ok, v, 0)])
                run = np.zeros((len(p), len(offset) + 1), np.int32)
                np.cumsum(same, axis=1, out=run[:, 1:])
                hit, shift = np.nonzero(run[:, w:] - run[:, :-w] == w)
                out.append(x[hit] + offset[shift])
            i = j
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def runs(row: np.ndarray, start: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(row, first word, end word) of the passages that windows in a row form."""
    if not len(row):
        return []
    order = np.lexsort((start, row))
    row, start = row[order].astype(np.int64), start[order].astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(start) != 1)]))
    tail = np.append(head[1:], len(row)) - 1
    return list(zip(row[head].tolist(), start[head].tolist(), (start[tail] + window).tolist(), strict=True))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


BLOCK = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary())])
REPLY = pa.schema([("shard", pa.int32()), ("payload", pa.binary())])
DDL_BLOCK, DDL_REPLY = "bucket int, shard int, payload binary", "shard int, payload binary"


def dedup_substrings(docs: DataFrame, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int | None = None) -> DataFrame:
    """docs plus n_words, n_removed, removed (spans of words, end exclusive) and kept_text.

    shard_bytes: text of a shard; by default 4 MB, growing with the fourth root of the input.
    """
    if not 0 < phrase <= window:
        raise ValueError("a phrase is part of a window")
    total = text_bytes(docs, text)
    shards = max(1, -(-total // (shard_bytes or scaled(total, 4 << 20, 0.25))))
    buckets = max(1, -(-total // scaled(total, 8 << 20, 0.4)))
    base = without(docs, *RESULTS)
    cols = base.columns
    src = base.withColumn("__shard", F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(shards)).cast("int"))
    by_shard = src.groupBy("__shard")

    def sample(table: pa.Table) -> pa.Table:
        tidy()
        shard = table.column("__shard")[0].as_py()
        _, _, texts = _ordered(table, id_col, text)
        found = []
        for _, _, s in _each(texts, window, phrase):
            new = np.ones(len(s.anchor), bool)
            new[1:] = s.anchor[1:] != s.anchor[:-1]  # equal anchors are next to each other
            found.append(s.anchor_hash[new])
        h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
        cut = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1))
        return _rows([(b, shard, freeze(h[i:j], n[i:j] > 1)) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i], BLOCK)

    def recurring(table: pa.Table) -> pa.Table:
        shards_, parts = table.column("shard").to_pylist(), [thaw(x) for x in table.column("payload").to_pylist()]
        h, again = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inv, n = np.unique(h, return_inverse=True, return_counts=True)
        twice = n > 1
        twice[inv[again]] = True
        keep, at, out = twice[inv], 0, []
        for shard, p in zip(shards_, parts, strict=True):
            k = keep[at : at + len(p[0])]
            at += len(p[0])
            if k.any():
                out.append((shard, freeze(p[0][k])))
        return _rows(out, REPLY)

    def confirm_blocks(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows or not table.num_rows:
            return _rows([], BLOCK)
        tidy()
        shard = replies.column("shard")[0].as_py()
        known = np.sort(np.concatenate([thaw(x)[0] for x in replies.column("payload").to_pylist()]))
        _, ids, texts = _ordered(table, id_col, text)
        parts = []
        for i, _, s in _each(texts, window, phrase):
            k = in_sorted(s.anchor_hash, known)
            if k.any():
                w = s.windows[k]
                parts.append((gram_hashes(s.h, window, 2)[w], (gram_hashes(s.h, window, 3)[w] >> np.uint64(32)).astype(np.uint32), s.row[w], w - s.first_word[s.row[w] - i]))
        if not parts:
            return _rows([], BLOCK)
        w1, w2, row, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((w2, w1))  # stable: the first of equal windows is the first in the shard
        same = np.zeros(len(order), bool)
        same[1:] = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
        lead = np.flatnonzero(~same)
        again = np.diff(np.append(lead, len(order))) > 1
        keep = order[lead]
        b = bucket_of(w1[keep], buckets)  # by window, so that a phrase with many continuations is no hot bucket
        by = np.lexsort((keep, b))  # within a bucket by place
        keep, again, b = keep[by], again[by], b[by]
        cut, out = np.searchsorted(b, np.arange(buckets + 1)), []
        for k, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                x = keep[i:j]
                out.append((k, shard, freeze(w1[x], w2[x], ids[row[x]], row[x].astype(np.int32), start[x].astype(np.int32), again[i:j])))
        return _rows(out, BLOCK)

    def confirm(table: pa.Table) -> pa.Table:
        shards_, parts = table.column("shard").to_pylist(), [thaw(x) for x in table.column("payload").to_pylist()]
        w1, w2, ids, row, start, again = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, row, ids, w2, w1))
        head = np.ones(len(order), bool)
        head[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
        group = np.cumsum(head) - 1
        recurs = np.bincount(group) > 1
        recurs |= np.bincount(group, weights=again[order]) > 0
        confirmed, first = np.zeros(len(order), bool), np.zeros(len(order), bool)
        confirmed[order], first[order] = recurs[group], head
        at, out = 0, []
        for shard, p in zip(shards_, parts, strict=True):
            i, at = at, at + len(p[0])
            k = confirmed[i:at]
            if k.any():
                out.append((shard, freeze(row[i:at][k], start[i:at][k], first[i:at][k])))
        return _rows(out, REPLY)

    out_schema = src.drop("__shard").schema
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out_schema] + ["n_words long", "n_removed long", "removed array<struct<`start`:int,`end`:int>>", "kept_text string"])

    def locate(table: pa.Table, replies: pa.Table) -> pa.Table:
        tidy()
        rows, _, texts = _ordered(table, id_col, text)
        found = [thaw(x) for x in replies.column("payload").to_pylist()]
        row, start, first = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, bool))
        owned = np.sort((row.astype(np.int64) << 32 | start)[first])
        raw = texts.to_pylist()
        gone: dict[int, np.ndarray] = {}
        if len(row):
            split = {r: raw[r].split() for r in np.unique(row).tolist()}
            passages = Passages([split[r][a:b] for r, a, b in runs(row, start, window)], window, phrase)
            del split
            for r, t in enumerate(raw):
                ids = passages.numbers(t.split())
                at = passages.windows(ids, *passages.hits(ids))
                at = at[~in_sorted(r << 32 | at, owned)]
                if len(at):
                    edge = np.zeros(len(ids) + 1, np.int32)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone[r] = np.cumsum(edge[:-1]) > 0
            del passages
        n_words, n_removed, spans, kept = [], [], [], []
        for r, t in enumerate(raw):
            own = t.split()
            n_words.append(len(own))
            g = gone.get(r)
            if g is None:
                n_removed.append(0), spans.append([]), kept.append(b" ".join(own))
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
            n_removed.append(int(g.sum()))
            spans.append([{"start": int(x), "end": int(y)} for x, y in turn.reshape(-1, 2)])
            kept.append(b" ".join([own[x] for x in np.flatnonzero(~g).tolist()]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        own_cols = [rows.column(c) for c in cols]
        return pa.Table.from_arrays([*own_cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()).cast(pa.string())], [*cols, *RESULTS])

    found = by_shard.applyInArrow(sample, DDL_BLOCK).groupBy("bucket").applyInArrow(recurring, DDL_REPLY)
    asked = by_shard.cogroup(found.groupBy("shard")).applyInArrow(confirm_blocks, DDL_BLOCK)
    confirmed = asked.groupBy("bucket").applyInArrow(confirm, DDL_REPLY)
    return by_shard.cogroup(confirmed.groupBy("shard")).applyInArrow(locate, ddl)
