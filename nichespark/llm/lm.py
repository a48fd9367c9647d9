"""Language-model scoring by stupid backoff, with n-gram count tables partitioned by hash.

Counts of all documents are exact (of 64-bit n-gram hashes) and made in two steps, since most n-grams of
a corpus occur once and needn't be sent in full:

1. Filter. Shards of documents send the first bits of the hash of each distinct n-gram, to blocks by hash
   range, and get back which of them recur. The bits grow with the logarithm of the input, so that few
   n-grams share them by chance; one whose bits occur once occurs once itself.
2. Count. Shards send the whole hashes and counts of the n-grams whose bits recur, once for each distinct
   one, as rows of a count table partitioned by hash range (rows are kept in blocks: sorted hashes and
   counts). A partition adds the counts up and joins the totals back to the n-grams that each shard asked
   for; the shard then has the counts of all its n-grams and sums the logarithms per document.

A frequent n-gram costs one row per shard, however often it occurs.

S(w | context) = c(context w) / c(context) for the longest context whose n-gram was seen MIN_COUNT
times at least, times ALPHA for each word by which the context was shortened; single words have
c(w) / N. As the scored text is itself counted, an n-gram seen once is evidence of nothing but itself:
MIN_COUNT 2 backs off from it, MIN_COUNT 1 would score every document by its own words. Words are runs of
bytes other than space and \\x09-\\x0D, with A-Z lower-cased.

Cases: null texts and texts without words have no tokens, a sum of 0 and a null mean; very long texts are
hashed in one piece and count like any other; repeated rows count as often as they occur and have equal
scores; null ids are kept; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, buffers, durable, freeze, scaled, slices, spans_hash, text_array, text_bytes, thaw, tidy, without, word_hashes, words
from .substring import BLOCK, DDL_BLOCK, DDL_REPLY, REPLY, _rows

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
RESULTS = ("n_tokens", "score", "log_sum")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The filter keeps as many bits of a hash as the number of the corpus' bytes has, and this many more: about
#: one n-gram in 2**SPARE is counted although it occurs once. Results don't depend on it.
SPARE = 5


def _grams(texts: pa.Array, order: int):
    """(row of each word, hashes of the n-gram that ends at each word for each order; 0 where there is none)."""
    data, off = buffers(texts)
    rows, grams = [], [[] for _ in range(order)]
    for i, j in slices(off):
        part = _FOLD[data[off[i] : off[j]]]
        s, e, row = words(part, off[i : j + 1] - off[i])
        h = word_hashes(part, s, e)
        rows.append(row + i)
        for n in range(1, order + 1):
            g = np.zeros(len(h), np.uint64)
            if len(h) >= n:
                k = np.arange(len(h) - n + 1)
                g[n - 1 :] = np.maximum(spans_hash(h, k, k + n, 1 + n % 3), np.uint64(1))
                g[n - 1 :][row[: len(h) - n + 1] != row[n - 1 :]] = 0
            grams[n - 1].append(g)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(rows, np.int64), [cat(g, np.uint64) for g in grams]


def _cuts(u: np.ndarray, buckets: int) -> np.ndarray:
    """Where the buckets of sorted hashes begin, and the end."""
    return np.searchsorted(bucket_of(u, buckets), np.arange(buckets + 1))


def _recurring(u: np.ndarray, masks: list[np.ndarray], drop: np.uint64) -> np.ndarray:
    """Which of the sorted distinct hashes u have bits that recur; masks: of the distinct bits, in order."""
    if not len(u):
        return np.zeros(0, bool)
    bits = u >> drop
    place = np.cumsum(np.concatenate([[False], bits[1:] != bits[:-1]]))
    return np.concatenate(masks)[place]


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, shard_bytes: int | None = None, filter_bits: int | None = None) -> DataFrame:
    """docs plus n_tokens, score (mean natural logarithm of a token's S) and log_sum (their sum)."""
    if order < 1 or not 0 < alpha < 1 or min_count < 1:
        raise ValueError("order and min_count must be at least 1, alpha between 0 and 1")
    total = text_bytes(docs, text)
    shards = max(1, -(-total // (shard_bytes or scaled(total, 4 << 20, 0.25))))
    buckets = max(1, -(-total // scaled(total, 4 << 20, 0.4)))
    drop = np.uint64(max(0, 64 - (filter_bits or max(24, (total + 1).bit_length() + SPARE))))
    base = without(docs, *RESULTS)
    cols = base.columns
    src = base.withColumn("__shard", F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text}`"))), F.lit(shards)).cast("int"))
    by_shard = src.groupBy("__shard")

    def distinct(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        return [np.unique(g[g > 0], return_counts=True) for g in _grams(text_array(table.column(text)), order)[1]]

    def ask(table: pa.Table) -> pa.Table:
        tidy()
        own = []
        for u, n in distinct(table):
            bits, first = np.unique(u >> drop, return_index=True)
            again = np.add.reduceat(n, first) > 1 if len(u) else np.zeros(0, bool)
            own.append((bits, again, _cuts(u[first], buckets)))
        out = []
        for b in range(buckets):
            parts = [x for bits, again, cut in own for x in (bits[cut[b] : cut[b + 1]], np.packbits(again[cut[b] : cut[b + 1]]))]
            out.append((b, table.column("__shard")[0].as_py(), freeze(*parts)))
        return _rows(out, BLOCK)

    def answer(table: pa.Table) -> pa.Table:
        who, parts = table.column("shard").to_pylist(), [thaw(x) for x in table.column("payload").to_pylist()]
        replies = [[np.array([table.column("bucket")[0].as_py()], np.int64)] for _ in parts]
        for n in range(order):
            size = [len(p[2 * n]) for p in parts]
            bits = np.concatenate([p[2 * n] for p in parts])
            again = np.concatenate([np.unpackbits(p[2 * n + 1], count=k) for p, k in zip(parts, size, strict=True)]).astype(bool)
            _, inv, count = np.unique(bits, return_inverse=True, return_counts=True)
            twice = count > 1
            twice[inv[again]] = True
            mask, at = twice[inv], 0
            for r, k in zip(replies, size, strict=True):
                r += [np.array([k], np.int64), np.packbits(mask[at : at + k])]
                at += k
        return _rows([(s, freeze(*r)) for s, r in zip(who, replies, strict=True)], REPLY)

    def masks_of(replies: pa.Table) -> list[list[np.ndarray]]:
        """For each order the masks of the shard's distinct bits, bucket by bucket."""
        got = sorted((thaw(x) for x in replies.column("payload").to_pylist()), key=lambda p: int(p[0][0]))
        return [[np.unpackbits(p[2 + 2 * n], count=int(p[1 + 2 * n][0])).astype(bool) for p in got] for n in range(order)]

    def count(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([], BLOCK)
        tidy()
        masks, own, tokens = masks_of(replies), [], 0
        for n, (u, c) in enumerate(distinct(table)):
            tokens = tokens or int(c.sum())
            k = _recurring(u, masks[n], drop)
            own.append((u[k], c[k].astype(np.uint32), _cuts(u[k], buckets)))
        out = []
        for b in range(buckets):
            parts = [x for u, c, cut in own for x in (u[cut[b] : cut[b + 1]], c[cut[b] : cut[b + 1]])]
            out.append((b, table.column("__shard")[0].as_py(), freeze(np.array([tokens], np.int64), *parts)))
        return _rows(out, BLOCK)

    def total_counts(table: pa.Table) -> pa.Table:
        who, parts = table.column("shard").to_pylist(), [thaw(x) for x in table.column("payload").to_pylist()]
        tokens = sum(int(p[0][0]) for p in parts)
        replies = [[np.array([table.column("bucket")[0].as_py(), tokens], np.int64)] for _ in parts]
        for n in range(order):
            h, c = np.concatenate([p[1 + 2 * n] for p in parts]), np.concatenate([p[2 + 2 * n] for p in parts])
            _, inv = np.unique(h, return_inverse=True)
            sums = np.bincount(inv, weights=c)[inv] if len(h) else np.zeros(0)
            at = 0
            for r, p in zip(replies, parts, strict=True):
                r.append(sums[at : at + len(p[1 + 2 * n])])
                at += len(p[1 + 2 * n])
        return _rows([(s, freeze(*r)) for s, r in zip(who, replies, strict=True)], REPLY)

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["n_tokens long", "score double", "log_sum double"])

    def apply(table: pa.Table, replies: pa.Table) -> pa.Table:
        tidy()
        n_rows = table.num_rows
        row, grams = _grams(text_array(table.column(text)), order)
        kind = np.array(replies.column("kind").to_pylist())
        masks = masks_of(replies.filter(pa.array(kind == 0)))
        got = sorted((thaw(x) for x in replies.filter(pa.array(kind == 1)).column("payload").to_pylist()), key=lambda p: int(p[0][0]))
        tokens = int(got[0][0][1]) if got else 0
        counts = []
        for n, g in enumerate(grams):
            u = np.unique(g[g > 0])
            c = np.ones(len(u))
            if len(u):
                c[_recurring(u, masks[n], drop)] = np.concatenate([p[1 + n] for p in got])
            counts.append(np.where(g > 0, c[np.minimum(np.searchsorted(u, g), max(0, len(u) - 1))] if len(u) else 0, 0))
        if len(row):
            logs = np.log(counts[0] / tokens) + np.log(alpha) * (order - 1)
            for n in range(2, order + 1):
                seen = counts[n - 1] >= min_count
                context = np.concatenate([[1], counts[n - 2][:-1]])
                logs = np.where(seen, np.log(np.where(seen, counts[n - 1], 1) / np.maximum(context, 1)) + np.log(alpha) * (order - n), logs)
            sums, n_tok = np.bincount(row, weights=logs, minlength=n_rows), np.bincount(row, minlength=n_rows)
        else:
            sums, n_tok = np.zeros(n_rows), np.zeros(n_rows, np.int64)
        mean = pa.array(np.divide(sums, n_tok, out=np.zeros(n_rows), where=n_tok > 0), mask=n_tok == 0)
        return pa.Table.from_arrays([*[table.column(c) for c in cols], pa.array(n_tok.astype(np.int64)), mean, pa.array(sums)], [*cols, *RESULTS])

    masks = durable(by_shard.applyInArrow(ask, DDL_BLOCK).groupBy("bucket").applyInArrow(answer, DDL_REPLY), "recurring")
    counted = by_shard.cogroup(masks.groupBy("shard")).applyInArrow(count, DDL_BLOCK).groupBy("bucket").applyInArrow(total_counts, DDL_REPLY)
    both = masks.withColumn("kind", F.lit(0)).unionByName(counted.withColumn("kind", F.lit(1)))
    return by_shard.cogroup(both.groupBy("shard")).applyInArrow(apply, ddl)
