"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint is described by its Hamming distances to reference fingerprints (pivots):
zero, the 64 single-bit words, and DENSE random words. By the triangle inequality two fingerprints
within `max_bits` differ by at most that much in every distance, so a pair whose largest coordinate
difference is greater is discarded; what survives is verified by the true distance.

Pairs are sought by equi-join, never by comparing all: the distances to zero and to the single-bit
pivots of one block of bits are equal exactly if the block is equal, and with max_bits = 3 at least
three of six blocks are. The 20 choices of three blocks are 20 tables; rows of a table with equal
coordinates meet. Groups of more than GROUP rows are first dealt out again by the coordinates of
their other bits (four blocks, one of which must be equal), so that no task gets a large group and
none is cut. Groups link their members by a spanning star, not by all pairs.

Cases: null and empty texts have fingerprint zero and link like others; rows with a null id get a
fingerprint but neither link nor have a component; repeated ids are one document for each fingerprint
they have, and `keep_first` keeps one of their rows at most; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _and_end, connected_components, durable, keep_one, local_stars, tidied, without

SEED = 42
SHINGLE = 3
MAX_BITS = 3
DENSE = 16
#: Groups with more rows are dealt out again by further bits.
GROUP = 4096
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIVOTS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, DENSE, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    ws = text.translate(LOWER).split()
    if not ws:
        return 0
    flat = b" ".join(ws)
    if len(ws) <= shingle:
        h = [xxhash.xxh64_intdigest(flat, seed)]
    else:
        size = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        digest = xxhash.xxh64_intdigest
        h = [digest(flat[a:b], seed) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    a, ones = np.array(h, np.uint64), np.zeros(64, np.int64)
    for i in range(0, len(a), 1 << 16):
        ones += np.unpackbits(a[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, fp): fp is the unsigned fingerprint in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.encode()) if t else 0 for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], [id_col, "fp"])

    src = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`").cast("string"))
    return src.mapInArrow(tidied(run), f"`{id_col}` long, fp long")


def _pairs(fp: np.ndarray, dense: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs: by coordinate difference, then by true distance. Works in tiles."""
    left, right = [], []
    order = np.argsort(dense[:, 0], kind="stable")
    first = dense[order, 0]
    for i in range(0, len(order), 512):
        a = order[i : i + 512]
        j = int(np.searchsorted(first, first[min(i + 511, len(order) - 1)] + max_bits, "right"))
        for k in range(i, j, 2048):
            b = order[k : min(k + 2048, j)]
            near = np.ones((len(a), len(b)), bool)
            for c in range(dense.shape[1]):
                near &= np.abs(dense[a, c][:, None] - dense[b, c][None, :]) <= max_bits
            x, y = np.nonzero(near)
            x, y = a[x], b[y]
            ok = (x != y) & (np.bitwise_count(fp[x] ^ fp[y]) <= max_bits)
            left.append(x[ok])
            right.append(y[ok])
    return np.concatenate(left), np.concatenate(right)


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [b.tolist() for b in np.array_split(np.array(bits), n)]


def similar_links(classes: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP, blocks: int = 6) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of classes (fp, node) which chains of pairs within max_bits connect."""
    if not 0 < max_bits < blocks:
        raise ValueError("max_bits must be less than the number of blocks")
    parts = _blocks(list(range(64)), blocks)
    tables = [sum((list(parts[i]) for i in c), []) for c in combinations(range(blocks), blocks - max_bits)]

    def table_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for b in batches:
            fp, node = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            if not len(fp):
                continue
            zero = np.bitwise_count(fp).astype(np.int16)
            single = np.bitwise_count(fp[:, None] ^ units[None, :]).astype(np.int16)
            bit = ((zero[:, None] + 1 - single) // 2).astype(np.uint64)  # 1 where the pivot is one nearer than zero
            dense = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.uint8)
            packed = pa.array([x.tobytes() for x in dense], pa.binary())
            for t, own in enumerate(tables):
                key = (bit[:, own] << np.arange(len(own), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), t, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(node), packed], ["t", "key", "fp", "node", "dense"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (t, key): link each run of equal ones, of which the last may go on in the next batch."""
        rest = None
        for b in _and_end(batches):
            if b is None:
                if rest is None:
                    return
                now, rest, last = rest, None, True
            else:
                if not b.num_rows:
                    continue
                t = pa.Table.from_batches([b])
                now, last = (t if rest is None else pa.concat_tables([rest, t])), False
            key = np.stack([now.column(0).to_numpy().astype(np.int64), now.column(1).to_numpy()])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if not last:
                if not len(cut):
                    rest = now
                    continue
                rest = now.slice(int(cut[-1])).combine_chunks()
                cut, end = cut[:-1], int(cut[-1])
            else:
                end = now.num_rows
            edge = np.concatenate([[0], cut, [end]])
            many = np.flatnonzero(np.diff(edge) > 1)
            if not len(many):
                continue
            fp, node = now.column(2).to_numpy().view(np.uint64), now.column(3).to_numpy()
            dense = np.frombuffer(b"".join(now.column(4).to_pylist()), np.uint8).reshape(-1, DENSE).astype(np.int16)
            out_a, out_b = [], []
            for i, j in zip(edge[many].tolist(), edge[many + 1].tolist(), strict=True):
                x, y = _pairs(fp[i:j], dense[i:j], max_bits)
                if len(x):
                    n, root = local_stars(node[i:j][x], node[i:j][y])
                    out_a.append(n[n != root])
                    out_b.append(root[n != root])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    def deal(rows: DataFrame, free: list[list[int]]) -> list[DataFrame]:
        """rows, those of large groups by the coordinates of one more block of their free bits."""
        # a table of its own: as few keys are large, its size lets the planner keep the rows where they are
        large = durable(rows.groupBy("t", "key").count().where(F.col("count") > group).select("t", "key", F.lit(True).alias("large")), "large")
        rows = rows.join(large, ["t", "key"], "left")
        cold = rows.where("large is null").drop("large")
        bits = {t: _blocks(own, max_bits + 1) for t, own in enumerate(free)}
        masks = F.array(*[F.array(*[F.array(*[F.lit(x) for x in b]) for b in bits[t]]) for t in range(len(free))])
        hot = rows.where("large").drop("large").withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(max_bits))))
        own = F.element_at(F.element_at(masks, F.col("t") + 1), F.col("__b") + 1)
        more = F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.getbit(F.col("fp"), x).cast("long"))
        hot = hot.withColumn("key", F.xxhash64("t", "key", "__b", more)).withColumn("t", F.col("t") + F.lit(len(tables)) * (F.col("__b") + 1)).drop("__b")
        return [cold, hot]

    rows = classes.select("fp", "node").mapInArrow(tidied(table_rows), "t int, key long, fp long, node long, dense binary")
    free = [[x for x in range(64) if x not in set(own)] for own in tables]
    dealt = reduce(DataFrame.unionByName, deal(rows, free))
    return dealt.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(tidied(link), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(id_col, fp, component): component is the smallest id that chains of links reach."""
    prints = durable(fingerprints(docs, text, id_col), "fingerprints")
    known = prints.where(F.col(id_col).isNotNull())
    classes = durable(known.groupBy("fp").agg(F.min(id_col).alias("node")), "classes")
    # an id with several fingerprints ties their classes
    same = known.distinct().groupBy(id_col).agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select(id_col)
    tied = known.join(same, id_col, "left_semi").distinct().join(classes, "fp").select(F.col(id_col).alias("a"), F.col("node").alias("b")).where("a <> b")
    links = similar_links(classes, max_bits, group).unionByName(tied)
    comp = connected_components(links)
    label = classes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = prints.join(label, "fp", "left")
    return out.select(id_col, "fp", F.when(F.col(id_col).isNotNull(), F.col("component")).alias("component"))


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """One row of each group: of the document with the smallest id, the row that `keep_one` takes. Rows with a null id stay."""
    return keep_one(docs, near_duplicates(docs, text, id_col, **how), id_col)


def report(docs: DataFrame, text: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """docs with fingerprint (16 hexadecimal digits) and component_id."""
    near = near_duplicates(docs, text, id_col, **how)
    return without(near, "fingerprint", "component_id").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
