"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine, components.

Vectors that are equal are one class. A class gets a code of `bits` signs in each of several tables, and
classes with equal codes meet. They meet in two steps. First the signs of all tables alone are shuffled (a
few dozen bytes a row): a class goes on if it has a partner in its group that differs in few enough signs
(SLACK deviations above the mean at the threshold, which leaves out one true pair in 10**11) and that it
didn't meet in an earlier table. Then the vectors of those that go on are fetched, and cosines are computed
in double precision. A pair that meets in several tables counts in the first one only, so link counts are
sums and no pair is ever stored; groups hand on a spanning star of their links. Large groups are compared in
tiles of TILE rows a side, each tile a task of its own, which keeps every link and bounds every task.

The number of bits grows with the logarithm of the input and the number of tables follows from the
recall wanted at the threshold itself (pairs above it are found more surely still).

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and
are their own component; vectors of different lengths never link; rows with equal ids are vectors of
their own; a cosine equal to the threshold links; rows with a null id link with nothing and have no component; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _and_end, connected_components, durable, local_stars

THRESHOLD = 0.95
RECALL = 0.995
TILE = 2048
SEED = 11
SLACK = 6.7


def shape(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many rows: about 16 rows a code, and `recall` at the threshold."""
    bits = max(8, min(30, math.ceil(math.log2(max(rows, 1) / 16 + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, tile: int = TILE, bits_tables: tuple[int, int] | None = None) -> DataFrame:
    """id_col, n_links, component_id and kept for every row of vectors."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(fine & F.col(f"`{id_col}`").isNotNull(), v).alias("v"))
    # adding 0.0 makes -0.0 and 0.0 one value
    src = src.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    rows = durable(src, "vectors")
    classes = durable(rows.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    bits, tables = bits_tables or shape(classes.count(), threshold, recall)
    signs = bits * tables
    away = math.acos(threshold) / math.pi
    most = signs * away + SLACK * math.sqrt(signs * away * (1 - away))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(2)
            size = np.diff(col.offsets.to_numpy())
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
            at = np.concatenate([[0], np.cumsum(size)])
            code = np.zeros((b.num_rows, tables), np.int64)
            packed = np.zeros((b.num_rows, -(-signs // 8)), np.uint8)
            for d in np.unique(size).tolist():
                if d not in planes:
                    planes[d] = np.random.Generator(np.random.PCG64([SEED, d])).standard_normal((d, signs))
                own = np.flatnonzero(size == d)
                x = flat[at[own][:, None] + np.arange(d)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                sign = (x @ planes[d]) >= 0
                packed[own] = np.packbits(sign, axis=1)
                code[own] = (sign.reshape(len(own), tables, bits) << np.arange(bits)).sum(axis=2) * 65_536 + d % 65_536
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in packed], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, tables), pa.int32()), pa.array(code.ravel())), col], ["node", "n", "signs", "each", "v"])

    coded = durable(classes.select("node", "n", "v").mapInArrow(codes, "node long, n long, signs binary, each array<long>, v array<double>"), "codes")
    dealt = coded.select("node", "signs", F.posexplode("each").alias("t", "code"))
    # large groups are few: a table of its own, whose size lets the planner keep the rows where they are
    large = durable(dealt.groupBy("t", "code").agg(F.count("*").alias("m")).where(F.col("m") > tile), "large")
    tiles = F.coalesce(F.ceil(F.col("m") / F.lit(tile)), F.lit(1)).cast("int")
    dealt = dealt.join(large, ["t", "code"], "left").withColumn("k", tiles).withColumn("c", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    dealt = dealt.withColumn("o", other).select("t", "code", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "node", "signs")
    group = ["t", "code", "i", "j"]

    def each_tile(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
        """run(rows, table, whether both sides are the same) of each group of the sorted rows."""
        rest = None
        for b in _and_end(batches):
            if b is None:
                if rest is None:
                    return
                now, rest, last = rest, None, True
            elif not b.num_rows:
                continue
            else:
                t = pa.Table.from_batches([b])
                now, last = (t if rest is None else pa.concat_tables([rest, t])), False
            key = np.stack([now.column(c).to_numpy().astype(np.int64) for c in range(4)])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            end = now.num_rows
            if not last:
                if not len(cut):
                    rest = now
                    continue
                cut, end = cut[:-1], int(cut[-1])
                rest = now.slice(end)
            edge = np.concatenate([[0], cut, [end]])
            for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if z - a > 1:
                    got = run(now.slice(a, z - a), int(key[0, a]), bool(key[2, a] == key[3, a]))
                    if got is not None:
                        yield got

    def sides(side: np.ndarray, square: bool) -> tuple[np.ndarray, np.ndarray]:
        left = np.arange(len(side)) if square else np.flatnonzero(side == side.min())
        return left, left if square else np.flatnonzero(side != side.min())

    def sign_table(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(signs, codes in each table) of some rows."""
        flat = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1, count=signs)
        return flat, (flat.reshape(len(packed), tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)

    def first_met(code: np.ndarray, t: int, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that don't meet in a table before t."""
        for e in range(t):
            ok = code[p, e] != code[q, e]
            p, q = p[ok], q[ok]
        return p, q

    def close(rows: pa.Table, t: int, square: bool) -> pa.RecordBatch | None:
        side = rows.column(4).to_numpy()
        left, right = sides(side, square)
        if not len(right):
            return None
        flat, code = sign_table(rows.column(6).to_pylist())
        x = flat.astype(np.float32) * 2 - 1
        hit = np.zeros(len(side), bool)
        for i in range(0, len(left), 256):
            a = left[i : i + 256]
            p, q = np.nonzero(x[a] @ x[right].T >= signs - 2 * most)
            p, q = a[p], right[q]
            ok = p < q if square else np.ones(len(p), bool)
            p, q = first_met(code, t, p[ok], q[ok])
            hit[p] = hit[q] = True
        if not hit.any():
            return None
        kept = rows.select([0, 1, 2, 3, 4, 5]).filter(pa.array(hit)).combine_chunks()
        return kept.to_batches()[0]

    def compare(rows: pa.Table, t: int, square: bool) -> pa.RecordBatch | None:
        side, n, node = (rows.column(c).to_numpy() for c in (4, 5, 6))
        left, right = sides(side, square)
        if not len(right):
            return None
        code = sign_table(rows.column(7).to_pylist())[1]
        x = pa.concat_arrays(rows.column(8).chunks).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(n), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        links, us, vs = np.zeros(len(n), np.int64), [], []
        for i in range(0, len(left), 256):
            a = left[i : i + 256]
            p, q = np.nonzero(x[a] @ x[right].T >= threshold)
            p, q = a[p], right[q]
            ok = p < q if square else np.ones(len(p), bool)
            p, q = first_met(code, t, p[ok], q[ok])
            np.add.at(links, p, n[q])
            np.add.at(links, q, n[p])
            if len(p):
                u, r = local_stars(node[p], node[q])
                us.append(u[u != r]), vs.append(r[u != r])
        hit = np.flatnonzero(links)
        if not len(hit):
            return None
        if us:
            u, r = local_stars(np.concatenate(us), np.concatenate(vs))
            root = dict(zip(u.tolist(), r.tolist(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array([root[x] for x in node[hit].tolist()], pa.int64())], ["node", "links", "root"])

    met = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda b: each_tile(b, close), "t int, code long, i int, j int, c int, node long")
    met = durable(met, "met")
    held = met.join(coded.select("node", "n", "signs", "v"), "node").select(*group, "c", "n", "node", "signs", "v")
    found = durable(held.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda b: each_tile(b, compare), "node long, links long, root long"), "links")
    comp = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = classes.select("h1", "h2", "node", "n").join(counts, "node", "left").join(comp, "node", "left")
    label = label.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.withColumn("ok", F.col("v").isNotNull()).drop("v").join(label.withColumn("ok", F.lit(True)), ["h1", "h2", "ok"], "left")
    comp_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(False)).alias("kept"))
