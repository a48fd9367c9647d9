"""Best-fit packing of documents into fixed-length training sequences.

Texts are tokenized where they lie; documents longer than a sequence are cut, the first piece taking
the remainder. A piece of n tokens weighs (n tokens, 1 document, n^2 attention cost), and a bin has
a capacity of each. Weights depend on the length alone, so the bins are chosen on the histogram of
lengths: pieces in order of decreasing length, each going to the feasible bin with the best score
(smallest weighted norm of what is left, or largest weighted dot product of piece and residual).
Bins in the same state are handled together as one run, so the driver's work depends on the
sequence length and not on the corpus; pieces find their bin by their rank among equal lengths.

Cases: null text is empty text (one end token); very long texts are tokenized in slices and cut into as
many pieces as they need, runs of whitespace of any length included; repeated rows and ids are packed row by row; of bins with equal scores the one opened for the
longest pieces is taken, and pieces of equal length go by a hash of their keys and the keys themselves;
an empty table gives an empty result; existing columns named like a result are replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, tidied, without

MAX_TOKENS = 1024
#: As sequences may only be limited by tokens, these are the most that 1024 tokens can hold; callers may set less.
MAX_DOCUMENTS = MAX_TOKENS
MAX_COST = MAX_TOKENS * MAX_TOKENS
END = 2
#: Characters of a text that go through the engine at once (its pattern fails on runs of about a million whitespace characters).
SLICE = 100_000
#: The characters that the tokenizers' pattern takes as whitespace (Unicode White_Space).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BETWEEN = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")
#: Pieces of one length that are ranked together.
RANKED = 65_536
#: Weights of tokens, documents and attention cost in the choice of a bin. With these the number of sequences
#: is that of tokens alone (9,872 at sf0.1, where 9,871 would be full to the last token).
WEIGHTS = (1.0, 0.05, 0.05)
#: A plan of more runs (40 bytes each) is joined as a table instead of being sent to every task.
MAX_RUNS = 2_000_000
_loaded: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as the `tokenizers` library gives them.

    The file's vocabulary is given to a faster BPE engine. Texts of more than SLICE characters go through
    it in slices that begin with a single space between two words, where the split into pieces is alike with
    or without what comes before; runs of SLICE and more whitespace characters, on which the engine's
    pattern fails, are split by rule. Texts that hold one of the file's added tokens go through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        spec = json.load(open(path, encoding="utf-8"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.path, self.library = path, None

    def ids(self, text: str, size: int = SLICE) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(x in text for x in self.added):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= size:
            return np.array(self.engine.encode_ordinary(text), "<u4").tobytes()
        return b"".join(np.array(x, "<u4").tobytes() for x in self._sliced(text, size))

    def _sliced(self, text: str, size: int) -> Iterator[list[int]]:
        at = 0
        for run in re.finditer(f"[{WHITE}]{{{size},}}", text):
            yield from self._words(text, at, run.start(), size)
            at = run.end()
            if at < len(text):  # the last character goes with the next word if it is a space, else it is a piece
                at -= 1
            if at > run.start():
                yield self.engine._encode_single_piece(text[run.start() : at].encode())
            if at < len(text) and text[at] != " ":
                yield self.engine._encode_single_piece(text[at].encode())
                at += 1
        yield from self._words(text, at, len(text), size)

    def _words(self, text: str, at: int, end: int, size: int) -> Iterator[list[int]]:
        while end - at > size and (cut := _BETWEEN.search(text, at + size, end)):
            yield self.engine.encode_ordinary(text[at : cut.start()])
            at = cut.start()
        yield self.engine.encode_ordinary(text[at:end])


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def tokenize(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, end: int = END) -> DataFrame:
    """One row per piece: id_col, piece, start, length and ids (binary: little-endian uint32)."""
    path = tokenizer or default_tokenizer()
    tail = np.array([end], "<u4").tobytes()
    kind = docs.schema[id_col].dataType

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            row, piece, start, ids, size = [], [], [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int32()), pa.array(ids, pa.binary())], ["id", "piece", "start", "length", "ids"])

            for i, t in enumerate(b.column(1).to_pylist()):
                raw = enc.ids(t or "") + tail
                n, at, k = len(raw) // 4, 0, 0
                step = (n - 1) % max_tokens + 1
                while at < n:
                    row.append(i), piece.append(k), start.append(at), ids.append(raw[4 * at : 4 * (at + step)])
                    at, k, step = at + step, k + 1, max_tokens
                size += len(raw)
                if size > 8 << 20:
                    yield flush()
                    row, piece, start, ids, size = [], [], [], [], 0
            if row:
                yield flush()

    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`").cast("string"))
    out = src.mapInArrow(tidied(pieces), f"`{id_col}` {kind.simpleString()}, piece int, start long, length int, ids binary")
    return out


def plan(counts: dict[int, int], max_tokens: int = MAX_TOKENS, max_docs: int = MAX_DOCUMENTS, max_cost: int = MAX_COST, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Runs (length, first rank, count, first sequence, offset): pieces of a length by rank go to consecutive sequences.

    weights: of tokens, documents and attention cost, each as a share of its capacity. rule: "norm"
    takes the bin whose weighted residual after placing is smallest, "dot" the one whose residual
    has the largest weighted dot product with the piece.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    cap = np.array([max_tokens, max_docs, max_cost], np.int64)
    w = np.array(weights, float)
    states: dict[tuple[int, int, int], list[list[int]]] = {}
    keys, residual = [], np.zeros((0, 3), np.int64)
    stale, next_bin, runs = True, 0, []
    for n in sorted(counts, reverse=True):
        item = np.array([n, 1, n * n], np.int64)
        if (item > cap).any():
            raise ValueError(f"a piece of {n} tokens fits no bin")
        left, rank = counts[n], 0
        while left:
            if stale:
                keys = list(states)
                residual = np.array(keys, np.int64).reshape(-1, 3)
                stale = False
            fits = (residual >= item).all(axis=1)
            if fits.any():
                if rule == "norm":
                    score = -((w * ((residual - item) / cap) ** 2).sum(axis=1))
                else:
                    score = (w * (residual / cap) * (item / cap)).sum(axis=1)
                key = keys[int(np.argmax(np.where(fits, score, -np.inf)))]
                bins = states[key]
            else:  # as many new bins as there are pieces, or fewer if a bin takes several of them
                per = int(min(cap // item))
                key, bins = tuple(cap.tolist()), [[next_bin, -(-left // per)]]
                next_bin += bins[0][1]
                states[key] = bins
            then = tuple(int(a - b) for a, b in zip(key, item, strict=True))
            moved: list[list[int]] = []
            while left and bins:
                base, k = bins[-1]
                q = min(left, k)
                runs.append((n, rank, q, base, max_tokens - key[0]))
                moved.append([base, q])
                left, rank = left - q, rank + q
                if q == k:
                    bins.pop()
                else:
                    bins[-1] = [base + q, k - q]
            if not bins:
                del states[key]
            if min(then) > 0:
                states.setdefault(then, []).extend(moved)
            stale = True
    return np.array(runs, np.int64).reshape(-1, 5)


def place(pieces: DataFrame, length: str = "length", keys: tuple[str, ...] = ("doc_id", "piece"), max_runs: int = MAX_RUNS, **capacities) -> DataFrame:
    """pieces plus sequence_id and offset. pieces should be a stored table: it is read twice.

    Ranks among equal lengths are made in groups of about RANKED rows, so no length is a hot key.
    """
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}  # at most max_tokens rows
    runs = plan(histogram, **capacities)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    groups = [(n, -(-c // RANKED)) for n, c in histogram.items()]
    spark = pieces.sparkSession
    out = without(pieces, "sequence_id", "offset")
    cols = out.columns
    sizes = spark.createDataFrame(groups or [(0, 1)], "__n int, __groups int")
    salted = out.join(F.broadcast(sizes), F.col(length) == F.col("__n")).withColumn("__salt", F.pmod(F.xxhash64(*keys), F.col("__groups")))
    per = salted.groupBy("__n", "__salt").count()
    before = per.select("__n", "__salt", (F.sum("count").over(Window.partitionBy("__n").orderBy("__salt")) - F.col("count")).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy("__n", "__salt").orderBy(*keys)) - 1)
    ranked = ranked.join(before, ["__n", "__salt"]).select(*cols, (F.col("__n").cast("long") * F.lit(1 << 44) + F.col("__before") + F.col("__rank")).alias("__code"))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema] + ["sequence_id long", "offset int"]

    def found(code: np.ndarray, plan: np.ndarray) -> list[pa.Array]:
        first = plan[:, 0] << 44 | plan[:, 1]
        at = np.searchsorted(first, code, "right") - 1
        seq, off = (plan[at, 3] + code - first[at], plan[at, 4]) if len(code) else (code, code)
        return [pa.array(seq, pa.int64()), pa.array(off.astype(np.int32), pa.int32())]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found(b.column(b.num_columns - 1).to_numpy(), runs)], [*cols, "sequence_id", "offset"])

    if len(runs) <= max_runs:
        return ranked.mapInArrow(assign, ", ".join(names))

    # as a table: a run belongs to every block of RANKED ranks that it reaches into, a piece to one
    lo, hi = runs[:, 1] // RANKED, (runs[:, 1] + runs[:, 2] - 1) // RANKED
    reach = np.repeat(np.arange(len(runs)), hi - lo + 1)
    block = np.arange(len(reach)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1) + lo[reach]
    own = pa.Table.from_arrays([pa.array(runs[reach, 0] << 28 | block), *[pa.array(runs[reach, k]) for k in range(5)]], ["__block", "n", "first", "count", "base", "at"])
    table = durable(spark.createDataFrame(own), "plan")

    def join(rows: pa.Table, plan: pa.Table) -> pa.Table:
        p = np.column_stack([plan.column(k).to_numpy() for k in range(1, 6)])
        return pa.Table.from_arrays([*[rows.column(c) for c in cols], *found(rows.column("__code").to_numpy(), p[np.argsort(p[:, 1])])], [*cols, "sequence_id", "offset"])

    rank = F.col("__code").bitwiseAND(F.lit((1 << 44) - 1))
    blocks = ranked.withColumn("__block", F.shiftleft(F.shiftright("__code", 44), 28).bitwiseOR(F.floor(rank / RANKED)))
    return blocks.groupBy("__block").cogroup(table.groupBy("__block")).applyInArrow(join, ", ".join(names))


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, keep_ids: bool = True, **capacities) -> DataFrame:
    """Tokenize and place: id_col, piece, start, length, ids_crc32, sequence_id, offset and, with keep_ids, ids."""
    p = tokenize(docs, text, id_col, tokenizer, max_tokens).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        p = p.drop("ids")
    return place(durable(p, "pieces"), keys=(id_col, "piece"), max_tokens=max_tokens, **({"max_docs": max_tokens, "max_cost": max_tokens**2} | capacities))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, length and ids (binary), pieces in order of offset."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "length", F.expr("concat_ws('', transform(parts, p -> hex(p.ids)))").alias("h")).select("sequence_id", "length", F.unhex("h").alias("ids"))
