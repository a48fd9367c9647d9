"""Quality classifier: naive Bayes support vectors.

Documents are sets of hashed n-grams: their words, and runs of one to four word shapes (letter case,
digits, punctuation, whether the word repeats the one before). The indicator of an n-gram is scaled
by the logarithm of its count ratio between the classes; a linear hinge-loss model is fitted by dual
coordinate descent and drawn towards its mean weight, and a logistic curve turns margins into scores.

Fitting uses a bounded sample of labelled rows (labelled.SAMPLE), whose n-gram numbers one executor task
holds while it fits; only the weights come to the driver. Every row is scored whole.

Cases: null texts are empty; texts without words have no n-grams and take the score of the bias; very long
texts and words are read to their end; equal texts have equal scores, and the order of training rows with
equal n-grams doesn't matter; without labelled rows of both kinds every score is 0.5; repeated rows and ids are scored row by row;
a null id isn't held out; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, tidied, without
from .labelled import SAMPLE, remainder, sample

HELD_OUT = (5, 0)
THRESHOLD = 0.3
BITS = 18
SHAPES = 4
SMOOTH = 1.0
PENALTY = 1.0
#: Share of a weight that is its own; the rest is the mean weight.
OWN = 0.25
PASSES = 12
KNOWN = 150_000
RESULTS = ("held_out", "score", "predicted")
_RUNS = re.compile(r"(.)\1{3,}")


def shape(token: bytes) -> str:
    """A token with its letters and digits folded and runs cut to three."""
    t = token.decode("utf-8", "replace")
    out = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in t)
    return _RUNS.sub(r"\1\1\1", re.sub(r"([Aa0])\1+", r"\1", out))


class _Codes(dict):
    """Raw token -> (word code, shape code)."""

    def __missing__(self, token: bytes) -> tuple[int, int]:
        if len(self) > KNOWN:
            self.clear()
        self[token] = got = zlib.crc32(token.lower()), zlib.crc32(shape(token).encode()) | 1
        return got


def ngrams(text: str | None, codes: _Codes) -> np.ndarray:
    """Sorted distinct n-gram numbers below 2**BITS."""
    tokens = (text or "").encode().split()
    if not tokens:
        return np.zeros(0, np.int32)
    both = np.array(list(map(codes.__getitem__, tokens)), np.uint64)
    word, own = both[:, 0], both[:, 1]
    own[1:][word[1:] == word[:-1]] = 2  # it repeats the word before
    parts = [mix(np.unique(word))]
    run = np.zeros(len(own), np.uint64)
    for n in range(1, min(SHAPES, len(own)) + 1):
        run = mix(run[: len(own) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + own[n - 1 :])
        parts.append(np.unique(run + np.uint64(n)))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray | None = None  # of indicators, ratios included
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, grams: np.ndarray) -> float:
        return float(self.weights[grams].sum()) / max(1.0, float(np.sqrt(len(grams)))) + self.bias


def dual_coordinate_descent(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = PASSES, seed: int = 1) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + sum cost_i max(0, 1 - y_i (w.x_i + b)); x_i has values[j]/sqrt(n_i) at each j of rows[i] and 1 for the bias."""
    w, b, rng = np.zeros(len(values)), 0.0, np.random.Generator(np.random.PCG64(seed))
    alpha = np.zeros(len(rows))
    root = [max(1.0, float(np.sqrt(len(r)))) for r in rows]
    norm = np.array([float(values[r] @ values[r]) / k**2 + 1.0 for r, k in zip(rows, root, strict=True)])
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x = values[rows[i]] / root[i]
            g = y[i] * (float(w[rows[i]] @ x) + b) - 1.0
            step = min(max(alpha[i] - g / norm[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[rows[i]] += step * y[i] * x
                b += step * y[i]
                worst = max(worst, abs(step))
        if worst < 1e-4:
            break
    return w, b


def train(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """rows: sorted n-gram numbers of each document; y: 1 or 0."""
    y = np.asarray(y)
    if not (y == 1).any() or not (y == 0).any():
        return Model()
    size = 1 << BITS
    count = lambda k: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == k] or [np.zeros(0, np.int32)]), minlength=size) + SMOOTH
    p, q = count(1), count(0)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    half = np.arange(len(rows)) % 4 == 0  # these set the curve; then all of them the weights
    part = np.flatnonzero(~half) if len(rows) >= 40 else np.arange(len(rows))
    test = np.flatnonzero(half) if len(rows) >= 40 else part

    def model(own) -> Model:
        w, b = dual_coordinate_descent([rows[i] for i in own], ratio, sign[own], PENALTY * share[own])
        w = OWN * w + (1 - OWN) * np.abs(w).mean()
        return Model(w * ratio, b)

    m = model(part)
    z = np.array([m.margin(rows[i]) for i in test])
    t = y[test].astype(float)
    a = np.zeros(2)
    x = np.column_stack([np.ones(len(z)), z])
    for _ in range(60):
        f = 1 / (1 + np.exp(-np.clip(x @ a, -500, 500)))
        h = (x * (f * (1 - f) + 1e-9)[:, None]).T @ x + 1e-2 * np.eye(2)
        a += np.linalg.solve(h, x.T @ (t - f) - 1e-2 * a)
    full = model(np.arange(len(rows)))
    full.shift, full.slope = float(a[0]), float(a[1])
    return full


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", limit: int = SAMPLE) -> Model:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([ngrams(t, codes).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["grams", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            rows += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        rows.sort(key=lambda r: (zlib.crc32(r[0]), r[0], r[1]))
        m = train([np.frombuffer(g, np.int32) for g, _ in rows], np.array([y for _, y in rows], int))
        yield pa.RecordBatch.from_arrays([pa.array([None if m.weights is None else m.weights.tobytes()], pa.binary()), *[pa.array([x], pa.float64()) for x in (m.bias, m.slope, m.shift)]], ["weights", "bias", "slope", "shift"])

    rows = sample(docs, labels, label, *HELD_OUT, text, id_col, limit).mapInArrow(tidied(extract), "grams binary, y int")
    # at most `limit` rows meet in one task
    got = rows.repartition(1).mapInArrow(tidied(learn), "weights binary, bias double, slope double, shift double").first()
    return Model(None if got is None or got.weights is None else np.frombuffer(bytes(got.weights)), *((got.bias, got.slope, got.shift) if got else ()))


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """docs plus held_out, score and predicted."""
    base = without(docs, *RESULTS)
    where = base.columns.index(text)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            if model.weights is None:
                s = np.full(b.num_rows, 0.5)
            else:
                z = np.array([model.margin(ngrams(t, codes)) for t in b.column(where).to_pylist()], float)
                s = 1 / (1 + np.exp(-np.clip(model.shift + model.slope * z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s)], [*b.schema.names, "score"])

    out = base.mapInArrow(tidied(run), ddl)
    held = F.coalesce(remainder(id_col, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
