"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over all texts.
2. Spans that a channel may have altered (look-alike digits and symbols among or beside letters, letters set
   apart by spaces or dots, letters repeated three times or more) become lattices: every character
   offers the letters it may stand for, at a cost, and itself; Viterbi search under the character
   model picks the reading. Other text has one reading and stays as it is.
3. Restored texts are scored: a lexicon of words and word beginnings that mark toxic documents is
   learned from labelled rows, and a logistic regression weighs how many of a document's words it
   holds, how surely and how densely.

Fitting uses a bounded sample of labelled rows (labelled.SAMPLE); the character model uses every row.

Cases: null texts are empty and take the score of a text without marks; without labelled rows of
both kinds every score is 0; very long texts are read and scored whole; of equally likely readings of a
span the first in the order of the alphabet is taken, and equal texts have equal scores; repeated rows and
ids are scored row by row; a null id isn't held out; an empty table gives an empty result; columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bare, durable, tidied, without
from .labelled import SAMPLE, remainder, sample

HELD_OUT = (3, 1)
THRESHOLD = 0.7
#: What look-alike characters may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
#: Negative logarithms of the channel: a look-alike, a symbol meant as such, a dropped separator, a
#: separator meant as such, a lengthened letter, a letter meant to be repeated that often.
COST_ALIKE, COST_SYMBOL, COST_DROP, COST_SPACE, COST_LONGER, COST_RUN = 0.7, 8.0, 0.5, 4.0, 0.5, 6.0
#: A lexicon entry marks this many labelled toxic documents at least, by this log ratio at least.
LEAST_DOCS, LEAST_RATIO = 4, 3.0
BEGINNINGS = (3, 4, 5, 6)
KNOWN = 150_000
CLASSES = 28
RESULTS = ("held_out", "score", "predicted")

_L, _S = r"[^\W\d_]", r"[0-9@$!|+]"
_GAP = r"[ .\-_*~]"
#: What a letter may start: look-alikes before a letter or an end, a lengthened letter, spaced letters; then what a symbol may start.
_SUSPECT = re.compile(
    rf"({_L})(?:{_S}+{_L}|[0-9@$]+(?!\w)|\1\1|(?<![^\W_]{_L}){_GAP}(?:{_L}|{_S}){_GAP}(?:{_L}|{_S})(?![^\W_]))"
    rf"|(?<!\S){_S}+{_L}|(?<![^\W_]){_S}{_GAP}(?:{_L}|{_S}){_GAP}(?:{_L}|{_S})(?![^\W_])"
)
_SPACED = re.compile(rf"(?:{_L}|{_S})(?:{_GAP}(?:{_L}|{_S})(?![^\W_]))+")
_TOKEN = re.compile(r"\S+")
#: Up to the last character that may end a word.
_UPTO = re.compile(r".*[\w@$]", re.S)


def _class_table() -> np.ndarray:
    t = np.array([27 if chr(i).isalpha() else 0 for i in range(0x3000)], np.int64)
    t[97:123] = np.arange(1, 27)
    return t


_CLASS = _class_table()


def char_class(c: str) -> int:
    return int(_CLASS[ord(c)]) if ord(c) < len(_CLASS) else 27 if c.isalpha() else 0


def trigrams(texts: list[str | None]) -> np.ndarray:
    """Counts of three character classes in a row (0 ends words), as one array."""
    flat = "\n\n" + "\n\n".join((t or "").lower() for t in texts) + "\n\n"
    code = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
    c = np.where(code < len(_CLASS), _CLASS[np.minimum(code, len(_CLASS) - 1)], 27)
    return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


def character_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """-log P(third | first two) for every three classes, from all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for b in batches:
            rows = b.column(0).to_pylist()
            for i in range(0, len(rows), 500):
                total += trigrams(rows[i : i + 500])
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["k", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(tidied(count), "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # at most CLASSES**3
    n = np.zeros(CLASSES**3)
    for r in rows:
        n[r.k] = r.n
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    pair = n.sum(axis=0)
    back = (pair + 0.5) / (pair + 0.5).sum(axis=1, keepdims=True)
    return -np.log((n + 2.0 * back[None]) / (n.sum(axis=2, keepdims=True) + 2.0))


def readings(span: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """The lattice: for each place the strings it may stand for and their costs."""
    out, i = [], 0
    while i < len(span):
        c = span[i]
        j = i + 1
        while c.isalpha() and j < len(span) and span[j] == c:
            j += 1
        alike = LOOKALIKES.get(c)
        if c.isalpha() and j - i >= 3:
            out.append([(c, COST_LONGER), (c + c, COST_LONGER), (c * (j - i), COST_RUN)])
            i = j
            continue
        if alike:
            out.append([(x, COST_ALIKE * len(alike)) for x in alike] + [(c, COST_SYMBOL)])
        elif spaced and c in " .-_*~":
            out.append([("", COST_DROP), (" ", COST_SPACE)])
        else:
            out.append([(c, 0.0)])
        i += 1
    return out


def decode(span: str, model: np.ndarray, spaced: bool = False) -> str:
    """The likeliest reading of a span (Viterbi over the last two character classes)."""
    best: dict[tuple[int, int], tuple[float, tuple | None, str]] = {(0, 0): (0.0, None, "")}
    for options in readings(span.lower(), spaced):
        new: dict[tuple[int, int], tuple[float, tuple | None, str]] = {}
        for (a, b), state in best.items():
            for s, cost in options:
                x, y, total = a, b, state[0] + cost
                for c in s:
                    k = char_class(c)
                    total += float(model[x, y, k])
                    x, y = y, k
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, state, s)
        best = new
    least = min(v[0] + float(model[a, b, 0]) for (a, b), v in best.items())
    return min(_read(v) for (a, b), v in best.items() if v[0] + float(model[a, b, 0]) == least)


def _read(state: tuple | None) -> str:
    out = []
    while state is not None:
        out.append(state[2])
        state = state[1]
    return "".join(reversed(out))


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def __call__(self, text: str) -> str:
        """The text with suspect spans replaced by their readings."""
        m = _SUSPECT.search(text)
        if not m:
            return text
        out, at = [], 0
        while m:
            spaced = _SPACED.match(text, m.start()) if m.end() - m.start() >= 5 and not m.group(0)[1].isalnum() else None
            if spaced:
                a, z = spaced.span()
            else:
                a = max(at, text.rfind(" ", at, m.start()) + 1, text.rfind("\n", at, m.start()) + 1, text.rfind("\t", at, m.start()) + 1)
                z = _TOKEN.match(text, m.start()).end() if not text[m.start()].isspace() else m.end()
                body = _UPTO.match(text, a, z)
                z = max(m.end(), body.end() if body else a)
            span = text[a:z]
            key = (span, spaced is not None)
            got = self.known.get(key)
            if got is None:
                if len(self.known) > KNOWN:
                    self.known.clear()
                got = self.known[key] = decode(span, self.model, spaced is not None)
            out += [text[at:a], got]
            at = z
            m = _SUSPECT.search(text, z)
        return "".join([*out, text[at:]])


def marks(token: str) -> tuple[str, ...]:
    """A token's word and its beginnings (marked ^)."""
    w = bare(token)
    return (w, *("^" + w[:k] for k in BEGINNINGS if len(w) > k)) if w else ()


@dataclass
class Model:
    characters: np.ndarray
    n_toxic: int = 0
    n_clean: int = 0
    lexicon: dict[str, tuple[int, int]] = field(default_factory=dict)
    weights: np.ndarray | None = None

    def ratio(self, toxic: float, clean: float) -> float:
        return math.log((toxic + 0.5) / (self.n_toxic + 1)) - math.log((clean + 0.5) / (self.n_clean + 1))


class Known(dict):
    """Whether tokens bear a mark, worked out when first asked; of so many tokens at most."""

    def __init__(self, scorer: Scorer):
        self.scorer = scorer

    def __missing__(self, token: str) -> bool:
        if len(self) >= KNOWN:
            self.clear()
        got = self[token] = self.scorer.evidence(token) > 0
        return got


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, Known(self)
        self.heads = {f.removeprefix("^")[: BEGINNINGS[0]] for f in model.lexicon}

    def evidence(self, token: str, own: int | None = None) -> float:
        """The strongest mark of a token; own: the label of the document, which then doesn't count."""
        best = 0.0
        if bare(token)[: BEGINNINGS[0]] not in self.heads:
            return best
        for f in marks(token):
            got = self.model.lexicon.get(f)
            if got:
                a, b = got[0] - (own == 1), got[1] - (own == 0)
                if a >= LEAST_DOCS - 1:
                    best = max(best, self.model.ratio(a, b))
        return best if best >= LEAST_RATIO - 0.5 else 0.0

    def stats(self, text: str, own: int | None = None) -> tuple[float, ...]:
        tokens = list(set(text.split()))
        hits: dict[str, float] = {}
        for t in compress(tokens, map(self.known.__getitem__, tokens)):
            x = self.evidence(t, own)
            if x:
                w = bare(t)
                hits[w] = max(hits.get(w, 0.0), x)
        total = sum(hits.values())
        return 1.0, math.log1p(total), min(len(hits), 5.0), max(hits.values(), default=0.0), len(hits) / max(1, len(tokens))

    def __call__(self, text: str) -> float:
        if self.model.weights is None:
            return 0.0
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, float(np.dot(self.stats(text), self.model.weights))))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", id_col: str = "doc_id", limit: int = SAMPLE) -> Model:
    model = Model(character_model(docs, text))
    characters = model.characters

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(characters)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([r(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], ["text", "y"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            n: dict[str, list[int]] = {}
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own: set[str] = set()
                for w in set(t.split()):
                    got = known.get(w)
                    if got is None:
                        if len(known) > KNOWN:
                            known.clear()
                        got = known[w] = marks(w)
                    own.update(got)
                for f in own:
                    n.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array([v[1] for v in n.values()], pa.int64()), pa.array([v[0] for v in n.values()], pa.int64())], ["mark", "toxic", "clean"])

    rows = durable(sample(docs, labels, label, *HELD_OUT, text, id_col, limit).mapInArrow(tidied(restore), "text string, y int"), "toxic")
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    model.n_clean, model.n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not model.n_clean or not model.n_toxic:
        return model
    ratio = F.log((F.col("toxic") + 0.5) / (model.n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (model.n_clean + 1))
    found = rows.mapInArrow(tidied(count), "mark string, toxic long, clean long").groupBy("mark").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    model.lexicon = {r.mark: (r.toxic, r.clean) for r in found.where((F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO)).collect()}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            x = np.array([s.stats(t, y) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(1, 5)] + [b.column(1)], ["a", "b", "c", "d", "y"])

    got = np.array([tuple(r) for r in rows.mapInArrow(weigh, "a double, b double, c double, d double, y int").collect()])  # at most `limit` rows
    got = got[np.lexsort(got.T)]
    model.weights = _logistic(np.column_stack([np.ones(len(got)), got[:, :4]]), got[:, 4])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, keep_restored: bool = False) -> DataFrame:
    """docs plus held_out, score, predicted and, with keep_restored, restored (the text that was scored)."""
    base = without(docs, *RESULTS, "restored")
    where = base.columns.index(text)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema] + ["restored string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, judge = Restorer(model.characters), Scorer(model)
        for b in batches:
            texts = [restore(t or "") for t in b.column(where).to_pylist()]
            new = pa.array(texts if keep_restored else [None] * len(texts), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, new, pa.array([judge(t) for t in texts], pa.float64())], [*b.schema.names, "restored", "score"])

    out = base.mapInArrow(tidied(run), ddl)
    held = F.coalesce(remainder(id_col, HELD_OUT[0]) == HELD_OUT[1], F.lit(False))
    cols = [F.col(f"`{c}`") for c in base.columns] + ([F.col("restored")] if keep_restored else [])
    return out.select(*cols, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
