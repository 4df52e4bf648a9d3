"""Toxicity: a counterfactual-regularised classifier.

A text is the set of features of its words: the word, its beginnings and its ends of 3 to 6 letters. Features
that go with the label (by the likelihood ratio) enter a logistic model. For every labelled text a
counterfactual is made: its identity terms are swapped for others, or, where it has none, a neutral
mention of one is added. The model is fitted to the labels and, at the same time, penalised for the squared change of the
score's logit between a text and its counterfactual, so that naming a group moves no score.

The fit sees a bounded sample of labelled rows; every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, row_wise, staged

#: Identity terms by group; a term is swapped for others of its group.
IDENTITY = (
    ("women", "men", "girls", "boys", "mujeres", "hombres", "femmes", "hommes", "frauen", "männer"),
    ("woman", "man", "girl", "boy", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    ("black", "white", "asian", "latino", "latina", "hispanic", "african", "european", "arab", "indigenous"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer", "heterosexual", "homosexual"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "citizens"),
    ("old", "young", "elderly", "disabled", "blind", "deaf"),
    ("mexican", "chinese", "indian", "german", "french", "spanish", "american", "russian", "turkish", "polish"),
)
_GROUP = {w: g for g in IDENTITY for w in g}
_ALL = [w for g in IDENTITY for w in g]
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Fit:
    """rows: labelled rows of each label that the fit sees at most. ratio: least likelihood ratio (G) of a feature; lift: how many times
    as often at least it is in texts of label 1: all features of both enter. decay: weight of the squared weights; fairness: of the squared changes of the logit."""

    rows: int = 5000
    ratio: float = 20.0
    lift: float = 10.0
    decay: float = 3e-5
    fairness: float = 1.0
    steps: int = 400


def word_features(word: str) -> list[int]:
    out = [zlib.crc32(("=" + word).encode("utf-8", "surrogatepass"))]
    for k in range(3, 7):
        if len(word) > k:
            out.append(zlib.crc32(("<" + word[:k]).encode("utf-8", "surrogatepass")))
            out.append(zlib.crc32((">" + word[-k:]).encode("utf-8", "surrogatepass")))
    return out


class Reader:
    """Token -> features that ``among`` has (all, if None), remembered for up to so many tokens."""

    def __init__(self, among: dict[int, int] | None = None, most: int = 300_000):
        self.among, self.most, self.seen = among, most, {}

    def token(self, token: str) -> tuple[int, ...]:
        out = {f for w in _WORD.findall(token) for f in word_features(w)}
        out = tuple(out) if self.among is None else tuple(self.among[f] for f in out if f in self.among)
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen[token] = out
        return out

    def text(self, text: str | None) -> set[int]:
        out: set[int] = set()
        seen = self.seen
        for t in set(text.lower().split()) if text else ():
            f = seen.get(t)
            if f is None:
                f = self.token(t)
            if f:
                out.update(f)
        return out


def counterfactual(text: str | None, salt: int) -> str:
    """The text, lowered, with each identity term swapped for the next of its group, or one mention added if there is none."""
    words = (text or "").lower().split()
    swapped = False
    for i, t in enumerate(words):
        for w in _WORD.findall(t):
            if w in _GROUP:
                g = _GROUP[w]
                words[i] = t.replace(w, g[(g.index(w) + 1 + salt % (len(g) - 1)) % len(g)])
                swapped = True
    if not swapped:
        words.append(_ALL[salt % len(_ALL)])
    return " ".join(words)


def sample(docs: DataFrame, labels: DataFrame, fit: Fit, doc_id: str, text: str, label: str) -> DataFrame:
    """(id, text, y): labelled rows, at most about fit.rows of each label, chosen by a hash of the id. A doc_id with several labels counts by its largest."""
    y = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in y.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("y") > 0, min(1.0, fit.rows / max(1, counts.get(1, 0)))).otherwise(min(1.0, fit.rows / max(1, counts.get(0, 0))))
    chosen = y.where(F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53) < share)
    return docs.select(docs[doc_id].alias("id"), docs[text].alias("text")).join(F.broadcast(chosen), "id")  # about 2 * fit.rows small rows


def _count(texts: DataFrame) -> DataFrame:
    """texts (text, y) -> (feature, a, b): in how many texts of label 1 and of others each feature is, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = Reader(), (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            both = list(n[0].keys() | n[1].keys())
            out = [pa.array([c[f] for f in both], pa.int64()) for c in n]
            for c in n:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(both, pa.int64()), *out], ["feature", "a", "b"])

        for batch in batches:
            for t, y in zip(*(c.to_pylist() for c in batch.columns)):
                n[y <= 0].update(reader.text(t))
                if len(n[0]) + len(n[1]) > 2_000_000:  # bounds a task's memory; the sums meet after the shuffle
                    yield flush()
        if n[0] or n[1]:
            yield flush()

    return texts.select("text", "y").mapInArrow(run, "feature long, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


@dataclass(frozen=True)
class Model:
    index: dict[int, int]
    weights: np.ndarray
    bias: float

    def score(self, features: set[int]) -> float:
        z = self.bias + float(self.weights[list(features)].sum()) if features else self.bias
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def select_features(counts: DataFrame, n1: int, n0: int, fit: Fit) -> DataFrame:
    """counts (feature, a, b), of n1 texts of label 1 and n0 others -> (feature, g): those with a likelihood ratio g >= fit.ratio and the lift, where they are at hand in two texts of label 1 at least."""

    def like(k, n: int, q):
        return F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(F.lit(n) - k > 0, (F.lit(n) - k) * F.log(1 - q)).otherwise(0.0)

    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    p, p1, p0 = (a + b) / (n1 + n0), a / n1, b / n0
    g = 2 * (like(a, n1, p1) + like(b, n0, p0) - like(a, n1, p) - like(b, n0, p))
    return counts.where((F.col("a") > 1) & (a * n0 > fit.lift * (b + 0.3) * n1)).select("feature", g.alias("g")).where(F.col("g") > min(6.0, fit.ratio))


def train(rows: list[tuple[int, list[int], list[int]]], index: dict[int, int], fit: Fit) -> Model:
    """rows: (label, features, the counterfactual's features). Full gradients, with momentum by Adam; both labels weigh the same."""
    m = len(index)
    y = np.array([r[0] for r in rows], float)
    w, b = np.zeros(m), 0.0
    if not rows or not m or not 0 < y.sum() < len(y):
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
        return Model(index, w, math.log(p / (1 - p)))

    def flat(k: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(r[k]) for r in rows])
        return np.repeat(np.arange(len(rows)), n), np.array([f for r in rows for f in r[k]], np.int64)

    (r1, f1), (r2, f2) = flat(1), flat(2)
    n = len(rows)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    m1 = m2 = np.zeros(m + 1)
    for t in range(1, fit.steps + 1):
        z = np.bincount(r1, w[f1], n)
        gap = z - np.bincount(r2, w[f2], n)
        d = weight * (1 / (1 + np.exp(-np.clip(z + b, -500, 500))) - y)
        c = 2 * fit.fairness * gap / n
        g = np.bincount(f1, (d + c)[r1], m) - np.bincount(f2, c[r2], m) + 2 * fit.decay * w
        g = np.append(g, d.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return Model(index, w, float(b))


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of the features that tell the labels apart (if none reaches fit.ratio, of those that come next). Without rows of both labels it scores all texts alike."""
    seen = staged(sample(docs, labels, fit, doc_id, text, label), "labelled")
    counts = {r.y: r.n for r in seen.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    # Of a bounded sample, and far fewer than the features of its texts: the model.
    found = sorted((-r.g, r.feature) for r in select_features(_count(seen), n1, n0, fit).collect()) if n1 and n0 else []
    good = [f for g, f in found if -g >= fit.ratio] or [f for _, f in found]
    index = {f: i for i, f in enumerate(good)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(index)
        for b in batches:
            out = [(int(y > 0), sorted(reader.text(t)), sorted(reader.text(counterfactual(t, zlib.crc32(str(i).encode()))))) for i, t, y in zip(*(c.to_pylist() for c in b.columns))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["y", "f", "g"])

    rows = [(r.y, r.f, r.g) for r in seen.select("id", "text", "y").mapInArrow(run, "y int, f array<int>, g array<int>").collect()] if index else []  # at most about 2 * fit.rows
    discard(seen)
    rows.sort()
    return train(rows, index, fit)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row (default: all but the text), with score (0 to 1).

    Null and empty texts have no features and get the model's base score. Repeated rows get equal scores;
    an empty table gives an empty result. A kept column called score gives way.
    """
    made: list[Reader] = []  # one for each task

    def scored(texts: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Reader(model.index))
        return [pa.array([model.score(made[0].text(t.as_py())) for t in texts], pa.float64())]

    return row_wise(docs, text, keep, "score double", scored)
