"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at training quantiles. Boosting goes round the features: a shallow tree on one feature's
bins is fitted to the gradient and added, shrunk, to this feature's table. Then pairs are ranked by what a tree on
a coarse grid of both still explains, and the best few get tables of their own in the same way. A score is the sum of
table entries: binning and look-ups, vectorised over a batch.

Training reads at most MAX_TRAIN labelled rows, those with the smallest hash of the id (a documented bound; with fewer
labelled rows all are used). Everything is scored.

Defined cases: a null or empty text has features 0 and gets a score; documents whose labels contradict each other,
or are null, don't train; without labelled rows of both kinds the score is the smoothed share of label 1; repeated
rows get equal scores; an empty table gives an empty result; features come from the text alone.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sieve, textstats
from .base import keep

MAX_TRAIN = 40_000
BINS, COARSE = 64, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
RATE, DEPTH, RIDGE, LEAST_HESSIAN = 0.1, 2, 1.0, 2.0


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Step function over ordered bins: the Newton value of each leaf of a greedy tree."""
    out = np.full(len(g), g.sum() / (h.sum() + RIDGE))
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE), -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > g.sum() ** 2 / (h.sum() + RIDGE) + 1e-9:
            out[: at + 1] = _tree(g[: at + 1], h[: at + 1], depth - 1)
            out[at + 1 :] = _tree(g[at + 1 :], h[at + 1 :], depth - 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best cut of both axes of a grid: its gain, and the Newton value of each of the four parts."""
    cg, ch = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    parts = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    pg, ph = parts(cg), parts(ch)
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(pg, ph, strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(pg, ph, strict=True)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


@dataclass
class Model:
    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def coarse(self, b: np.ndarray, j: int) -> np.ndarray:
        return b * COARSE // (len(self.edges[j]) + 1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.bias)
        for j, t in enumerate(self.tables):
            out += t[b[j]]
        for (i, j), t in zip(self.pairs, self.grids, strict=True):
            out += t[self.coarse(b[i], i), self.coarse(b[j], j)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    prior = (y.sum() + 1) / (len(y) + 2)
    m = Model(bias=float(np.log(prior / (1 - prior))))
    if not len(y) or y.min() == y.max():
        return m
    m.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    b = m.bins(x)
    out = np.full(len(y), m.bias)
    for _ in range(ROUNDS):
        for j, t in enumerate(m.tables):
            p = 1 / (1 + np.exp(-out))
            step = RATE * _tree(np.bincount(b[j], y - p, len(t)), np.bincount(b[j], p * (1 - p), len(t)), DEPTH)
            t += step
            out += step[b[j]]
    c = [m.coarse(b[j], j) for j in range(x.shape[1])]
    cell = lambda i, j: c[i] * COARSE + c[j]

    def hists(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-out))
        return tuple(np.bincount(cell(i, j), w, COARSE * COARSE).reshape(COARSE, COARSE) for w in (y - p, p * (1 - p)))  # type: ignore[return-value]

    ranked = sorted(((-_quadrants(*hists(i, j))[0], i, j) for i in range(x.shape[1]) for j in range(i)))[:PAIRS]
    m.pairs = [(i, j) for _, i, j in ranked]
    m.grids = [np.zeros((COARSE, COARSE)) for _ in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(m.pairs, m.grids, strict=True):
            step = RATE * _quadrants(*hists(i, j))[1]
            t += step
            out += step.reshape(-1)[cell(i, j)]
    return m


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([textstats.features(t or "") for t in texts], index=texts.index, dtype=object)


def measure(text: Column) -> Column:
    """array<double> of textstats.FEATURES."""
    return F.pandas_udf(_features, "array<double>")(F.coalesce(text.cast("string"), F.lit("")))


def fold(doc_id: Column) -> Column:
    """Which third a document lies in: crc32 of its id as text, modulo 3. Third 1 is held out. Null ids: third 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)).cast("int")


def features_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, x) of each document, kept in the shared folder: texts are read once."""
    return keep(docs.select("doc_id", sieve.document_key(F.col("doc_id"), F.col("text")).alias("key"), measure(F.col("text")).alias("x")), "features", texts=True)


def train(features: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on labelled rows outside the held-out third; of more than max_train, those with the smallest hash of the id."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("hi")).where(F.col("y") == F.col("hi")).select("doc_id", "y")
    rows = features.join(marked, "doc_id").select("y", "x", F.xxhash64("doc_id").alias("h"), "doc_id").orderBy("h", "doc_id", "x").limit(max_train).select("y", "x").collect()
    return fit(np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), len(textstats.FEATURES)), np.array([r.y for r in rows]))


def scored(x: Column, model: Model) -> Column:
    """Score of an array of features."""
    raw = zlib.compress(pickle.dumps(model))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = pickle.loads(zlib.decompress(raw))  # noqa: S301  made above
        for part in batches:
            yield pd.Series(m.score(np.array(part.to_list(), dtype=np.float64)) if len(part) else [], dtype=np.float64)

    return F.pandas_udf(run, "double").asNondeterministic()(x)  # never run twice for a filter and a column


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    features = features_of(docs)
    score = scored(F.col("x"), train(features, labels, max_train))
    return features.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def filter_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents with a score of at least `least`, with all their columns. Texts are measured once, and move only where their document can be one that goes."""
    features = features_of(docs)
    score = scored(F.col("x"), train(features, labels, max_train))
    gone = keep(features.select("key", score.alias("score")).where(F.col("score") < least).select("key").distinct(), "gone")
    return sieve.without(docs, sieve.document_key(F.col("doc_id"), F.col("text")), gone, "key")
