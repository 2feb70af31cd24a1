"""Toxicity: texts are restored by a noisy-channel decoder (noisy_channel), then scored by terms learned from labels.

A term is a whole word (`=idiot`) or the beginning of words (`idio~`, of PREFIXES letters). Its evidence is the lower bound of its log odds
between toxic and clean labelled texts, counted over all labelled texts outside the held-out third by Spark. A text has the
evidence of its strongest words and their number; a logistic regression on these makes it a score. Terms that were counted on one half of
the labelled texts describe the other half when the regression is fitted, so that it sees how far terms carry.

MAX_TRAIN bounds the texts that the regression is fitted on (those of the smallest hash), MAX_TERMS the terms of a model (those with the highest evidence).

Defined cases: a null or empty text has no words and gets the score of a text without terms; equal texts are one labelled text, and those
whose labels contradict each other, or are null, don't train; without labelled texts of both kinds the score is the smoothed share of
label 1; repeated rows get equal scores; an empty table gives an empty result; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import noisy_channel, sieve
from .base import keep
from .gam import fold

MAX_TRAIN, MAX_TERMS = 20_000, 20_000
PREFIXES = (4, 5, 6)
#: A term lies in so many toxic texts at least, and has so much evidence; normal quantile of its lower bound.
LEAST_TEXTS, LEAST_EVIDENCE, QUANTILE = 3, 1.5, 1.64
PREDICTED_FROM = 0.7
RIDGE, STEPS = 1.0, 30


def terms_of(word: str) -> list[str]:
    return ["=" + word, *(word[:k] + "~" for k in PREFIXES if len(word) >= k)]


def evidence_of(words: set[str] | tuple[str, ...], terms: dict[str, float]) -> dict[str, float]:
    """Words that begin with a term or are one, with the highest evidence."""
    get = terms.get
    return {w: e for w in words if (e := max(get(t, 0.0) for t in terms_of(w)))}


def measures(found: dict[str, float]) -> list[float]:
    """Of the three strongest words, the logarithm of all evidence, and that of the number of words with any."""
    e = sorted(found.values(), reverse=True)
    return [*(e + [0.0] * 3)[:3], math.log1p(math.fsum(e)), math.log1p(len(e))]


@dataclass
class Model:
    decoder: noisy_channel.Decoder
    terms: dict[str, float]
    weights: list[float]
    memo: dict[str, tuple] = field(default_factory=dict)

    def __reduce__(self):
        return Model, (self.decoder, self.terms, self.weights)

    def found(self, text: str) -> dict[str, float]:
        """evidence_of() the restored words of a text; most chunks have none."""
        out: dict[str, float] = {}
        if self.terms:
            known = self.memo.get
            for chunk in noisy_channel.chunks_of(text):
                hits = known(chunk)
                if hits is None:
                    hits = tuple(evidence_of(self.decoder.read(chunk), self.terms).items())
                    noisy_channel.remember(self.memo, chunk, hits)
                if hits:
                    out.update(hits)
        return out

    def score(self, text: str) -> float:
        z = sum(w * v for w, v in zip(self.weights, [1.0, *measures(self.found(text))], strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, y) of one document for each labelled text outside the held-out third."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).select("doc_id", F.col("toxic").cast("int").alias("y"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select("doc_id", sieve.document_key(F.col("doc_id"), F.col("text")).alias("key"), F.md5(text.cast("binary")).alias("digest"))
    return own.join(marked, "doc_id").groupBy("digest").agg(F.min("key").alias("key"), F.min("y").alias("y"), F.max("y").alias("hi")).where("y = hi").select("key", "y")


def _restored(docs: DataFrame, labelled: DataFrame, decoder: noisy_channel.Decoder) -> DataFrame:
    """(key, y, words) of the labelled texts. Texts move only where a bit table says that they can be labelled."""
    keyed = docs.select(sieve.document_key(F.col("doc_id"), F.col("text")).alias("own"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    may = sieve.split(keyed, "own", labelled, "key")[0].dropDuplicates(["own"])
    src = may.join(labelled.hint("merge"), F.col("own") == F.col("key")).select("key", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([list(decoder.words(t)) for t in part.column(2).to_pylist()], pa.list_(pa.string()))], names=["key", "y", "words"])

    return src.mapInArrow(run, "key string, y int, words array<string>")


def _evidence(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Lower bound of the log odds of a term that lies in so many of so many texts."""
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    return odds - QUANTILE * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def _half(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(2)).cast("int")


def learn_terms(texts: DataFrame) -> list[dict[str, float]]:
    """Evidence of terms from all texts, from half 0 and from half 1. texts: written rows (key, y, words)."""
    cells = [(h, y) for h in (0, 1) for y in (0, 1)]
    at = lambda h, y: (_half(F.col("key")) == h) & (F.col("y") == y)
    size = texts.agg(*[F.count_if(at(h, y)).alias(f"n{h}{y}") for h, y in cells]).first().asDict()
    word = lambda w: F.array(F.concat(F.lit("="), w), *[F.when(F.length(w) >= k, F.concat(F.substring(w, 1, k), F.lit("~"))) for k in PREFIXES])
    one = texts.select((_half(F.col("key")) * 2 + F.col("y")).alias("cell"), F.explode(F.array_distinct(F.flatten(F.transform("words", word)))).alias("term")).where("term is not null")
    counts = one.groupBy("term").agg(*[F.count_if(F.col("cell") == 2 * h + y).alias(f"n{h}{y}") for h, y in cells])
    toxic = F.col("n01") + F.col("n11")
    sides = [_evidence(toxic, F.col("n00") + F.col("n10"), size["n01"] + size["n11"], size["n00"] + size["n10"]), *[_evidence(F.col(f"n{h}1"), F.col(f"n{h}0"), size[f"n{h}1"], size[f"n{h}0"]) for h in (0, 1)]]
    enough = [toxic >= LEAST_TEXTS, F.col("n01") >= LEAST_TEXTS, F.col("n11") >= LEAST_TEXTS]
    told = counts.where(toxic >= LEAST_TEXTS).select("term", *[F.when(e & (s >= LEAST_EVIDENCE), s).alias(f"e{i}") for i, (e, s) in enumerate(zip(enough, sides, strict=True))])
    rows = told.where("coalesce(e0, e1, e2) is not null").orderBy(F.greatest("e0", "e1", "e2").desc(), "term").limit(MAX_TERMS).collect()
    return [{r.term: r[f"e{i}"] for r in rows if r[f"e{i}"] is not None} for i in range(3)]


def regression(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Weights of a logistic regression, the constant first, by Newton's steps."""
    prior = (y.sum() + 1) / (len(y) + 2)
    w = np.zeros(x.shape[1] + 1)
    w[0] = math.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return w.tolist()
    z = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([0.0, *[RIDGE] * x.shape[1]])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    decoder = noisy_channel.train(docs)
    labelled = keep(_labelled(docs, labels), "labelled")
    texts = keep(_restored(docs, labelled, decoder), "restored")
    terms, first, second = learn_terms(texts)
    other = (second, first)  # terms of the half that a text isn't in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [measures(evidence_of(w, other[h])) for w, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    sample = texts.select("y", "words", _half(F.col("key")).alias("half"), "key", F.xxhash64("key", F.lit(1)).alias("h"))
    last = sample.select("h", "key").orderBy("h", "key").offset(max_train).limit(1).collect()
    sample = sample.where(F.struct("h", "key") < F.struct(F.lit(last[0].h), F.lit(last[0].key))) if last else sample
    t = sample.select("y", "words", "half").mapInArrow(run, "y int, x array<double>").toArrow()
    x = np.array(t.column("x").to_pylist(), dtype=np.float64).reshape(t.num_rows, 5)
    order = np.lexsort(x.T)  # rows come in any order; sums shouldn't depend on it
    return Model(decoder, terms, regression(x[order], t.column("y").to_numpy().astype(np.float64)[order]))


def score_documents(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = train(docs, labels, max_train)
    src = docs.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.array([model.score(t.as_py()) for t in b.column(2)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= PREDICTED_FROM).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
