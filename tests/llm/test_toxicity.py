"""Decoding against all readings, n-gram counts against a plain loop, terms, held-out accuracy and edge cases."""

import itertools
import math
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sondera.llm import noisy_channel, queries, toxicity
from sondera.session import table

from ..conftest import DATA
from .helpers import docs, text


def grams(t):
    """N-grams up to four with 0 where a word begins or ends, one at a time."""
    codes = [ord(c) if c.isalpha() and ord(c) < 1 << 16 else 0 for c in "\n" + t.lower() + "\n"]
    out = Counter()
    for i in range(len(codes)):
        for k in range(1, 5):
            g = codes[i : i + k]
            if len(g) == k and all(g[1:-1]) and (g[-1] or (k > 1 and g[-2]) or (k == 1 and i and codes[i - 1])):
                out["".join(map(chr, g))] += 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abÉ .1\n中\U0001f642"), max_size=20))
def test_ngrams(t):
    got = Counter(i for x in noisy_channel.slots_of(noisy_channel.codes_of(t)) for i in x.tolist())
    want = Counter()
    for g, n in grams(t).items():
        want[noisy_channel._slot(g)] += n
    assert got == want


def decoder_of(corpus):
    counts = np.zeros(noisy_channel.SLOTS, dtype=np.float32)
    for x in noisy_channel.slots_of(noisy_channel.codes_of(corpus)):
        counts += np.bincount(x, minlength=noisy_channel.SLOTS)
    return noisy_channel.Decoder(zlib.compress(counts.tobytes()))


CORPUS = " ".join(["the idiot is a stupid loser and the clown saw worthless trash in a pathetic book with letters to all"] * 50)


def slow_decode(d, chunk):
    """Words to the score of their best way; each way through the lattice is scored as a whole."""
    runs = [(c, len(list(g))) for c, g in itertools.groupby(chunk)]
    again = bool(noisy_channel._AGAIN.search(chunk))
    best = {}
    for way in itertools.product(*[d.readings(c, n, 0 < i < len(runs) - 1, again) for i, (c, n) in enumerate(runs)]):
        total, context, said = sum(cost for _, cost in way), "\0", "".join(m for m, _ in way)
        for x in said + "\0":
            if x != "\0" or context != "\0":
                total += d.log_p(context, x)
            context = "\0" if x == "\0" else (context + x)[-3:]
        words = tuple(w for w in said.split("\0") if w)
        best[words] = max(total, best.get(words, -math.inf))
    return best


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("idot10.!ls5"), min_size=1, max_size=7))
def test_viterbi_finds_the_best_way(chunk):
    d = decoder_of(CORPUS)
    ways = slow_decode(d, chunk)
    assert math.isclose(ways[d.decode(chunk)], max(ways.values()), rel_tol=1e-9)


@pytest.mark.parametrize("seen,meant", [("1d10t", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiiiioot", "idiot"), ("St00p1d", None), ("$tup1d!!", "stupid"), ("l0ser", "loser"), ("c-l-o-w-n", "clown"), ("iiddiioott", "idiot"), ("tr@sh,", "trash"), ("(p@thet1c)", "pathetic"), ("worthless", "worthless"), ("letters", "letters"), ("clown's", "clown")])
def test_restored(seen, meant):
    d = pickle.loads(pickle.dumps(decoder_of(CORPUS)))
    assert meant is None or meant in d.words(f"the {seen} saw")


def test_nothing_to_restore():
    d = decoder_of(CORPUS)
    assert d.words("") == set() and d.words("12 345 -- ... $$$") == set() and d.words("m oron lo se r") == {"m", "oron", "lo", "se", "r"}
    assert d.words("an end.then") == {"an", "end", "then"}
    assert d.words("1a" * 20_000) and noisy_channel.Decoder(zlib.compress(np.zeros(noisy_channel.SLOTS, np.float32).tobytes())).words("a1b cd") == {"cd", "a", "b"}


def test_counts_are_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(noisy_channel, "CHARS", 50)
    texts = [text(40, i) for i in range(30)] + [None, "", "é" * 500]
    df = docs(spark, list(enumerate(texts)), extra=True).repartition(3)
    want = Counter()
    for t in texts:
        for g, n in grams(t or "").items():
            want[noisy_channel._slot(g)] += n
    assert {r.slot: r.n for r in noisy_channel.count_ngrams(F.col("text"), df).collect()} == want


BAD = ["idiot", "scummy", "moron"]


def corpus(n=900):
    r, rows, labels = random.Random(1), [], []
    disguise = {"idiot": "1d10t", "scummy": "s c u m m y", "moron": "mor0n"}
    for i in range(n):
        toxic = i % 5 == 0
        w = text(30 + i % 40, i).split()
        if toxic:
            for _ in range(3):
                b = r.choice(BAD)
                w.insert(r.randrange(len(w)), disguise[b] if i % 20 == 0 else b)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_and_edges(spark):
    rows, labels = corpus()
    odd = [(5000, None), (5001, ""), (5002, " ".join(["1d10t"] * 3)), (None, text(50, 3)), (5003, text(20_000, 4)), (5004, rows[1][1]), (5004, rows[1][1])]
    df = docs(spark, rows + odd, extra=True).withColumn("toxic", F.lit("mine")).withColumn("words", F.lit("mine"))
    marked = spark.createDataFrame([*labels, (None, 1, 1), (7, 1, None), (5004, 1, 1), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(df, marked).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    y = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert len(held) > 200 and all(r.predicted == y[r.doc_id] for r in held)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[5000] == by[5001] and by[5004] == by[1] and min(by[5002]) >= 0.7 and max(by[5003]) < 0.5


def test_without_labels(spark):
    df = docs(spark, [(1, "an idiot"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.score_documents(df, none).collect()} == {(0.5, 0)}
    assert toxicity.score_documents(df.where("false"), none).collect() == []


def test_terms_by_hand(spark):
    """Evidence as defined, from texts of both halves."""
    rows = [(f"k{i}", int(i % 3 == 0), ["idiots", "the"] if i % 3 == 0 else ["the", "idle"]) for i in range(600)]
    all_, *halves = toxicity.learn_terms(spark.createDataFrame(rows, "key string, y int, words array<string>"))
    want = math.log(200.5 / 201) - math.log(0.5 / 401) - 1.64 * math.sqrt(1 / 200.5 + 1 / 0.5)
    assert set(all_) == {"=idiots", "idio~", "idiot~", "idiots~"} and all(math.isclose(e, want) for e in all_.values())
    assert all(set(h) == set(all_) for h in halves)


def test_bounded_sample(spark):
    rows, labels = corpus(300)
    df, marked = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    a, b = toxicity.train(df, marked, 60), toxicity.train(df, marked, 10_000)
    assert a.terms == b.terms and a.weights != b.weights


def test_query(spark):
    got = queries.QUERIES["op11_toxicity"](spark, str(DATA / "sf0.001"))
    n = table(spark, str(DATA / "sf0.001"), "documents").count()
    assert got.count() == n and got.columns == ["doc_id", "held_out", "score", "predicted"]
