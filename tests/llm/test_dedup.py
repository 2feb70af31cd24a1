"""Near-duplicate documents and embeddings against brute force, with groups, edge cases and planted copies."""

import collections
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sondera.llm import components, embedding_dedup, near_dedup, oracles, shingles, sieve

from ..conftest import rows_of
from .helpers import changed, docs, text


def reach(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def weighted_jaccard(a, b):
    def bag(t):
        w = shingles.words_of(t)
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    x, y = bag(a), bag(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(rows):
    rows = sorted(rows)
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if weighted_jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8]
    return {r[0]: rows[c][0] for r, c in zip(rows, reach(len(rows), edges), strict=True)}


def classes(df):
    return {r.doc_id: r.component_id for r in near_dedup.classes(df).collect()}


def test_groups_match_brute_force(spark):
    rows, k = [], 0
    for g in range(12):
        base = text(40 + 30 * g, g)
        for c in range(1 + g % 4):
            rows.append((k, changed(base, 0.04 + 0.05 * c, 100 * g + c) if c else base))
            k += 1
        rows.append((k, base.upper() + "  "))  # equal words
        k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, "one two"), (k + 3, "ONE two"), (k + 4, "two one"), (k + 5, text(400, 3) + " " + text(40, 0))]
    assert classes(docs(spark, rows, extra=True)) == brute(rows)


def test_chain_inside_one_band_is_not_lost(spark):
    """b is near a and near c, but a is not near c; and many strays share passages."""
    a = text(200, 1).split()
    b, c = a[12:] + text(12, 2).split(), a[24:] + text(12, 2).split() + text(12, 3).split()
    rows = [(5, " ".join(a)), (2, " ".join(b)), (9, " ".join(c))]
    rows += [(100 + i, " ".join(a[:90]) + " " + text(60, 50 + i)) for i in range(30)]
    assert classes(docs(spark, rows)) == brute(rows)


def test_large_groups(spark):
    base = text(120, 7)
    rows = [(i, base) for i in range(300)] + [(1000 + i, changed(base, 0.05, i)) for i in range(150)] + [(5000 + i, text(80, 900 + i)) for i in range(50)]
    got = classes(docs(spark, rows))
    assert {got[i] for i in range(300)} == {0} and sum(got[1000 + i] == 0 for i in range(150)) == 150
    assert all(got[5000 + i] == 5000 + i for i in range(50))


def test_blocks_of_strays_compare_all(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    shared = text(80, 1)
    rows = [(i, shared + " " + text(45, 100 + i)) for i in range(40)]
    rows += [(100 + i, changed(rows[i][1], 0.06, i)) for i in range(0, 40, 3)]
    assert classes(docs(spark, rows)) == brute(rows)


def test_one_id_with_several_texts(spark, duck):
    """A document is near to whatever any of its texts is near to, and its texts belong together."""
    t = [text(120, i) for i in range(7)]
    near = [changed(x, 0.06, i) for i, x in enumerate(t)]
    rows = [(5, t[0]), (5, t[1]), (9, near[1]), (6, near[0]), (9, t[2]), (3, t[2]), (3, t[2]), (20, t[3]), (21, t[3]), (21, t[4]), (22, near[4]), (30, t[5]), (31, t[6]), (40, None), (40, t[6])]
    df = docs(spark, rows, extra=True)
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] or weighted_jaccard(rows[i][1] or "", rows[j][1] or "") >= 0.8]
    comp = reach(len(rows), edges)
    want = {r[0]: min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i]) for i, r in enumerate(rows)}
    assert classes(df) == want and near_dedup.classes(df).count() == len(want)
    assert sorted(r.doc_id for r in near_dedup.documents_kept(df).collect()) == sorted({c for c in want.values()})
    duck.sql("CREATE OR REPLACE TEMP TABLE several AS SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if x is None else repr(x)})" for i, x in rows) + ") v(doc_id, text)")
    assert {r[0]: r[1] for r in duck.sql(oracles.OP1.replace("FROM documents", "FROM several")).fetchall()} == want


@pytest.mark.parametrize("bits", [1 << 4, 1 << 25])
def test_sieve_holds_nothing_back(spark, monkeypatch, bits):
    monkeypatch.setattr(sieve, "LEAST_BITS", 1 << 4)
    monkeypatch.setattr(sieve, "MOST_BITS", bits)
    ids = spark.range(0, 1000, 7).withColumnRenamed("id", "x").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("mine").alias("__bits")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'mine'"))
    may, never = (d.select("doc_id").collect() for d in sieve.split(df, "doc_id", ids, "x"))
    may, never = {r.doc_id for r in may}, {r.doc_id for r in never}
    assert set(range(0, 1000, 7)) <= may and not may & never and may | never == {*range(1000), None} and None in never
    assert bits == 1 << 4 or len(may) < 300


def test_kept_rows(spark):
    t = text(50, 1)
    df = docs(spark, [(3, t), (1, t), (None, t), (None, t), (7, text(50, 2)), (7, text(50, 2))], extra=True)
    kept = near_dedup.documents_kept(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 7]
    assert near_dedup.classes(df.limit(0)).count() == 0
    nulls = [r for r in near_dedup.classes(df).collect() if r.doc_id is None]
    assert len(nulls) == 2 and all(r.kept and r.component_id is None for r in nulls)


def test_very_long_text(spark):
    t = text(60_000, 4)
    assert classes(docs(spark, [(1, t), (2, changed(t, 0.1, 1)), (3, changed(t, 0.5, 1))])) == {1: 1, 2: 1, 3: 3}


@pytest.mark.parametrize("same", [20, 60, 95])
def test_signature_estimates_similarity(same):
    rng = np.random.default_rng(same)
    x = rng.integers(0, 2**63, 100).astype(np.uint64)
    got, k = [], 168
    for s in range(40):
        a = shingles.mix(x + np.uint64(s))
        b = a.copy()
        b[same:] = rng.integers(0, 2**63, 100 - same).astype(np.uint64)
        w, v = rng.uniform(0.2, 6, 100), rng.uniform(0.2, 6, 100)
        v[: same // 2] = w[: same // 2]
        sig = near_dedup.signatures(np.repeat([0, 1], 100), np.concatenate([a, b]), np.concatenate([w, v]), 2, k)
        both = np.minimum(w[:same], v[:same]).sum()
        got.append((sig[0] == sig[1]).mean() - both / (w.sum() + v.sum() - both))
    assert abs(np.mean(got)) < 4 * 0.5 / math.sqrt(k * 40)


def test_signature_depends_on_the_text_alone():
    o, h, w = shingles.weighted(*shingles.shingles([text(30, 1).split(), text(3000, 2).split(), ["a"]]))
    all_ = near_dedup.signatures(o, h, w.astype(float), 3, 24)
    for i in range(3):
        one = near_dedup.signatures(np.zeros((o == i).sum(), int), h[o == i], w[o == i].astype(float), 1, 24)
        assert (one[0] == all_[i]).all() and (one != 0).all()


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=20))
def test_components(spark, edges):
    want = reach(15, edges)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for e in edges if e[0] != e[1] for i in e}


def test_long_path(spark):
    path = [(i, i + 1) for i in range(300)]
    assert {r.component for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for _ in range(60):
        v = rng.standard_normal(16)
        for c in range(int(rng.integers(1, 7))):
            w = v if c % 3 == 1 else v + rng.standard_normal(16) * rng.choice([0.05, 0.25, 0.35])
            rows.append((k, [float(x) for x in np.float32(w * rng.uniform(0.01, 50))], k % 3))
            k += 1
    rows += [(k, None, 0), (k + 1, [0.0] * 16, 0), (k + 2, [float("nan")] + [1.0] * 15, 0), (k + 3, [None] + [1.0] * 15, 0), (k + 4, [1.0, 2.0], 0), (k + 5, [float("inf")] * 16, 0)]
    rows += [(k + 6 + i, rows[0][1], 1) for i in range(30)]
    x = {r[0]: np.array(r[1], dtype=np.float32).astype(float) for r in rows if r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    assert not (np.abs(m @ m.T - 0.95) < 1e-9).any()
    comp = reach(len(ids), list(zip(*map(list, np.nonzero(near)), strict=True)))
    want = {r[0]: (0, r[0]) for r in rows} | {i: (int(near[j].sum()), ids[comp[j]]) for j, i in enumerate(ids)}
    got = embedding_dedup.links(_vectors(spark, rows))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_recall_of_every_fiftieth_vector(spark):
    """Links at all distances up to the limit, in data that has lists on many sides: each fiftieth vector against all rows, by brute force."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1500, 32))
    x = np.concatenate([base, *[base + rng.standard_normal(base.shape) * s for s in (0.05, 0.2, 0.3, 0.34)]])
    x = np.float32(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = {r.vec_id: r.n_links for r in embedding_dedup.links(_vectors(spark, [(i, [float(v) for v in row], 0) for i, row in enumerate(x)])).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = y[::50] @ y.T
    assert not (np.abs(cos - 0.95) < 1e-9).any()
    want = (cos >= 0.95).sum(1) - 1
    recall = sum(got[i] for i in range(0, len(x), 50)) / want.sum()
    print(f"recall {recall:.4f} of {want.sum()} links")
    assert recall == 1 and [got[i] for i in range(0, len(x), 50)] == want.tolist() and ((cos >= 0.95) & (cos < 0.955)).any()


def test_embeddings_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", 32)
    rng = np.random.default_rng(3)
    v = rng.standard_normal(8)
    rows = [(i, [float(x) for x in np.float32(v + 0.1 * rng.standard_normal(8))], 0) for i in range(300)]
    m = np.array([r[1] for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.links(_vectors(spark, rows)).collect()}
    assert got == {i: int(near[i].sum()) for i in range(300)}


def test_no_embeddings(spark):
    assert embedding_dedup.links(_vectors(spark, [])).count() == 0
    assert rows_of(embedding_dedup.links(_vectors(spark, [(1, None, 0), (None, [1.0, 2.0], 0)])), ["vec_id", "n_links", "component_id", "kept"]) == [("1", "0", "1", "True"), ("null", "0", "null", "True")]
