"""Partial correlation with several controls, silhouettes, split halves, order control, swaps, and peaks: against plain loops and cases by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sondera.operators import cluster, models, stats, steps


def ranks(v):
    v = np.asarray(v, dtype=float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def slow_partial(x, y, zs):
    a = np.column_stack([np.ones(len(x)), *map(ranks, zs)])
    u, v = (ranks(c) - a @ np.linalg.lstsq(a, ranks(c), rcond=None)[0] for c in (x, y))
    return u, v, float(u @ v / math.sqrt((u @ u) * (v @ v)))


def _table(spark, n=60):
    r = np.random.default_rng(4)
    z, u = r.normal(size=n).round(1), r.integers(0, 5, n)
    x = (z + u + r.normal(size=n)).round(1)
    y = (z - u + 0.8 * r.normal(size=n) + 0.5 * x).round(1)
    rows = [("a", float(x[i]), float(y[i]), float(z[i]), int(u[i]), 3.0, float(2 * z[i])) for i in range(n)] + [("a", None, 1.0, 1.0, 1, 3.0, 1.0)] + [("few", float(i), float(i), 1.0, i, 3.0, 1.0) for i in range(5)]
    return spark.createDataFrame(rows, "node string, x double, y double, z double, u long, same double, twice double"), x, y, z, u


def test_partial_with_several_controls(spark):
    df, x, y, z, u = _table(spark)
    got = {r.node: r for r in stats.partial_spearman_many(df, ["node"], "x", "y", ["z", "u"]).collect()}
    assert got["a"].n == 60 and math.isclose(got["a"].rho, slow_partial(x, y, [z, u])[2], abs_tol=1e-9) and got["few"].rho is None
    assert math.isclose(got["a"].zero, np.corrcoef(ranks(x), ranks(y))[0, 1], abs_tol=1e-9)
    more = {r.node: r for r in stats.partial_spearman_many(df, ["node"], "x", "y", ["z", "same", "twice", "u"]).collect()}
    assert math.isclose(more["a"].rho, got["a"].rho, abs_tol=1e-9)  # a constant, and a control that repeats one, take nothing away
    assert stats.partial_spearman_many(df, ["node"], "x", "z", ["twice"]).where("node = 'a'").first().rho is None


def test_partial_p(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRAWS_A_ROW", 70)
    df, x, y, z, u = _table(spark)
    got = {r.node: r for r in stats.partial_permutation_p(df, ["node"], "x", "y", ["z", "u"], draws=200, seed=5).collect()}
    order = sorted(range(60), key=lambda i: tuple(ranks(c)[i] for c in (x, y, z, u)))
    a, b, rho = slow_partial(*(np.asarray(c)[order] for c in (x, y)), [np.asarray(c)[order] for c in (z, u)])
    over = 0
    for first in (0, 70, 140):
        rng = np.random.default_rng([stats.seed_of(("a",), 5), first])
        over += sum(abs(rng.permutation(a) @ b) / math.sqrt((a @ a) * (b @ b)) >= abs(rho) - 1e-12 for _ in range(min(70, 200 - first)))
    assert got["a"].n == 60 and math.isclose(got["a"].rho, rho, abs_tol=1e-9) and math.isclose(got["a"].p, (over + 1) / 201) and got["few"].p is None


def slow_silhouette(v, c):
    out = []
    for i in range(len(v)):
        far = {k: [math.dist(v[i], v[j]) for j in range(len(v)) if c[j] == k and j != i] for k in set(c)}
        others = [np.mean(d) for k, d in far.items() if k != c[i]]
        if not others:
            return None
        a = np.mean(far[c[i]]) if far[c[i]] else None
        out.append((min(others) - a) / max(a, min(others)) if a is not None and max(a, min(others)) > 0 else 0.0)
    return float(np.mean(out))


@pytest.mark.parametrize("slab", [7, 8192])
def test_silhouette(slab, spark, monkeypatch):
    monkeypatch.setattr(cluster, "SLAB_ROWS", slab)
    r = np.random.default_rng(1)
    v, c = r.normal(size=(50, 3)), r.integers(0, 3, 50).tolist()
    v[:20] += 2
    v, c = [*v.tolist(), *([[0.0, 0.0, 0.0]] * 2)], [*c, 9, 0]  # a cluster of one row; a row that repeats
    rows = [*zip(c, v, strict=True), (None, [0.0] * 3), (1, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>").withColumn("id", F.lit("mine")).repartition(3)
    got = cluster.silhouette(df, "v", "k").first()
    assert got.n == 52 and math.isclose(got.silhouette, slow_silhouette(v, c), abs_tol=1e-9)


def test_silhouette_of_one_cluster(spark):
    df = spark.createDataFrame([(1, [0.0]), (1, [1.0])], "k int, v array<double>")
    assert tuple(cluster.silhouette(df, "v", "k").first()) == (2, None) and tuple(cluster.silhouette(df.where("false"), "v", "k").first()) == (0, None)


def test_split_halves(spark):
    r = np.random.default_rng(0)
    days = {d: r.normal(d * 0.5, 1, 41 + d) for d in (0, 1, 2, 4)}
    rows = [("a", d, i, float(x)) for d, v in days.items() for i, x in enumerate(v)] + [("a", 9, i, 0.0) for i in range(39)] + [("b", d, i, 1.0) for d in (0, 1) for i in range(50)]
    (got,) = stats.split_halves(spark.createDataFrame(rows, "node string, day long, i long, y double"), ["node"], "day", ["i"], "y").collect()
    gap = [np.median(v[: len(v) // 2]) - np.median(v[len(v) // 2 :]) for v in days.values()]
    m = {d: np.median(v) for d, v in days.items()}
    between = np.median([abs(m[1] - m[0]), abs(m[2] - m[1])])
    assert (got.node, got.sessions) == ("a", 4) and np.allclose([got.within, got.between, got.ratio], [np.median(np.abs(gap)), between, between / np.median(np.abs(gap))])
    assert math.isclose(got.drift_sd, math.sqrt(max(0, np.var(list(m.values()), ddof=1) - np.mean(np.square(gap)) / 4)), abs_tol=1e-9)


def test_order_control(spark):
    """A slow drift stays in windows of the real order, and averages out in the shuffled one."""
    n = 1024
    y = np.sin(np.arange(n) / 150) * 5 + np.random.default_rng(0).normal(size=n)
    rows = [("a", i, float(x)) for i, x in enumerate(y)] + [("b", i, 1.0) for i in range(17)]
    got = {(r.node, r.width): r for r in stats.order_control(spark.createDataFrame(rows, "node string, i long, y double"), ["node"], ["i"], "i", "y", (8, 64, 600)).collect()}
    assert set(got) == {("a", 8), ("a", 64), ("b", 8)} and got["a", 64].windows == 16
    real = [np.median(y[k * 64 : k * 64 + 64]) for k in range(16)]
    assert math.isclose(got["a", 64].real, np.std(real, ddof=1)) and got["a", 64].shuffled < got["a", 64].real / 3
    assert math.isclose(got["a", 64].expected, got["a", 8].real / math.sqrt(8))


def test_swap(spark):
    cases = {
        "DEVICE": {(0, 0): (0, 0), (0, 1): (10, 0), (1, 0): (1, 0), (1, 1): (11, 0), (2, 0): (0.5, 0), (2, 1): (9.5, 0)},
        "POSITION": {(0, 0): (0, 0), (0, 1): (10, 0), (1, 0): (1, 0), (1, 1): (11, 0), (2, 0): (10.5, 0), (2, 1): (0.5, 0)},
        "UNDERPOWERED": {(0, 0): (0, 0), (0, 1): (1, 0), (1, 0): (5, 0), (1, 1): (6, 0), (2, 0): (0, 1), (2, 1): (1, 1)},
        "MIXED": {(0, 0): (0, 0), (0, 1): (10, 0), (1, 0): (1, 0), (1, 1): (11, 0), (2, 0): (5, 0), (2, 1): (5, 5)},
        None: {(0, 0): (0, 0), (0, 1): (10, 0)},
    }
    rows = [(str(k), s, d, float(x), float(y)) for k, v in cases.items() for (s, d), (x, y) in v.items()]
    got = {r.node: r for r in models.swap_test(spark.createDataFrame(rows, "node string, s int, d int, x double, y double"), ["node"], "s", "d", "x", "y").collect()}
    assert all(got[str(k)].verdict == k for k in cases)
    assert got["POSITION"].sign == "AGAINST" and got["UNDERPOWERED"].sign == "TOGETHER" and math.isclose(got["POSITION"].drift, 1.0) and got["None"].sign is None


@pytest.mark.parametrize("bucket", [5, 4096])
def test_peaks(bucket, spark, monkeypatch):
    monkeypatch.setattr(steps, "BUCKET", bucket)
    r = np.random.default_rng(bucket)
    v = {int(i): float(x) for i, x in zip(range(-20, 80), r.integers(0, 12, 100), strict=True) if i % 17}
    seen = []
    for i in sorted(v, key=lambda i: (-v[i], i)):
        if all(abs(i - s) >= 6 for s in seen):
            seen.append(i)
    df = spark.createDataFrame([*v.items(), (200, None)], "bin long, rms double").withColumn("cells", F.lit(1))
    got = steps.peaks(df, "bin", "rms", 6)
    assert got.columns == ["bin", "rms", "cells"] and sorted(x.bin for x in got.collect()) == sorted(seen)


def test_coherent_steps(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3, 40))
    x[:, 20:] += 4
    x[0, [5, 21]] = np.nan
    x[1, 10:13] = np.nan
    rows = [(c, i, float(x[c, i])) for c in range(3) for i in range(40) if not np.isnan(x[c, i])]
    got = {g.bin: g for g in steps.coherent_steps(spark.createDataFrame(rows, "cell int, bin long, v double"), "cell", "bin", "v", 4).collect()}
    s = [np.nanstd(np.diff(x[c])) / math.sqrt(2) for c in range(3)]
    for j in range(4, 36):
        z = [(np.nanmean(x[c, j : j + 4]) - np.nanmean(x[c, j - 4 : j])) / (s[c] * math.sqrt(0.5)) for c in range(3) if np.isnan(x[c, j : j + 4]).sum() <= 1 and np.isnan(x[c, j - 4 : j]).sum() <= 1]
        assert got[j].cells == len(z) and math.isclose(got[j].rms, math.sqrt(np.mean(np.square(z))), rel_tol=1e-9)
    assert set(got) == set(range(4, 36)) and max(got.values(), key=lambda g: g.rms).bin == 20
    m = {g.bin: g for g in steps.motion_index(spark.createDataFrame(rows, "cell int, bin long, v double"), "cell", "bin", "v").collect()}
    d = np.abs(np.diff(x, axis=1))
    assert m[20].moved and math.isclose(m[20].motion, np.nanmean(d[:, 19] / np.nanmedian(d, axis=1)), rel_tol=1e-9)


def test_range_sums(spark):
    """Counts and sums between running sums: ends on points, between and beyond them, in one bucket and over many; ties, nulls, no points."""
    from sondera.operators import joins

    r = np.random.default_rng(6)
    points = [(int(t), float(v)) for t, v in zip(r.integers(-50, 120, 80), r.normal(size=80).round(3), strict=True)] + [(7, None), (7, 1.0), (7, 2.0)]
    ranges = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(r.integers(-80, 140, 40), r.integers(0, 90, 40), strict=True))] + [(99, 7, 7)]
    df, p = spark.createDataFrame(ranges, "id int, lo long, hi long"), spark.createDataFrame(points, "at long, v double")
    got = joins.range_sums(df, p, "lo", "hi", "at", "v", 10, "n", "total").collect()
    assert len(got) == len(ranges)
    for x in got:
        inside = [v for t, v in points if v is not None and x.lo <= t <= x.hi]
        assert x.n == len(inside) and math.isclose(x.total, sum(inside), abs_tol=1e-9)
    assert all((x.n, x.total) == (0, 0.0) for x in joins.range_sums(df, p.where("false"), "lo", "hi", "at", "v", 10, "n", "total").collect())
