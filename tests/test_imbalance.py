"""Imbalance of mirror places on frames with a known one, its sums, turns of sessions; the paired change test against a plain loop; template verdicts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from sondera.operators import imbalance, kernels, models, stats
from sondera.sources import frames as binary


def spectra(n, b, seed=0, noise=0.01):
    """Frames of a smooth channel with random phases and slopes, and an imbalance of b against a direct part of 1."""
    r = np.random.default_rng(seed)
    k = imbalance.K
    taps = r.normal(size=(n, 3)) + 1j * r.normal(size=(n, 3))
    h = sum(taps[:, [i]] * np.exp(-2j * np.pi * k * i / 64) for i in range(3))
    turn = np.exp(2j * np.pi * r.random((n, 1)))
    seen = h * turn + b * imbalance.SIGNS * np.conj(h[:, ::-1] * turn)
    return seen * np.exp(1j * r.normal(0, 0.01, (n, 1)) * k) + noise * (r.normal(size=h.shape) + 1j * r.normal(size=h.shape))


def estimate(h, groups=1, which=None):
    n = np.arange(len(h))
    return imbalance.estimate(imbalance.frame_sums(h, n * 0 if which is None else which, n % 2, groups))


@pytest.mark.parametrize("b", [0, 0.02, 0.1, 0.1j])
def test_known_imbalance(b):
    """The channel of each frame has phases of its own; the estimate is of the imbalance alone."""
    e = estimate(spectra(6000, b))
    assert abs(complex(e["kappa_re"][0], e["kappa_im"][0]) - b) < 0.01
    assert bool(e["detected"][0]) == bool(e["detected_pairs"][0]) == (b != 0)
    assert e["n"][0] == 6000 and (b == 0 or e["align"][0] > 0.9)


def test_ramp_goes_and_phase_stays():
    h = spectra(5, 0.1)
    g = imbalance.unramped(h)
    assert np.allclose(imbalance.unramped(h * np.exp(0.3j * imbalance.K)), g) and np.allclose(imbalance.unramped(h * np.exp(1j)), g * np.exp(1j))


def test_sums_by_plain_loop():
    h = spectra(40, 0.1)
    s = imbalance.frame_sums(h, np.arange(40) % 3, np.arange(40) % 2, 4)
    g = imbalance.unramped(h)
    for c in range(3):
        mine = [i for i in range(40) if i % 3 == c]
        a = sum((g[i] * g[i, ::-1]) @ imbalance.SIGNS for i in mine)
        p = sum((np.abs(g[i]) ** 2).sum() for i in mine)
        e = imbalance.estimate(s[c : c + 1])
        assert np.isclose(complex(e["kappa_re"][0], e["kappa_im"][0]), a / (2 * p)) and np.isclose(e["coherence"][0], abs(a) / sum(abs((g[i] * g[i, ::-1]) @ imbalance.SIGNS) for i in mine))
    assert not s[3].any()
    dead = imbalance.frame_sums(np.vstack([h[:2], np.zeros((1, 52)), np.full((1, 52), np.nan)]), np.zeros(4, int), np.zeros(4, int), 1)
    assert imbalance.estimate(dead)["n"][0] == 2


def test_training_divides():
    h = spectra(50, 0.1)
    one = imbalance.frame_sums(h, np.zeros(50, int), np.zeros(50, int), 1)
    assert np.allclose(imbalance.frame_sums(h * imbalance.TRAINING, np.zeros(50, int), np.zeros(50, int), 1, divided=False), one)


def test_sums_merge_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(imbalance, "HELD", 1)
    h = spectra(300, 0.1)
    iq = np.zeros((300, 128))
    iq[:, 2 * kernels.PLACES], iq[:, 2 * kernels.PLACES + 1] = h.imag, h.real
    rows = [(i % 4 if i % 4 < 3 else None, i, v.tolist()) for i, v in enumerate(iq)] + [(7, 1, [0.0] * 128), (8, 1, None), (9, 1, [1.0])]
    df = spark.createDataFrame(rows, "source int, row_no long, iq array<double>").withColumn("sums", F.lit(1))
    got = {r.source: r for r in imbalance.features(imbalance.sums(df.repartition(5), "source", "iq", "row_no"), "source").collect()}
    assert set(got) == {0, 1, 2, None, 7} and got[7].n == 0 and got[7].kappa_re is None and not got[7].detected
    for c in range(4):
        e = imbalance.estimate(imbalance.frame_sums(h[c::4], np.zeros(75, int), np.arange(c, 300, 4) % 2, 1))
        r = got[c if c < 3 else None]
        assert r.n == 75 and math.isclose(r.kappa_re, e["kappa_re"][0], abs_tol=1e-9) and math.isclose(r.null_max, e["null_max"][0], abs_tol=1e-9)


def test_common_mode(spark):
    rows = [(d, 0, a) for d, a in enumerate((0.1, 1.0, -2.0, 3.0))] + [(d, 1, a + 0.5 + e) for d, (a, e) in enumerate(((0.1, 0.0), (1.0, 0.02), (-2.0, -0.02), (3.0, 0.0)))] + [(0, 2, 1.0), (1, 2, -1.0)]
    t = imbalance.turns(spark.createDataFrame(rows, "device int, session int, angle double"), "device", "session", "angle")
    got = {r.session: r for r in imbalance.common_mode(t, "session").collect()}
    assert got[1].n == 4 and math.isclose(got[1].shared, 0.5, abs_tol=1e-6) and got[1].verdict == "COMMON" and got[1].removed > 0.99
    assert got[2].verdict == "TOO FEW" and set(got) == {1, 2}
    own = [r.own for r in imbalance.without_shared(t, "session").where("session = 1").collect()]
    assert max(map(abs, own)) < 0.03


def slow_change(x, y, w, unit):
    def steps(z):
        m = [np.median(z[i : i + w]) for i in range(len(z) - w + 1)]
        return [b - a for a, b in zip(m, m[w:])]

    def score(s, t):
        return [round(min(abs(a), abs(b)) / unit, 9) if np.sign(a) == np.sign(b) else 0.0 for a, b in zip(s, t)]

    sx, sy = steps(x), steps(y)
    now = score(sx, sy)
    at = int(np.argmax(now))
    null = [max(score(sx, steps(np.roll(y, lag)))) for lag in range(1, len(x))]
    return at, sx[at], sy[at], now[at], (1 + sum(v >= now[at] for v in null)) / (1 + len(null))


def test_change_test(spark, monkeypatch):
    monkeypatch.setattr(stats, "LAGS", 7)
    r = np.random.default_rng(2)
    x, y = r.normal(size=60).round(2), r.normal(size=60).round(2)
    x[30:] += 3
    y[30:] += 2
    rows = [("a", 100 + i, float(x[i]), float(y[i])) for i in range(60)] + [("a", t, 9.0, 9.0) for t in (1, 2, 3)] + [("a", 500, None, 1.0), ("b", 1, 1.0, 1.0), (None, 1, 1.0, None)]
    got = {(g.node, g.width): g for g in stats.replicated_change(spark.createDataFrame(rows, "node string, t long, x double, y double").withColumn("n", F.lit(0)), ["node"], "t", "x", "y").collect()}
    assert set(got) == {("a", 5), ("a", 15)}
    for (_, w), g in got.items():
        at, sx, sy, score, p = slow_change(x, y, w, 1.0)
        assert (g.n, g.boundary) == (60, 100 + w + at) and np.allclose([g.step_a, g.step_b, g.score, g.p], [sx, sy, score, p])
    p = sorted(g.p for g in got.values())
    assert sorted(g.bh for g in got.values()) == pytest.approx([min(2 * p[0], p[1]), p[1]])


def test_template_verdicts(spark):
    rows = [(0.15, True, "KNOWN"), (0.15, False, "MATCH OF A NEW ID"), (0.16, True, "KNOWN ID IS OFF"), (0.16, False, "STRANGER"), (None, False, "STRANGER")]
    got = spark.createDataFrame(rows, "d double, known boolean, want string").select("want", models.template_verdict(F.col("d"), F.col("known")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_a_look_alike_whose_check_holds_by_chance():
    """The format has one byte of check: what verifies is a record, and what lies inside it isn't found."""
    real = binary.encode_vector(5, b"\2\0\0\0\0\1", 77, np.arange(-8, 8), node=1)
    look = binary.encode(binary.TYPED, binary._TYPED.pack(1, 0, 0, 0, len(real)) + real)
    rows = binary.decode(look + real, final=True).rows
    assert [r["offset"] for r in rows] == [0, len(look)] and rows[0]["node"] == 0 and rows[1]["seq"] == 5
    broken = look[:-1] + bytes((look[-1] ^ 1,))
    assert [r["seq"] for r in binary.decode(broken + real, final=True).rows] == [5, 5]
