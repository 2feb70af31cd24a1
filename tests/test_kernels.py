"""Kernels recover what synthetic frames and series were made with."""

import math

import numpy as np
import pytest
from sondera.operators import kernels as k
from sondera.operators import recursive as rec
from sondera.operators import stats
from sondera.operators.cluster import average_linkage
from sondera.sources import fixtures

UNIT = 0.00237


@pytest.mark.parametrize("slope", [-0.2, -0.01, 0.0, 0.05, 0.3])
def test_slopes_are_recovered(slope):
    h = k.spectrum(fixtures.phase_frames(64, slope, offset=0.7, noise=1.0, seed=3))
    fit = k.consensus_line(np.unwrap(np.angle(h), axis=1), np.arange(64))
    assert abs(np.median(fit["slope"]) - slope) < 0.1 * UNIT
    s, c = k.coherent_slope(h)
    assert abs(np.median(s) - slope) < 0.1 * UNIT and np.median(c) > 0.95


def test_consensus_ignores_outliers_and_depends_on_the_row_alone():
    y = 0.05 * k.FREQUENCIES + np.zeros((4, 1))
    y = y + 0.0
    y[:, ::5] += 2.0
    a = k.consensus_line(y, np.array([9, 9, 1, 2]))
    assert np.allclose(a["slope"], 0.05) and a["slope"][0] == a["slope"][1]
    alone = k.consensus_line(y[2:3], np.array([1]))
    assert alone["slope"][0] == a["slope"][2]
    noise = np.random.default_rng(0).uniform(-60, 60, (3, 52))
    assert np.isnan(k.consensus_line(noise, np.arange(3))["slope"]).all()


def test_places_without_amplitude_count_as_one():
    s, c = k.coherent_slope(np.zeros((2, 52), dtype=complex))
    assert (np.abs(s) < 2e-4).all() and (c > 0.9999).all()


def _noisy(n, seed=0):
    """Spectra of very uneven amplitudes, as (n, 64) in the order of the transform."""
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, 64)) + 1j * rng.standard_normal((n, 64))) * np.exp(rng.standard_normal((n, 64)))


def test_coherent_slope_is_the_best_of_both_grids_with_equal_weights():
    h = _noisy(12)[:, k.PLACES]
    h[0, 3] = 0
    slope, coherence = k.coherent_slope(h)
    unit = 2 * math.pi / 1024
    for row, s, c in zip(h, slope, coherence, strict=True):
        z = [x / abs(x) if abs(x) else 1.0 for x in row]
        lined = lambda t: abs(sum(v * np.exp(-1j * t * f) for v, f in zip(z, k.FREQUENCIES, strict=True)))  # noqa: E731, B023
        first = max((i * unit - (2 * math.pi if i > 512 else 0) for i in range(1024)), key=lined)
        best = max((first - unit + 2e-4 * i for i in range(62)), key=lined)
        assert math.isclose((best + math.pi) % (2 * math.pi) - math.pi, s, abs_tol=1e-9) and math.isclose(lined(best) / 52, c, abs_tol=1e-9)


def test_impulse_response_is_that_of_all_places():
    h = np.concatenate([_noisy(6), np.zeros((1, 64)), np.ones((1, 64))])
    peak, spread = k.impulse_response(h)
    assert peak[-1] == 1 and spread[-1] < 1e-9 and peak[-2] == 0 and spread[-2] == 0
    for row, a, b in zip(h[:6], peak, spread, strict=False):
        p = [abs(sum(row[j] * np.exp(2j * math.pi * j * t / 64) for j in range(64)) / 64) ** 2 for t in range(64)]
        top = p.index(max(p))
        off = [min((t - top) % 64, (top - t) % 64) for t in range(64)]
        assert math.isclose(a, max(p) / sum(p), rel_tol=1e-9) and math.isclose(b, math.sqrt(sum(x * d * d for x, d in zip(p, off, strict=True)) / sum(p)), rel_tol=1e-9)


def test_ripple_finds_the_delay():
    r = k.ripple(np.abs(k.spectrum(fixtures.phase_frames(1, 0.0, echo=(0.4, 8)))))
    assert abs(r["tau"][0] * 64 - 8) < 1.5


def test_ripple_gates():
    mag = np.abs(_noisy(8)[:, k.PLACES])
    mag[0, 5] = 0
    r = k.ripple(np.concatenate([mag, np.ones((1, 52))]))
    assert np.isnan(r["tau"][0]) and r["flatness"][0] == 0 and np.isnan(r["ripple_db"][0])  # a place without amplitude
    assert np.isnan(r["tau"][-1]) and math.isclose(r["flatness"][-1], 1) and r["ripple_db"][-1] < 1e-9  # no ripple at all
    for i in range(1, 8):
        logs = [math.log(x) for x in mag[i]]
        g = np.array([*logs[:26], (logs[25] + logs[26]) / 2, *logs[26:]])
        w = [0.5 - 0.5 * math.cos(2 * math.pi * n / 52) for n in range(53)]
        p = [abs(sum(v * w[n] * np.exp(-2j * math.pi * m * n / 512) for n, v in enumerate(g - g.mean()))) ** 2 for m in range(257)]
        at = max(range(20, 257), key=p.__getitem__)
        want = at / 512 if p[at] >= 3 * np.median(p[1:]) else float("nan")
        db = [20 * math.log10(x) for x in mag[i]]
        assert r["tau"][i] == want or math.isnan(want) and math.isnan(r["tau"][i])
        assert math.isclose(r["flatness"][i], math.exp(np.mean([2 * x for x in logs])) / np.mean(mag[i] ** 2), rel_tol=1e-9) and math.isclose(r["ripple_db"][i], np.std(db), rel_tol=1e-9)


def test_a_rhythm_is_as_clear_as_the_peaks_that_agree():
    """Ten clearest peaks: three far-off ones are clearer, and don't count."""
    x = fixtures.amplitude_series(3000, 10.0, 0.25, strength=0.01, width=9)
    off = fixtures.amplitude_series(3000, 10.0, 0.45, strength=0.2, width=3, seed=5)
    rows = np.concatenate([x, off])
    peaks = sorted((p for row in rows if (p := k.band_peak(row, 10.0))), reverse=True)[:10]
    hz = float(np.median([f for _, f in peaks]))
    close = [s for s, f in peaks if abs(f - hz) <= 0.05]
    got = k.band_peaks(rows, 10.0)
    assert got["agree"] == len(close) == 7 and math.isclose(got["snr_db"], 10 * math.log10(np.median(close))) and got["snr_db"] < 10 * math.log10(peaks[0][0])
    assert k.band_peak(x[0, :599], 10.0) is None  # shorter than a segment


def test_lines_need_points_and_stay_under_the_threshold():
    x = np.arange(8.0)
    y = np.array([[0, 0, 0, 0, 0, 0.3, 9, 9]])
    assert np.isnan(k.consensus_line(y[:, :7], np.array([1]), x[:7])["slope"][0])  # seven points
    assert k.consensus_line(y, np.array([1]), x)["inliers"][0] < 7 / 8


def test_rhythm_is_found_and_noise_is_not():
    x = fixtures.amplitude_series(3000, 10.0, 0.25)
    found = k.band_peaks(x, 10.0)
    assert found["present"] and abs(found["hz"] * 60 - 15) < 1.5
    assert not any(k.band_peaks(fixtures.amplitude_series(3000, 10.0, None, seed=s), 10.0)["present"] for s in range(5))


def test_periodogram_and_suppression():
    t = np.arange(200)
    period, share, p = k.periodogram(np.sin(2 * np.pi * t / 20) + 0.01 * t)
    assert abs(period - 20) < 0.5 and share > 0.4 and p < 0.01
    assert k.periodogram(np.sin(2 * np.pi * t / 150))[0] <= 200 / 3  # slower than three cycles isn't asked
    assert math.isnan(k.periodogram(np.zeros(31))[0])
    run = k.longest_run(np.array([1, 2, 4, 5, 6, 9]))
    assert (run.start, run.stop) == (2, 5) and k.longest_run(np.zeros(0)) == slice(0, 0)
    assert k.suppress(np.array([1.0, 5, 4, 3]), np.array([0, 10, 11, 30]), 5, 2).tolist() == [1, 3]


def test_special_functions():
    assert math.isclose(stats.beta_inc(2, 3, 0.5), 0.6875, rel_tol=1e-12)
    assert math.isclose(stats.chi2_tail(5.991464547, 2), 0.05, rel_tol=1e-8)
    assert math.isclose(stats.chi2_tail(3.841458821, 1), 0.05, rel_tol=1e-8)
    assert math.isclose(stats.t_tail(2.228138852, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(stats.binomial_tail(8, 10, 0.5), 56 / 1024, rel_tol=1e-12)
    assert math.isclose(stats.binomial_two_sided(1, 10), 22 / 1024, rel_tol=1e-12)
    assert abs(stats.critical_r(10) - 0.6319) < 1e-3
    assert stats.ks_uniform(np.linspace(0.005, 0.995, 100))[1] > 0.99 and stats.ks_uniform(np.full(50, 0.5))[1] < 1e-6
    assert abs(stats.effective_tests(np.eye(4)) - 4) < 1e-9 and abs(stats.effective_tests(np.ones((4, 4))) - 1) < 1e-9


def test_model_choice():
    t = np.arange(60.0)
    n = 0.01 * np.random.default_rng(1).standard_normal(60)
    best = lambda y: min(b := stats.fit_shapes(t, y + n), key=b.get)
    assert best(0 * t) == "constant" and best(t) == "line" and best(5 * (t > 30)) == "step" and best(3 * np.exp(-t / 8)) == "exponential"


def test_resampling_is_seeded_and_sane():
    rng = np.random.default_rng(0)
    a, b = rng.normal(1, 1, 200), rng.normal(0, 1, 200)
    d, lo, hi = stats.bootstrap_difference(a, b)
    assert lo < d < hi and lo > 0 and stats.bootstrap_difference(a, b) == (d, lo, hi)
    assert abs(stats.block_bootstrap_variance(a, 5) - math.pi / 2 * a.var() / 200) < 0.006
    assert stats.range_p(1.0, 5) == 1 and math.isclose(stats.range_p(0.5, 2), 0.75) and math.isnan(stats.range_p(0.5, 1))
    assert stats.block_permutation_p(np.repeat([0.0, 1.0] * 10, 5), np.repeat([0, 1] * 10, 5), 5, 200) < 0.02
    assert stats.rotation_p(np.sin(np.arange(140) * 2 * np.pi / 7), 2 * np.pi * np.arange(140) / 7, 200) > 0.5  # turning keeps a pure rhythm


def test_steps():
    h = rec.Hysteresis(on=2, off=2)
    seen = [h.step([x, x]) for x in (1, 6, 6, 6, 4, 1, 6, 1, 1, 1)]
    assert seen == [False, False, True, True, True, True, True, True, False, False]
    a = rec.Anchor()
    assert a.step(100, 0) == (100, True) and a.step(120, 10) == (110, False) and a.step(9_000_000, 20) == (9_000_000, True)
    one = rec.Hysteresis(on=1, off=1)
    assert one.step([6.0]) and not rec.Hysteresis(on=1).step([6.0, None]) and not rec.Hysteresis(on=1).step([6.0], links=2)  # a single link counts as both
    assert not one.step([None], 1)  # no score at all is low
    r = rec.Reference("a")
    assert r.step("b", 5.0) is None and r.step("a", 1.0) == 0.0 and r.step("b", 5.0) == 4.0
    assert r.step("a", 3.0) == 3.0 - r.track.x  # against the track after its own update
    kal = rec.Kalman(0.0)
    assert [kal.step(2.0, 1.0) for _ in range(5)][-1] == 2.0
    w = rec.CountWindow(2)
    assert [w.step(i) for i in range(4)] == [None, [0, 1], None, [2, 3]]


def test_self_verdicts_of_two_features():
    """Against a plain model: sample covariance of what was learnt, floors, gates at 5.991 and 9.210, a run of anomalies."""
    rng = np.random.default_rng(3)
    rows = [*rng.normal([5, 0.2], [3, 0.01], (60, 2)), *[(90.0, 0.9)] * 5, *rng.normal([90, 0.9], [1, 0.01], (20, 2))]
    v, learnt, run, said = rec.SelfVerdict(patience=3), [], 0, []
    for x, y in rows:
        if len(learnt) < 5:
            want = "LEARNING"
        else:
            m = np.array(learnt)
            cov = np.cov(m.T)
            cov[0, 0], cov[1, 1] = max(cov[0, 0], 1.0), max(cov[1, 1], 1e-8)
            d = np.array([x, y]) - m.mean(0)
            d2 = float(d @ np.linalg.solve(cov, d))
            want = "STABLE" if d2 <= 5.991 else "DRIFTING" if d2 <= 9.210 else "ANOMALY"
        run = run + 1 if want == "ANOMALY" else 0
        if run == 3:
            want, learnt, run = "REBASE", [], 0
        if want != "ANOMALY":
            learnt.append((x, y))
        assert v.step(x, y) == want
        said.append(want)
    assert {"LEARNING", "STABLE", "DRIFTING", "ANOMALY", "REBASE"} <= set(said) or {"STABLE", "ANOMALY", "REBASE"} <= set(said)


def test_walks_carry_state_across_batches(spark):
    """More rows than a batch holds, keys side by side in one task, and keys that are null."""
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 2 THEN NULL ELSE id % 3 END AS k", "id AS t", "CAST(id % 11 AS DOUBLE) AS v")
    got = rec.walk(df.coalesce(1), ["k"], ["t"], lambda: [0], lambda s, v: (s.__setitem__(0, s[0] + v) or s[0],), ["v"], "total double", ["total"])
    assert got.columns == ["k", "t", "total"]
    last = {r.k: r.total for r in got.groupBy("k").agg({"total": "max"}).withColumnRenamed("max(total)", "total").collect()}
    assert last == {k: float(sum(i % 11 for i in range(30_000) if i % 3 == (2 if k is None else k))) for k in (0, 1, None)}
    assert rec.walk(df.limit(0), ["k"], ["t"], list, lambda s, v: (0.0,), ["v"], "total double", ["total"]).count() == 0


def test_linkage():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [20.0]])
    assert average_linkage(x, np.ones(5), 3).tolist() == [0, 0, 1, 1, 2]
