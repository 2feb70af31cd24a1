"""Numeric kernels, state machines, resampling, clusters and streams on the driver tables. Most are beyond SQL: those are tested against NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import STEADY, r6
from ..operators import cluster, imbalance, kernels, recursive, stats
from ..operators import windows as win
from ..session import frames, scratch, table
from ..streaming import streams
from .catalog import register
from .frame_queries import DAY, FR, ORDER, _sql
from .relation_queries import _BINS as _DAY_BINS
from .relation_queries import _bins as _day_bins


def _spectra(spark, sf_dir) -> DataFrame:
    """Embeddings in the role of interleaved spectra: 64 values and the same in reverse order, as small integers."""
    v = F.transform("embedding", lambda x: F.round(x.cast("double") * 100).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(v, F.reverse(v)).alias("iq"))


def _stack(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_list()) if len(s) else np.zeros((0, 128))


def _per_vector(df: DataFrame, f, fields: str, read=kernels.spectrum) -> DataFrame:
    """df's vec_id and label with columns that f gives for a batch of spectra and ids."""
    names = [x.split()[0] for x in fields.split(", ")]

    def run(iq: pd.Series, ids: pd.Series) -> pd.DataFrame:
        out = f(read(_stack(iq)), ids.to_numpy())
        return pd.DataFrame({n: np.round(np.asarray(out[n], dtype=float) + STEADY, 6) + 0.0 for n in names})

    run.__annotations__ = {"iq": pd.Series, "ids": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, ", ".join(f"{n} double" for n in names))
    return df.select("vec_id", "label", udf("iq", "vec_id").alias("o")).select("vec_id", "label", *[F.when(~F.isnan(f"o.{n}"), F.col(f"o.{n}")).alias(n) for n in names])


#: The same spectra in SQL: places of the transform; values in frequency order k; and those scaled to length 1.
_H = "q AS (SELECT vec_id, label, list_concat(v, list_reverse(v)) AS iq FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 100) AS INTEGER)) AS v FROM embeddings)), h AS MATERIALIZED (SELECT vec_id, label, j, iq[2 * j + 2]::DOUBLE AS re, iq[2 * j + 1]::DOUBLE AS im FROM q, (SELECT unnest(range(64)) AS j))"
_U = _H + ", u AS MATERIALIZED (SELECT vec_id, label, CASE WHEN j < 32 THEN j ELSE j - 64 END AS k, sqrt(re * re + im * im) AS mag, re, im FROM h WHERE j BETWEEN 1 AND 26 OR j BETWEEN 38 AND 63), z AS MATERIALIZED (SELECT vec_id, label, k, CASE WHEN mag > 0 THEN re / mag ELSE 1 END AS re, CASE WHEN mag > 0 THEN im / mag ELSE 0 END AS im FROM u)"


def _lines(h: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    return kernels.consensus_line(np.unwrap(np.angle(h), axis=1), ids)


@register()
def dsp2_consensus_line(spark, sf_dir):
    """Robust phase slope of each frame, seeded by its id; null where too few points agree."""
    return _per_vector(_spectra(spark, sf_dir), _lines, "slope double, intercept double, inliers double, resid double")


#: Seconds between ids in the role of time.
FRAME_S = 0.01


@register()
def dsp3_frame_estimates(spark, sf_dir):
    """Slope of each frame and the frequency offset (Hz) to the last frame of its source that has one, if that is less than a second ago."""
    e = _per_vector(_spectra(spark, sf_dir), _lines, "slope double, intercept double, inliers double, resid double").where("slope IS NOT NULL")
    w = win.ordered("label", "vec_id")
    d = F.col("intercept") - F.lag("intercept").over(w)
    dt = (F.col("vec_id") - F.lag("vec_id").over(w)) * FRAME_S
    return e.select("vec_id", "label", "slope", F.when((dt > 0) & (dt < 1), r6(F.try_divide(F.atan2(F.sin(d), F.cos(d)), 2 * F.pi() * dt))).alias("cfo"))


_COARSE = "c AS (SELECT vec_id, arg_max(t, p) AS t FROM (SELECT vec_id, i, 2 * pi() * CASE WHEN i > 512 THEN i - 1024 ELSE i END / 1024 AS t, sqrt(pow(sum(re * cos(2 * pi() * i * k / 1024) + im * sin(2 * pi() * i * k / 1024)), 2) + pow(sum(im * cos(2 * pi() * i * k / 1024) - re * sin(2 * pi() * i * k / 1024)), 2)) AS p FROM z, (SELECT unnest(range(1024)) AS i) GROUP BY vec_id, i) GROUP BY vec_id)"
_FINE = "f AS (SELECT vec_id, label, s, sqrt(pow(sum(re * cos(s * k) + im * sin(s * k)), 2) + pow(sum(im * cos(s * k) - re * sin(s * k)), 2)) AS p FROM (SELECT z.*, t - 2 * pi() / 1024 + 0.0002 * i AS s FROM z JOIN c USING (vec_id), (SELECT unnest(range(62)) AS i)) GROUP BY vec_id, label, s)"


@register(f"WITH {_U}, {_COARSE}, {_FINE} SELECT vec_id, label, round(s + CASE WHEN s > pi() THEN -2 * pi() WHEN s < -pi() THEN 2 * pi() ELSE 0 END, 6) + 0.0 AS slope, round(p / 52, 6) + 0.0 AS coherence FROM (SELECT vec_id, label, arg_max(s, p) AS s, max(p) AS p FROM f GROUP BY vec_id, label)")
def dsp4_coherent_slope(spark, sf_dir):
    """Slope that lines up the phases of each spectrum, every bin with the same weight, and the coherence that is left."""
    return _per_vector(_spectra(spark, sf_dir), lambda h, i: dict(zip(("slope", "coherence"), kernels.coherent_slope(h), strict=True)), "slope double, coherence double")


@register(f"WITH {_H}, t AS (SELECT vec_id, label, tap, pow(sum(re * cos(2 * pi() * j * tap / 64) - im * sin(2 * pi() * j * tap / 64)), 2) + pow(sum(re * sin(2 * pi() * j * tap / 64) + im * cos(2 * pi() * j * tap / 64)), 2) AS p FROM h, (SELECT unnest(range(64)) AS tap) GROUP BY 1, 2, 3), m AS (SELECT vec_id, arg_max(tap, p) AS peak FROM t GROUP BY 1) SELECT vec_id, label, round(max(p) / sum(p), 6) + 0.0 AS peak, round(sqrt(sum(p * pow(least((tap - peak + 64) % 64, (peak - tap + 64) % 64), 2)) / sum(p)), 6) + 0.0 AS spread FROM t JOIN m USING (vec_id) GROUP BY 1, 2")
def dsp6_impulse_response(spark, sf_dir):
    """Strongest tap of the response to all 64 places, and the spread around it."""
    return _per_vector(_spectra(spark, sf_dir), lambda h, i: dict(zip(("peak", "spread"), kernels.impulse_response(h), strict=True)), "peak double, spread double", kernels.full_spectrum)


_RIPPLE = (
    "a AS (SELECT vec_id, label, min(mag) AS least, exp(2 * avg(ln(greatest(mag, 1e-300)))) / avg(mag * mag) AS flat, 20 * stddev_pop(ln(greatest(mag, 1e-300))) / ln(10.0) AS db FROM u GROUP BY 1, 2), "
    "g AS (SELECT vec_id, k, ln(mag) AS g FROM u JOIN a USING (vec_id) WHERE least > 0 UNION ALL SELECT vec_id, 0, avg(ln(mag)) FROM u JOIN a USING (vec_id) WHERE least > 0 AND abs(k) = 1 GROUP BY vec_id), "
    "w AS MATERIALIZED (SELECT vec_id, k + 26 AS n, (g - avg(g) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * (k + 26) / 52)) AS x FROM g), "
    "s AS MATERIALIZED (SELECT vec_id, m, pow(sum(x * cos(2 * pi() * m * n / 512)), 2) + pow(sum(x * sin(2 * pi() * m * n / 512)), 2) AS p FROM w, (SELECT unnest(range(257)) AS m) GROUP BY 1, 2), "
    "b AS (SELECT vec_id, arg_max(m, p) FILTER (WHERE m >= 20) AS line, max(p) FILTER (WHERE m >= 20) AS top, median(p) FILTER (WHERE m > 0) AS usual FROM s GROUP BY 1)"
)


@register(f"WITH {_U}, {_RIPPLE} SELECT vec_id, label, CASE WHEN usual > 0 AND top >= 3 * usual THEN round(line * 6.25, 6) + 0.0 END AS tau_ns, CASE WHEN least > 0 THEN round(flat, 6) + 0.0 ELSE 0.0 END AS flatness, CASE WHEN least > 0 THEN round(db, 6) + 0.0 END AS ripple_db FROM a LEFT JOIN b USING (vec_id)")
def dsp10_ripple(spark, sf_dir):
    """Echo delay from the ripple of each spectrum's amplitudes, if it is clear; flatness and depth of the ripple."""
    def f(h, i):
        r = kernels.ripple(np.abs(h))
        return {"tau_ns": r["tau"] * 1e9 / kernels.SPACING_HZ, "flatness": r["flatness"], "ripple_db": r["ripple_db"]}

    return _per_vector(_spectra(spark, sf_dir), f, "tau_ns double, flatness double, ripple_db double")


#: Products of mirror places in SQL, from spectra without ramp and mean; sums of each source by place; derived figures.
_TRAIN = "".join("1" if x > 0 else "0" for x in imbalance.TRAINING)
_MIRROR = _H + f""", u AS MATERIALIZED (SELECT vec_id, label, CASE WHEN j < 32 THEN j ELSE j - 64 END AS k, re, im FROM h WHERE j BETWEEN 1 AND 26 OR j BETWEEN 38 AND 63),
m AS (SELECT a.vec_id, atan2(sum(b.im * a.re - b.re * a.im), sum(b.re * a.re + b.im * a.im)) AS m FROM u a JOIN u b ON a.vec_id = b.vec_id AND b.k = a.k + 1 GROUP BY a.vec_id),
d AS (SELECT vec_id, label, k, re * cos(m * k) + im * sin(m * k) AS re, im * cos(m * k) - re * sin(m * k) AS im FROM u JOIN m USING (vec_id)),
g AS MATERIALIZED (SELECT vec_id, label, k, CASE WHEN k < 0 THEN k + 26 ELSE k + 25 END AS i, re - avg(re) OVER w AS re, im - avg(im) OVER w AS im FROM d WINDOW w AS (PARTITION BY vec_id)),
s AS (SELECT i, CASE WHEN substr('{_TRAIN}', CAST(i + 1 AS BIGINT), 1) = substr('{_TRAIN}', CAST(52 - i AS BIGINT), 1) THEN 1.0 ELSE -1.0 END AS s FROM (SELECT unnest(range(52)) AS i)),
p AS (SELECT a.vec_id, a.label, x.d, a.i, a.k, s.s, a.re * b.re - a.im * b.im AS re, a.re * b.im + a.im * b.re AS im, a.re * a.re + a.im * a.im AS w FROM g a JOIN s USING (i), (SELECT unnest([0, 2, 5, 9, 13]) AS d) x, g b WHERE b.vec_id = a.vec_id AND b.i = (51 - a.i + x.d) % 52),
c AS MATERIALIZED (SELECT {{0}}label, d, i, abs(k) AS k, s, sum(re) AS re, sum(im) AS im, sum(CASE vec_id % 2 WHEN 0 THEN re ELSE -re END) AS gap_re, sum(CASE vec_id % 2 WHEN 0 THEN im ELSE -im END) AS gap_im, sum(w) AS w FROM p GROUP BY ALL),
f AS (SELECT {{0}}label, count(*) AS n, sum(sqrt(re * re + im * im)) AS size FROM (SELECT {{0}}vec_id, label, sum(s * re) AS re, sum(s * im) AS im FROM p WHERE d = 0 GROUP BY ALL) GROUP BY ALL)"""


@register(_sql("""SELECT label, n, round(re / (2 * w), 6) + 0.0 AS kappa_re, round(im / (2 * w), 6) + 0.0 AS kappa_im, round(top / (2 * w), 6) + 0.0 AS null_max, round(gap / w, 6) + 0.0 AS halves_gap, round(sqrt(re * re + im * im) / size, 6) + 0.0 AS coherence, round(align, 6) + 0.0 AS align, round(moved, 6) + 0.0 AS align_moved,
gap < sqrt(re * re + im * im) / 2 AND sqrt(re * re + im * im) / size >= 5 * 0.886 / sqrt(n) AND sqrt(re * re + im * im) > top AS detected, gap < sqrt(re * re + im * im) / 2 AND sqrt(re * re + im * im) / size >= 5 * 0.886 / sqrt(n) AND align > moved AS detected_pairs
FROM f JOIN (SELECT label, sum(s * re) AS re, sum(s * im) AS im, sum(w) AS w, sqrt(sum(s * gap_re) ** 2 + sum(s * gap_im) ** 2) AS gap FROM c WHERE d = 0 GROUP BY label) USING (label)
JOIN (SELECT label, max(t) FILTER (WHERE d = 0) AS align, max(t) FILTER (WHERE d > 0) AS moved FROM (SELECT label, d, sqrt(sum(s * re) ** 2 + sum(s * im) ** 2) / sum(sqrt(re * re + im * im)) AS t FROM c GROUP BY label, d) GROUP BY label) USING (label)
JOIN (SELECT label, max(t) AS top FROM (SELECT label, e, sqrt(sum(z * re) ** 2 + sum(z * im) ** 2) AS t FROM (SELECT c.*, e, CASE WHEN substr(md5(e || ':' || k), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS z FROM c, (SELECT unnest(range(64)) AS e) WHERE d = 0) GROUP BY label, e) GROUP BY label) USING (label)""", _MIRROR.format("")))
def dsp11_image_ratio(spark, sf_dir):
    """Imbalance of mirror places of each source: the estimate, its halves, and its nulls of signs and of wrong partners."""
    s = imbalance.sums(_spectra(spark, sf_dir), "label", "iq", "vec_id")
    f = imbalance.features(s, "label")
    return f.select("label", "n", *[r6(c).alias(c) for c in imbalance.FEATURES if c not in ("nu_re", "nu_im")], "detected", "detected_pairs")


def _hourly(spark, sf_dir) -> DataFrame:
    h = win.time_bins(frames(spark, sf_dir), "node", "us", DAY // 24, {"v": F.avg("value")})
    return h.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "v"))), lambda s: s["v"]).alias("series"))  # one value for each hour


def _series(f, fields: str) -> Column:
    names = [x.split()[0] for x in fields.split(", ")]

    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([f(np.asarray(x, dtype=float)) for x in s], columns=names)

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, fields)


@register()
def dsp8_welch(spark, sf_dir):
    """Frequency (cycles a day) of most power in each node's hourly means; null for a node of less than a week."""
    def f(x):
        hz, p = kernels.welch(x, 24.0, 7.0)
        at = int(p[1:].argmax()) + 1 if len(p) > 1 else None
        return [None, None] if at is None else [round(float(hz[at]), 6), round(float(p[at]), 6)]

    return _hourly(spark, sf_dir).select("node", _series(f, "peak double, power double")("series").alias("o")).select("node", "o.*")


#: Vectors in the role of series: rate (Hz) and seconds of a segment.
RATE, SEGMENT_S = 10.0, 6.4
_RHYTHM = (
    "x AS (SELECT vec_id, label, unnest(range(64)) AS n, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS x FROM embeddings), "
    "c AS (SELECT vec_id, label, n, x - avg(x) OVER w - (n - 31.5) * sum(x * (n - 31.5)) OVER w / sum((n - 31.5) * (n - 31.5)) OVER w AS x FROM x WINDOW w AS (PARTITION BY vec_id)), "
    "s AS (SELECT vec_id, label, m, pow(sum(y * cos(2 * pi() * m * n / 64)), 2) + pow(sum(y * sin(2 * pi() * m * n / 64)), 2) AS p FROM (SELECT *, x * (0.5 - 0.5 * cos(2 * pi() * n / 63)) AS y FROM c), (SELECT unnest(range(33)) AS m) GROUP BY 1, 2, 3), "
    "b AS (SELECT vec_id, label, arg_max(m, p) FILTER (WHERE m * 0.15625 BETWEEN 0.1 AND 0.55) AS line, max(p) FILTER (WHERE m * 0.15625 BETWEEN 0.1 AND 0.55) / median(p) FILTER (WHERE m * 0.15625 BETWEEN 0.7 AND 2.5) AS snr FROM s GROUP BY 1, 2), "
    "t AS (SELECT *, line * 0.15625 AS hz FROM b WHERE line = 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY snr DESC, vec_id) <= 10), "
    "g AS (SELECT *, median(hz) OVER (PARTITION BY label) AS mid FROM t)"
)


@register(f"WITH {_RHYTHM} SELECT label, round(any_value(mid), 6) + 0.0 AS hz, round(10 * log10(median(snr) FILTER (WHERE abs(hz - mid) <= 0.05)), 6) + 0.0 AS snr_db, count(*) FILTER (WHERE abs(hz - mid) <= 0.05) AS agree, 10 * log10(median(snr) FILTER (WHERE abs(hz - mid) <= 0.05)) >= 6 AND count(*) FILTER (WHERE abs(hz - mid) <= 0.05) >= 5 AS present FROM g GROUP BY label")
def dsp9_rhythm(spark, sf_dir):
    """A common rhythm over the vectors of each label: the median of the ten clearest peaks, and how clear those are that agree with it."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    f = lambda x: list(kernels.band_peak(x, RATE, seconds=SEGMENT_S) or (None, None))
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", _series(f, "snr double, hz double")(v).alias("o")).select("label", "vec_id", "o.*").where("hz IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("snr"), "vec_id"))
    best = e.withColumn("k", k).where("k <= 10").withColumn("mid", F.median("hz").over(Window.partitionBy("label")))
    near = F.abs(F.col("hz") - F.col("mid")) <= 0.05
    g = best.groupBy("label").agg(F.first("mid").alias("hz"), (10 * F.log10(F.median(F.when(near, F.col("snr"))))).alias("snr_db"), F.count_if(near).alias("agree"))
    return g.select("label", r6("hz").alias("hz"), r6("snr_db").alias("snr_db"), "agree", ((F.col("snr_db") >= 6) & (F.col("agree") >= 5)).alias("present"))


@register()
def dsp12_periodogram(spark, sf_dir):
    """Strongest period (hours) in the longest stretch of each node's hourly means that has no gap, against shuffled blocks; q adjusts for the number of nodes."""
    h = win.time_bins(frames(spark, sf_dir), "node", "us", DAY // 24, {"v": F.avg("value")})
    s = h.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("bin", "v"))).alias("s"))  # one value for each hour

    def run(bins: pd.Series, values: pd.Series) -> pd.DataFrame:
        out = [kernels.periodogram(np.asarray(v, dtype=float)[kernels.longest_run(np.asarray(b))]) for b, v in zip(bins, values, strict=True)]
        return pd.DataFrame([[None if not math.isfinite(x) else round(x, 6) for x in r] for r in out], columns=["period", "share", "p"])

    run.__annotations__ = {"bins": pd.Series, "values": pd.Series, "return": pd.DataFrame}
    o = F.pandas_udf(run, "period double, share double, p double")(F.transform("s", lambda x: x["bin"]), F.transform("s", lambda x: x["v"]))
    return stats.benjamini_hochberg(s.select("node", o.alias("o")).select(F.lit(0).alias("family"), "node", "o.*"), ["family"], "p", "node", "q").select("node", "period", "share", "p", r6("q").alias("q"))


_PERIODS_H = [6.0, 12.0, 24.0, 48.0, 168.0]
_SPANS = "m AS (SELECT node, us // 600000000 AS bin, count(*) FILTER (WHERE value > 50) * 1.0 AS hits, count(*) * 1.0 AS frames FROM fr GROUP BY 1, 2)"
_FOLDED = "c AS (SELECT node, period, least(floor(((bin * 600.0) % (period * 3600)) / (period * 3600) * 24), 23) AS b, sum(hits) AS h, sum(frames) AS f FROM m, (SELECT unnest([6.0, 12.0, 24.0, 48.0, 168.0]) AS period) GROUP BY 1, 2, 3), k AS (SELECT *, h / f AS r, sum(h) OVER w * f / sum(f) OVER w AS e FROM c WINDOW w AS (PARTITION BY node, period))"


@register(_sql("SELECT node, CAST(period AS DOUBLE) AS hours, CAST(sum(h) AS DOUBLE) AS hits, round(sqrt(pow(sum(r * cos(2 * pi() * (b + 0.5) / 24)), 2) + pow(sum(r * sin(2 * pi() * (b + 0.5) / 24)), 2)) / sum(r), 6) + 0.0 AS resultant, round(sum(pow(h - e, 2) / e) FILTER (WHERE e > 0), 6) + 0.0 AS chi2, count(*) FILTER (WHERE e > 0) - 1 AS dof, round((max(r) - min(r)) / avg(r), 6) + 0.0 AS depth FROM k GROUP BY node, period HAVING sum(r) > 0", f"{_SPANS}, {_FOLDED}"))
def dsp12_phase_fold(spark, sf_dir):
    """Rate of high values of each node, folded on several periods: how strongly it follows the phase."""
    f = frames(spark, sf_dir)
    m = f.groupBy("node", (F.floor(F.col("us") / 600_000_000) * 600.0).alias("t")).agg(F.count_if(F.col("value") > 50).alias("hits"), F.count(F.lit(1)).alias("frames"))
    g = stats.phase_fold(m, ["node"], "t", "hits", "frames", [p * 3600 for p in _PERIODS_H]).where("resultant IS NOT NULL")
    return g.select("node", (F.col("period") / 3600).alias("hours"), "hits", r6("resultant").alias("resultant"), r6("chi2").alias("chi2"), "dof", r6("depth").alias("depth"))


_DETRENDED = "d0 AS (SELECT node, us // 86400000000 AS bin, median(value) AS v FROM fr GROUP BY 1, 2), d1 AS (SELECT node, bin * 1.0::DOUBLE AS t, bin - avg(bin) OVER w AS x, v - avg(v) OVER w AS v, count(*) OVER w AS n FROM d0 WINDOW w AS (PARTITION BY node)), d2 AS (SELECT node, n, t, v - x * sum(x * v) OVER w / sum(x * x) OVER w AS v FROM d1 WHERE n >= 20 WINDOW w AS (PARTITION BY node)), d3 AS (SELECT node, n, period, v, cos(2 * pi() * t / period) AS c, sin(2 * pi() * t / period) AS s FROM d2, (SELECT unnest(range(3, 15)) AS period)), d4 AS (SELECT node, period, any_value(n) AS n, var_pop(c) AS cc, var_pop(s) AS ss, var_pop(v) AS vv, covar_pop(c, s) AS cs, covar_pop(c, v) AS cv, covar_pop(s, v) AS sv FROM d3 GROUP BY 1, 2)"


@register(_sql("SELECT node, CAST(period AS DOUBLE) AS days, n, round((cv * cv * ss - 2 * cv * sv * cs + sv * sv * cc) / (vv * (cc * ss - cs * cs)), 6) + 0.0 AS r2 FROM d4", _DETRENDED))
def dsp12_sinusoid_scan(spark, sf_dir):
    """How much of each node's days without their line a sinusoid of each period explains."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")})
    return stats.sinusoid_scan(d, ["node"], "bin", "v", [float(p) for p in range(3, 15)]).select("node", F.col("period").alias("days"), "n", r6("r2").alias("r2"))


@register()
def win9_change_points(spark, sf_dir):
    """The five largest shifts of each node that are more than a width apart."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")})
    s = win.shift_scores(d, "node", "bin", "v", 5).where("shift IS NOT NULL").select("node", "bin", "shift")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[kernels.suppress(pdf["shift"].abs().to_numpy(), pdf["bin"].to_numpy(), 5)]

    return s.groupBy("node").applyInPandas(run, "node string, bin bigint, shift double").select("node", "bin", r6("shift").alias("shift"))


def _walk_sql(rows: str, key: str, first: str, then: str, out: str) -> str:
    """A recursion along each key's rows: `rows` numbers them (i), `first` and `then` give the state as columns, o is the row and r the state before it."""
    return f"WITH RECURSIVE {FR}, o AS MATERIALIZED ({rows}), r AS (SELECT o.*, {first} FROM o WHERE i = 1 UNION ALL SELECT o.*, {then} FROM r JOIN o ON o.{key} = r.{key} AND o.i = r.i + 1) {out}"


_NUMBERED = "row_number() OVER (PARTITION BY source ORDER BY us, row_no) AS i"


@register(_walk_sql(f"SELECT source, row_no, us, us % 8589934592 AS device, {_NUMBERED} FROM fr", "source", "us AS wall, device AS dev, us AS wall_us, true AS anchored", *(lambda near, t: (f"CASE WHEN {near} THEN r.wall ELSE o.us END, CASE WHEN {near} THEN r.dev ELSE o.device END, CASE WHEN {near} THEN {t} ELSE o.us END, NOT ({near})",))("abs(r.wall + o.device - r.dev - o.us) <= 5000000", "r.wall + o.device - r.dev"), "SELECT source, us, row_no, CAST(wall_us AS BIGINT) AS wall_us, anchored FROM r"))
def win2_anchored_clock(spark, sf_dir):
    """Wall time from the device clock, anchored anew after a jump of more than five seconds."""
    f = frames(spark, sf_dir).withColumn("device", F.col("us") % (1 << 33))
    return recursive.walk(f, ["source"], ORDER, recursive.Anchor, recursive.Anchor.step, ["us", "device"], "wall_us bigint, anchored boolean", ["wall_us", "anchored"])


@register(_walk_sql(f"SELECT source, us, row_no, value, {_NUMBERED} FROM fr", "source", "value AS f, value AS s", "r.f + 0.05 * (o.value - r.f), r.s + 0.002 * (o.value - r.s)", "SELECT source, us, row_no, round(f, 6) + 0.0 AS fast, round(s, 6) + 0.0 AS slow FROM r"))
def win15_ema(spark, sf_dir):
    """A fast and a slow moving average of each source."""
    w = recursive.walk(frames(spark, sf_dir), ["source"], ORDER, lambda: (recursive.Ema(0.05), recursive.Ema(0.002)), lambda s, x: (s[0].step(x), s[1].step(x)), ["value"], "fast double, slow double", ["fast", "slow"])
    return w.select("source", *ORDER, r6("fast").alias("fast"), r6("slow").alias("slow"))


_LINKS = (
    "h AS (SELECT source % 4 AS site, node, us // 3600000000 AS bin, avg(value) AS v FROM fr GROUP BY 1, 2, 3), "
    "b AS (SELECT site, node, avg(v) AS m, stddev_pop(v) AS s FROM h GROUP BY 1, 2), "
    "z AS (SELECT site, bin, list_reverse_sort(list((v - m) / s) FILTER (WHERE s > 0)) AS z FROM h JOIN b USING (site, node) GROUP BY 1, 2), "
    "l AS (SELECT site, count(*) AS links FROM b GROUP BY 1), "
    "o AS MATERIALIZED (SELECT site, bin, coalesce(z[1], '-inf'::DOUBLE) AS top, CASE WHEN links = 1 THEN coalesce(z[1], '-inf'::DOUBLE) ELSE coalesce(z[2], '-inf'::DOUBLE) END AS second, row_number() OVER (PARTITION BY site ORDER BY bin) AS i FROM z JOIN l USING (site))"
)
_ON = "(o.second > 1.0 OR o.top > 2.0)"


@register(f"WITH RECURSIVE {FR}, {_LINKS}, r AS (SELECT site, bin, i, false AS active, CASE WHEN {_ON} THEN 1 ELSE 0 END AS run FROM o WHERE i = 1 UNION ALL SELECT site, bin, i, CASE WHEN run >= CASE WHEN was THEN 3 ELSE 2 END THEN NOT was ELSE was END, CASE WHEN run >= CASE WHEN was THEN 3 ELSE 2 END THEN 0 ELSE run END FROM (SELECT o.site, o.bin, o.i, r.active AS was, CASE WHEN CASE WHEN r.active THEN o.top < 0.5 ELSE {_ON} END THEN r.run + 1 ELSE 0 END AS run FROM r JOIN o ON o.site = r.site AND o.i = r.i + 1)) SELECT site, bin, active FROM r")
def win16_hysteresis(spark, sf_dir):
    """Activity of each site over its links' hourly z-scores: hold times keep it from flickering."""
    h = win.time_bins(frames(spark, sf_dir).withColumn("site", F.col("source") % 4), ["site", "node"], "us", DAY // 24, {"v": F.avg("value")})
    b = h.groupBy("site", "node").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    links = b.groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("links"))
    z = h.join(b, ["site", "node"]).groupBy("site", "bin").agg(F.collect_list(F.when(F.col("s") > 0, F.try_divide(F.col("v") - F.col("m"), F.col("s")))).alias("z")).join(links, "site")  # an entry for each link
    return recursive.walk(z, ["site"], ["bin"], lambda: recursive.Hysteresis(1.0, 2.0, 0.5, 2, 3), lambda s, z, links: (s.step(z, links),), ["z", "links"], "active boolean", ["active"])


_COUNTED = "SELECT source, w AS window, med, iqr, greatest((iqr / 1.35) * (iqr / 1.35), 1.0) AS q, w + 1 AS i FROM (SELECT source, w, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM (SELECT source, value, (row_number() OVER (PARTITION BY source ORDER BY us, row_no) - 1) // 8 AS w FROM fr) GROUP BY source, w HAVING count(*) = 8)"


@register(_walk_sql(_COUNTED, "source", "med AS x, q AS p", "r.x + (r.p + 0.01) / (r.p + 0.01 + o.q) * (o.med - r.x), (r.p + 0.01) * (1 - (r.p + 0.01) / (r.p + 0.01 + o.q))", 'SELECT source, "window", round(x, 6) + 0.0 AS tracked FROM r').replace("AS window,", 'AS "window",'))
def win17_kalman(spark, sf_dir):
    """Tracked median of each source's count windows; a window's quartile range tells its noise."""
    w = win.count_windows(frames(spark, sf_dir), "source", ORDER, 8, {"med": F.median("value"), "q": F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))})
    w = w.select("source", "window", "med", (F.col("q")[1] - F.col("q")[0]).alias("iqr"))
    k = recursive.walk(w, ["source"], ["window"], lambda: recursive.Kalman(0.01), lambda s, med, iqr: (s.step(med, recursive.noise_of(iqr, 1.0)),), ["med", "iqr"], "tracked double", ["tracked"])
    return k.select("source", "window", r6("tracked").alias("tracked"))


_TRACKED = "CASE WHEN o.node <> 'click' THEN r.x WHEN r.x IS NULL THEN o.v ELSE r.x + (r.p + 0.01) / (r.p + 1.01) * (o.v - r.x) END, CASE WHEN o.node <> 'click' THEN r.p WHEN r.x IS NULL THEN 1.0 ELSE (r.p + 0.01) * (1 - (r.p + 0.01) / (r.p + 1.01)) END"


@register(_walk_sql("SELECT *, row_number() OVER (PARTITION BY rx ORDER BY bin, node) AS i FROM (SELECT source % 2 AS rx, node, us // 86400000000 AS bin, median(value) AS v FROM fr GROUP BY 1, 2, 3)", "rx", "CASE WHEN node = 'click' THEN v END AS x, 1.0::DOUBLE AS p", _TRACKED, "SELECT rx, bin, node, round(v - x, 6) + 0.0 AS corrected FROM r"))
def jn14_reference(spark, sf_dir):
    """Day medians of each receiver's nodes less its tracked reference, in order of time; the reference's own rows are what is left of them."""
    d = win.time_bins(frames(spark, sf_dir).withColumn("rx", F.col("source") % 2), ["rx", "node"], "us", DAY, {"v": F.median("value")})
    w = recursive.walk(d, ["rx"], ["bin", "node"], lambda: recursive.Reference("click"), lambda s, node, v: (s.step(node, v),), ["node", "v"], "corrected double", ["corrected"])
    return w.select("rx", "bin", "node", r6("corrected").alias("corrected"))


# --- resampling


@register()
def stat2_permutation(spark, sf_dir):
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"x": F.median("value"), "y": F.count(F.lit(1)).cast("double")})
    return stats.permutation_p(d, ["node"], "x", "y", 20_000)


@register()
def stat3_rotation_null(spark, sf_dir):
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")}).groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "v"))), lambda s: s["v"]).alias("series"))
    f = lambda x: [stats.rotation_p(x, 2 * np.pi * np.arange(len(x)) / 7, 20_000), stats.block_permutation_p(x, (np.arange(len(x)) // 5) % 2, 5, 20_000)]
    return d.select("node", _series(f, "p_week double, p_blocks double")("series").alias("o")).select("node", "o.*")


_PAIRED = _DAY_BINS + """, j AS (SELECT a.node, a.bin, a.v AS x, b.v AS y, a.bin - row_number() OVER (PARTITION BY a.node ORDER BY a.bin) AS run FROM d a JOIN d b ON a.node = b.node AND a.bin = b.bin AND a.rx = 0 AND b.rx = 1),
l AS (SELECT node, run, n FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, run) AS pl FROM (SELECT node, run, count(*) AS n FROM j GROUP BY node, run)) WHERE pl = 1),
s AS MATERIALIZED (SELECT node, bin, x, y, n, row_number() OVER (PARTITION BY node ORDER BY bin) - 1 AS i FROM j JOIN l USING (node, run)),
z AS MATERIALIZED (SELECT a.node, a.n, a.i, w.w, median(b.x) FILTER (WHERE b.i >= a.i) AS x, count(*) FILTER (WHERE b.i >= a.i) AS full_x, median(b.y) AS y FROM s a JOIN (SELECT unnest([5, 15, 30]) AS w) w ON a.n >= 2 * w.w + 5 JOIN s b ON a.node = b.node AND (b.i - a.i + a.n) % a.n < w.w GROUP BY a.node, a.n, a.i, w.w),
k AS MATERIALIZED (SELECT a.node, a.n, a.w, a.i, CASE WHEN a.i + 2 * a.w <= a.n THEN b.x - a.x END AS x, b.y - a.y AS y FROM z a JOIN z b ON a.node = b.node AND a.w = b.w AND b.i = (a.i + a.w) % a.n),
c AS MATERIALIZED (SELECT a.node, a.n, a.w, a.i, (a.i - b.i + a.n) % a.n AS lag, a.x, b.y, CASE WHEN sign(a.x) = sign(b.y) THEN round(least(abs(a.x), abs(b.y)) / 10, 9) ELSE 0 END AS score FROM k a JOIN k b ON a.node = b.node AND a.w = b.w WHERE a.x IS NOT NULL),
o AS (SELECT node, w, n, i, x, y, score FROM (SELECT *, row_number() OVER (PARTITION BY node, w ORDER BY score DESC, i) AS pl FROM c WHERE lag = 0) WHERE pl = 1),
p AS (SELECT node, w, n, i, x, y, score, (1 + over_) / n AS p FROM (SELECT o.node, o.w, o.n, o.i, o.x, o.y, o.score, count(*) FILTER (WHERE m.lag > 0 AND m.top >= o.score) AS over_ FROM o JOIN (SELECT node, w, lag, max(score) AS top FROM c GROUP BY node, w, lag) m ON o.node = m.node AND o.w = m.w GROUP BY ALL))"""


@register(_sql("SELECT p.node, p.w AS width, p.n, s.bin AS boundary, round(p.x, 6) + 0.0 AS step_a, round(p.y, 6) + 0.0 AS step_b, round(p.score, 6) + 0.0 AS score, round(p, 6) + 0.0 AS p, round(min(b) OVER (ORDER BY pl ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS bh FROM (SELECT *, row_number() OVER (ORDER BY p, w) AS pl, least(1.0, count(*) OVER () * p / row_number() OVER (ORDER BY p, w)) AS b FROM p) p JOIN s ON p.node = s.node AND s.i = p.w + p.i", _PAIRED))
def stat3_change_test(spark, sf_dir):
    """The largest step that a node's two receivers have together, against all circular shifts of one of them."""
    d = _day_bins(spark, sf_dir)
    both = d.groupBy("node", "bin").agg(F.max(F.when(F.col("rx") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("rx") == 1, F.col("v"))).alias("b"))
    t = stats.replicated_change(both, ["node"], "bin", "a", "b", unit=10.0)
    return t.select("node", "width", "n", "boundary", *[r6(c).alias(c) for c in ("step_a", "step_b", "score", "p", "bh")])


def _days(spark, sf_dir) -> DataFrame:
    return win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")})


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in ("estimate", "lo", "hi") else c for c in df.columns])


@register()
def stat4_bootstrap(spark, sf_dir):
    return stats.bootstrap_ci(_days(spark, sf_dir), ["node"], "v", draws=4000)


@register()
def stat4_difference(spark, sf_dir):
    """Median of each node's days in the later half less that in the earlier one."""
    half = F.ntile(2).over(win.ordered("node", "bin")) - 1
    return _rounded(stats.bootstrap_two(_days(spark, sf_dir).withColumn("late", half), ["node"], "late", "v", draws=4000))


@register()
def stat4_ratio(spark, sf_dir):
    half = F.ntile(2).over(win.ordered("node", "bin")) - 1
    return _rounded(stats.bootstrap_two(_days(spark, sf_dir).withColumn("late", half), ["node"], "late", "v", "ratio", "mean", draws=4000))


@register()
def stat4_paired(spark, sf_dir):
    """Days of each node at two receivers, paired by day."""
    d = win.time_bins(frames(spark, sf_dir).withColumn("rx", F.col("source") % 2), ["node", "rx"], "us", DAY, {"v": F.median("value")})
    a, b = (d.where(F.col("rx") == i).select("node", "bin", F.col("v").alias(f"v{i}")) for i in (0, 1))
    return _rounded(stats.bootstrap_paired(a.join(b, ["node", "bin"]), ["node"], "v0", "v1", draws=4000))


@register()
def stat4_sessions(spark, sf_dir):
    """Median of each node with whole sources drawn as sessions."""
    return _rounded(stats.bootstrap_sessions(frames(spark, sf_dir), ["node"], "source", "value", draws=4000))


@register()
def stat5_block_bootstrap(spark, sf_dir):
    """Variance of the median of each node's hourly means when days of them are drawn."""
    d = _hourly(spark, sf_dir)
    return d.select("node", _series(lambda x: [stats.block_bootstrap_variance(x, 24)], "variance double")("series").alias("o")).select("node", "o.*")


@register()
def stat8_tails(spark, sf_dir):
    """Exact p-values of each node: correlation with time, sign test of days over 40."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")})
    g = d.groupBy("node").agg(F.corr("v", "bin").alias("r"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") > 20).alias("over"))

    def run(r: pd.Series, n: pd.Series, k: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"p_r": [round(stats.correlation_p(a, int(b)), 9) for a, b in zip(r, n, strict=True)], "p_sign": [round(stats.binomial_two_sided(int(a), int(b)), 9) for a, b in zip(k, n, strict=True)]})

    run.__annotations__ = {"r": pd.Series, "n": pd.Series, "k": pd.Series, "return": pd.DataFrame}
    return g.select("node", "n", F.pandas_udf(run, "p_r double, p_sign double")("r", "n", "over").alias("o")).select("node", "n", "o.*")


@register()
def stat9_detection_floor(spark, sf_dir):
    """The least correlation with time that a node's days could show, next to what they show."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")})
    g = d.groupBy("node").agg(F.corr("v", "bin").alias("r"), F.count(F.lit(1)).alias("n"))

    def run(n: pd.Series) -> pd.Series:
        return n.map(lambda k: round(stats.detection_floor(int(k), 5), 6))

    run.__annotations__ = {"n": pd.Series, "return": pd.Series}
    return g.select("node", "n", r6("r").alias("r"), F.pandas_udf(run, "double")("n").alias("floor"))


@register()
def stat10_model_choice(spark, sf_dir):
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")})

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("bin")
        bic = stats.fit_shapes(s["bin"].to_numpy(dtype=float), s["v"].to_numpy(dtype=float))
        best = min(bic, key=bic.get)
        return pd.DataFrame({"node": [key[0]], "best": [best], "bic": [round(bic[best], 6)], "gain": [round(bic["constant"] - bic[best], 6)]})

    return d.groupBy("node").applyInPandas(run, "node string, best string, bic double, gain double")


# --- clusters


@register()
def ml9_kmeans(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return cluster.kmeans(e, "v", 10).select("vec_id", "label", "cluster")


def _plane(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("embedding")[0] * 10).cast("double").alias("x"), (F.col("embedding")[1] * 10).cast("double").alias("y"))


@register()
def ml10_linkage(spark, sf_dir):
    """Average linkage of grid cells: rows are aggregated to cells first, of which there are few."""
    return cluster.linkage_of_cells(cluster.grid_cells(_plane(spark, sf_dir), ["x", "y"], [0.5, 0.5]), ["x", "y"], 5)


#: The place of a vector's largest component, in the role of a cluster.
_CLUSTER = "p AS (SELECT label, list_position(a, list_max(a)) AS c FROM (SELECT label, list_transform(embedding, lambda x: abs(x)) AS a FROM embeddings))"


def _clusters(spark, sf_dir) -> DataFrame:
    a = F.transform("embedding", F.abs)
    return table(spark, sf_dir, "embeddings").select("label", F.array_position(a, F.array_max(a)).alias("c"))


@register(f"WITH {_CLUSTER}, n AS (SELECT label, c, count(*) AS n FROM p GROUP BY 1, 2), a AS (SELECT sum(k * (k - 1) / 2.0) AS a, sum(k) AS t FROM (SELECT sum(n) AS k FROM n GROUP BY label)), b AS (SELECT sum(k * (k - 1) / 2.0) AS b, sum(m) AS top FROM (SELECT sum(n) AS k, max(n) AS m FROM n GROUP BY c)), x AS (SELECT sum(n * (n - 1) / 2.0) AS ab FROM n) SELECT round((ab - a * b / (t * (t - 1) / 2.0)) / ((a + b) / 2 - a * b / (t * (t - 1) / 2.0)), 6) + 0.0 AS ari, round(top / t, 6) + 0.0 AS purity FROM a, b, x")
def ml11_agreement(spark, sf_dir):
    a = cluster.agreement(_clusters(spark, sf_dir), "label", "c")
    return a.select(r6("ari").alias("ari"), r6("purity").alias("purity"))


@register()
def ml11_cocluster(spark, sf_dir):
    """Whether pairs of labels share clusters more than shuffled labels would."""
    c = cluster.cocluster(_clusters(spark, sf_dir), "label", "c")
    return c.select("a", "b", r6("together").alias("together"), r6("expected").alias("expected"), r6("p").alias("p"))


@register("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT label, count(*) AS m FROM e GROUP BY label), t AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total FROM e a, e b GROUP BY ALL), r AS (SELECT vec_id, max(CASE WHEN t.label = other THEN m END) AS m, max(CASE WHEN t.label = other AND m > 1 THEN total / (m - 1) END) AS a, min(CASE WHEN t.label <> other THEN total / m END) AS b FROM t JOIN n ON t.other = n.label GROUP BY vec_id) SELECT count(*) AS n, round(avg(CASE WHEN b IS NOT NULL THEN CASE WHEN m > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END END), 6) + 0.0 AS silhouette FROM r")
def ml11_silhouette(spark, sf_dir):
    """Mean silhouette of labels, from each vector's distances to all others."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return cluster.silhouette(e, "v", "label").select("n", r6("silhouette").alias("silhouette"))


_TURNS = _MIRROR.format("vec_id % 3 AS session, ") + """, e AS (SELECT session, label, atan2(sum(s * im), sum(s * re)) AS angle FROM c WHERE d = 0 GROUP BY session, label),
t AS (SELECT b.session, b.label, atan2(sin(b.angle - a.angle), cos(b.angle - a.angle)) AS turn FROM e a JOIN e b ON a.label = b.label AND b.session = a.session + 1),
r AS (SELECT session, count(*) AS n, atan2(avg(sin(turn)), avg(cos(turn))) AS shared, sqrt(greatest(0, -2 * ln(least(1, greatest(1e-12, sqrt(avg(sin(turn)) ** 2 + avg(cos(turn)) ** 2)))))) AS spread FROM t GROUP BY session)"""


def _session_turns(spark, sf_dir) -> DataFrame:
    """Imbalance of each source and session, and how its direction turned since the session before."""
    s = _spectra(spark, sf_dir).withColumn("cell", F.col("label").cast("bigint") * 3 + F.col("vec_id") % 3)
    f = imbalance.features(imbalance.sums(s, "cell", "iq", "vec_id"), "cell").where("n > 0")
    e = f.select((F.col("cell") % 3).alias("session"), F.floor(F.col("cell") / 3).alias("label"), F.atan2("kappa_im", "kappa_re").alias("angle"))
    return imbalance.turns(e, "label", "session", "angle")


@register(_sql("SELECT session, label, round(turn, 6) + 0.0 AS turn, round(atan2(sin(turn - shared), cos(turn - shared)), 6) + 0.0 AS own FROM t JOIN r USING (session)", _TURNS))
def ml14_common_rotation(spark, sf_dir):
    """Turn of each source's imbalance from one session to the next, and what is left of it without the turn that all sources share."""
    t = _session_turns(spark, sf_dir)
    return imbalance.without_shared(t, "session").select("session", F.col("label").cast("int").alias("label"), r6("turn").alias("turn"), r6("own").alias("own"))


@register(_sql("SELECT session, n, round(shared, 6) + 0.0 AS shared, round(spread, 6) + 0.0 AS spread, round(spread / abs(shared), 6) + 0.0 AS ratio, round(1 - rest / total, 6) + 0.0 AS removed, CASE WHEN n < 3 THEN 'TOO FEW' WHEN spread / abs(shared) <= 0.25 THEN 'COMMON' WHEN spread / abs(shared) > 1 THEN 'NOT COMMON' ELSE 'PARTIAL' END AS verdict FROM r JOIN (SELECT session, sum(turn * turn) AS total, sum(atan2(sin(turn - shared), cos(turn - shared)) ** 2) AS rest FROM t JOIN r USING (session) GROUP BY session) USING (session)", _TURNS))
def ml14_common_mode(spark, sf_dir):
    """Whether the sources of a session turned together: circular mean and spread, their ratio, and the share of energy that the mean takes off."""
    t = imbalance.common_mode(_session_turns(spark, sf_dir), "session")
    return t.select("session", "n", *[r6(c).alias(c) for c in ("shared", "spread", "ratio", "removed")], "verdict")


# --- streams: run over what is there, to the end


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return streams.frames_of(streams.landing(spark, f"{sf_dir.rstrip('/')}/events.parque[t]", schema))


def _end(stream: DataFrame, mode: str = "append") -> DataFrame:
    path = scratch(stream.sparkSession, "stream")
    return streams.run_to_end(stream, f"{path}/out", f"{path}/checkpoint", mode)


@register(_sql("SELECT node, us // 86400000000 * 86400000000 AS start_us, count(*) AS n, round(median(value), 6) + 0.0 AS med FROM fr GROUP BY 1, 2 HAVING min(us // 86400000000 * 86400000000) + 86400000000 <= (SELECT max(us) FROM fr) - 3600000000"))
def str8_tumbling(spark, sf_dir):
    """Day windows in append mode: those that the watermark, an hour behind, has passed."""
    return _end(streams.tumbling(_stream(spark, sf_dir), "1 day", "1 hour", ["node"])).select("node", "start_us", "n", r6("med").alias("med"))


@register(_sql("SELECT node, s AS start_us, count(*) AS n, round(stddev_pop(value), 6) + 0.0 AS sd FROM (SELECT node, value, unnest([us // 43200000000 * 43200000000, us // 43200000000 * 43200000000 - 43200000000]) AS s FROM fr) GROUP BY 1, 2 HAVING s + 86400000000 <= (SELECT max(us) FROM fr) - 3600000000"))
def str9_sliding(spark, sf_dir):
    return _end(streams.sliding(_stream(spark, sf_dir), "1 day", "12 hours", "1 hour", ["node"])).select("node", "start_us", "n", r6("sd").alias("sd"))


@register(_sql("SELECT source, min(us) AS start_us, max(us) + 86400000000 AS end_us, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY us, row_no ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY source ORDER BY us, row_no) <= 86400000000 THEN 0 ELSE 1 END AS new FROM fr)) GROUP BY source, run HAVING max(us) + 86400000000 <= (SELECT max(us) FROM fr) - 3600000000"))
def str10_sessions(spark, sf_dir):
    """Sessions end after a day without frames."""
    return _end(streams.sessions(_stream(spark, sf_dir), "1 day", "1 hour", ["source"]))


@register(_sql("SELECT source, count(*) AS n, max(us) AS last_us FROM fr GROUP BY source"))
def str14_heavy_hitters(spark, sf_dir):
    return _end(streams.heavy_hitters(_stream(spark, sf_dir)), "complete")


@register(_sql("SELECT source, CAST(us AS BIGINT) AS us, round(med, 6) + 0.0 AS med, round(iqr, 6) + 0.0 AS iqr FROM (SELECT source, w, max(us) AS us, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM (SELECT source, us, value, (row_number() OVER (PARTITION BY source ORDER BY us, row_no) - 1) // 8 AS w FROM fr) GROUP BY source, w HAVING count(*) = 8)"))
def str3_count_windows(spark, sf_dir):
    """Count windows from keyed state; the columns that SQL can say."""
    return _end(streams.live_windows(_stream(spark, sf_dir))).select("source", "us", r6("med").alias("med"), r6("iqr").alias("iqr"))


#: A verdict's distance and the step of its model, from the state before (n, mx, my, xx, yy, xy, streak) and a window's features.
_D = "((vy * dx * dx - 2 * c * dx * dy + vx * dy * dy) / (vx * vy - c * c))"
_SEEN = f"SELECT *, CASE WHEN n < 5 THEN 'LEARNING' WHEN {_D} <= 5.991 THEN 'STABLE' WHEN {_D} <= 9.210 THEN 'DRIFTING' WHEN streak + 1 >= 20 THEN 'REBASE' ELSE 'ANOMALY' END AS said FROM (SELECT o.source, o.i, o.us, o.med, o.iqr, o.q, r.x, r.p, r.n, r.mx, r.my, r.xx, r.yy, r.xy, r.streak, greatest(r.xx / greatest(r.n - 1, 1), 1.0) AS vx, greatest(r.yy / greatest(r.n - 1, 1), 1e-8) AS vy, r.xy / greatest(r.n - 1, 1) AS c, o.med - r.mx AS dx, o.iqr - r.my AS dy FROM r JOIN o ON o.source = r.source AND o.i = r.i + 1)"
_MODEL = f"SELECT source, i, us, med, iqr, q, x + (p + 0.01) / (p + 0.01 + q) * (med - x) AS x, (p + 0.01) * (1 - (p + 0.01) / (p + 0.01 + q)) AS p, said AS verdict, CASE said WHEN 'ANOMALY' THEN n WHEN 'REBASE' THEN 1 ELSE n + 1 END AS n, CASE said WHEN 'ANOMALY' THEN mx WHEN 'REBASE' THEN med ELSE mx + dx / (n + 1) END AS mx, CASE said WHEN 'ANOMALY' THEN my WHEN 'REBASE' THEN iqr ELSE my + dy / (n + 1) END AS my, CASE said WHEN 'ANOMALY' THEN xx WHEN 'REBASE' THEN 0 ELSE xx + dx * (dx - dx / (n + 1)) END AS xx, CASE said WHEN 'ANOMALY' THEN yy WHEN 'REBASE' THEN 0 ELSE yy + dy * (dy - dy / (n + 1)) END AS yy, CASE said WHEN 'ANOMALY' THEN xy WHEN 'REBASE' THEN 0 ELSE xy + dx * (dy - dy / (n + 1)) END AS xy, CASE said WHEN 'ANOMALY' THEN streak + 1 ELSE 0 END AS streak FROM ({_SEEN})"
_WINDOWS = "SELECT source, w + 1 AS i, CAST(us AS BIGINT) AS us, med, iqr, greatest((iqr / 1.35) * (iqr / 1.35), 1.0) AS q FROM (SELECT source, w, max(us) AS us, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM (SELECT source, us, value, (row_number() OVER (PARTITION BY source ORDER BY us, row_no) - 1) // 8 AS w FROM fr) GROUP BY source, w HAVING count(*) = 8)"


@register(f"WITH RECURSIVE {FR}, o AS MATERIALIZED ({_WINDOWS}), r AS (SELECT *, med AS x, q AS p, 'LEARNING' AS verdict, 1::BIGINT AS n, med AS mx, iqr AS my, 0.0::DOUBLE AS xx, 0.0::DOUBLE AS yy, 0.0::DOUBLE AS xy, 0::BIGINT AS streak FROM o WHERE i = 1 UNION ALL {_MODEL}) SELECT source, us, round(x, 6) + 0.0 AS tracked, verdict FROM r")
def str5_live_verdicts(spark, sf_dir):
    """Tracked value and verdict of each window from keyed state, by its median and quartile range against the source's own model."""
    return _end(streams.live_windows(_stream(spark, sf_dir))).select("source", "us", r6("tracked").alias("tracked"), "verdict")


@register()
def str15_health(spark, sf_dir):
    """Days of each node that the watermark has passed. Frames have no sequence number of their node, so `lost` is null."""
    h = _end(streams.health(_stream(spark, sf_dir), "1 hour"))
    return h.select(*[r6(c).alias(c) if t == "double" and c not in ("rate", "trend") else c for c, t in h.dtypes])
