"""Rank statistics, multiple testing, robust slopes, lag curves, and seeded resampling.

What SQL can say stays in Spark. Resampling needs random draws: it runs as a grouped pandas function, seeded from the group's
key, over one number for each block or session of a group, which is what these tests are about; raw frames are aggregated before.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .windows import rank_ties

#: Points of a series of which all pairs are formed.
MOST_POINTS = 2048


def spearman(df: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, rho): correlation of ranks, ties sharing their mean rank."""
    d = _ranked_apart(df, group, [x, y])
    return d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("__r0", "__r1").alias("rho"))


def partial(rxy: Column, rxz: Column, ryz: Column) -> Column:
    """Correlation of x and y with z held fixed."""
    return (rxy - rxz * ryz) / F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz))


def partial_spearman(df: DataFrame, group: list[str], x: str, y: str, z: str) -> DataFrame:
    d = _ranked_apart(df, group, [x, y, z])
    g = d.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.corr("__r0", "__r1").alias("xy"), F.corr("__r0", "__r2").alias("xz"), F.corr("__r1", "__r2").alias("yz"))
    return g.select(*group, "n", partial(F.col("xy"), F.col("xz"), F.col("yz")).alias("rho"))


def holm(df: DataFrame, family: list[str], p: str, tie: str, out: str = "holm") -> DataFrame:
    """Step-down adjusted p-values."""
    w = Window.partitionBy(*family)
    o = w.orderBy(p, tie)
    step = df.withColumn("__s", F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(o) + 1) * F.col(p)))
    return step.withColumn(out, F.max("__s").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, tie: str, out: str = "bh") -> DataFrame:
    """Step-up adjusted p-values."""
    w = Window.partitionBy(*family)
    o = w.orderBy(p, tie)
    step = df.withColumn("__s", F.least(F.lit(1.0), F.count(F.lit(1)).over(w) * F.col(p) / F.row_number().over(o)))
    return step.withColumn(out, F.min("__s").over(o.rowsBetween(0, Window.unboundedFollowing))).drop("__s")


def sidak(p: Column, m: Column) -> Column:
    return 1 - F.pow(1 - p, m)


def theil_sen(df: DataFrame, group: list[str], t: str, y: str, most: int = MOST_POINTS) -> DataFrame:
    """(group, slope): median of the slopes of all pairs of a series' points. A group of more than `most` points is first brought to the medians (of t and y) of `most` equal spans of t, so pairs are bounded."""
    w = Window.partitionBy(*group)
    span = F.greatest(F.max(t).over(w) - F.min(t).over(w), F.lit(1e-300))
    place = F.when(F.count(F.lit(1)).over(w) > most, F.least(F.floor((F.col(t) - F.min(t).over(w)) / span * most), F.lit(most - 1)))
    d = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).withColumn("__k", place)
    key = F.coalesce(F.col("__k").cast("double"), F.col(t).cast("double"))
    few = d.where("__k IS NULL").select(*group, F.col(t).cast("double").alias(t), F.col(y).cast("double").alias(y))
    many = d.where("__k IS NOT NULL").groupBy(*group, key.alias("__key")).agg(F.median(t).alias(t), F.median(y).alias(y)).select(*group, t, y)
    d = few.unionByName(many)
    a = d.select(*group, F.col(t).alias("__ta"), F.col(y).alias("__ya"))
    b = d.select(*[F.col(g).alias(f"__{g}") for g in group], F.col(t).alias("__tb"), F.col(y).alias("__yb"))
    pairs = a.join(b, [F.col(g) == F.col(f"__{g}") for g in group] + [F.col("__ta") < F.col("__tb")])
    return pairs.groupBy(*group).agg(F.median((F.col("__yb") - F.col("__ya")) / (F.col("__tb") - F.col("__ta"))).alias("slope"))


def variogram(df: DataFrame, group: list[str], index: str, y: str, lags: list[int]) -> DataFrame:
    """(group, lag, pairs, typical, drift_sd): median absolute difference at each lag of the index, which may have gaps, and the standard deviation of a drift with this median."""
    far = df.select(*group, F.col(index).alias("__i"), F.col(y).alias("__y"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn(index, F.col("__i") + F.col("lag"))
    d = df.join(far.select(*group, index, "lag", "__y"), [*group, index])
    return d.groupBy(*group, "lag").agg(F.count(F.lit(1)).alias("pairs"), F.median(F.abs(F.col(y) - F.col("__y"))).alias("typical")).withColumn("drift_sd", 1.4826 * F.col("typical") / math.sqrt(2.0))


def autocorrelation(df: DataFrame, group: list[str], index: str, y: str, lags: list[int]) -> DataFrame:
    """(group, lag, pairs, r): correlation of a series with itself, each lag over the pairs that are there."""
    far = df.select(*group, F.col(index).alias("__i"), F.col(y).alias("__y"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn(index, F.col("__i") + F.col("lag"))
    return df.join(far.select(*group, index, "lag", "__y"), [*group, index]).groupBy(*group, "lag").agg(F.count(F.lit(1)).alias("pairs"), F.corr(y, "__y").alias("r"))


def allan(df: DataFrame, group: list[str], index: str, y: str, taus: list[int], least: float = 0.9, pairs: int = 3) -> DataFrame:
    """(group, tau, n, independent, adev): overlapping Allan deviation. df has a row for each index, null where there is no value.

    A block of tau rows counts if at least the share `least` of them have a value; adev is null under `pairs` pairs of blocks.
    independent: pairs of blocks without overlap. Running sums are made once, and each tau is a lag of them, so all share one sort.
    """
    w = Window.partitionBy(*group).orderBy(index)
    s = df.select(*group, index, F.coalesce(F.sum(y).over(w), F.lit(0.0)).alias("__s"), F.count(y).over(w).alias("__c"), F.row_number().over(w).alias("__i"), F.count(F.lit(1)).over(Window.partitionBy(*group)).alias("__n"))
    back = lambda c, k: F.lag(c, k, 0).over(w)

    def gap(m: int) -> Column:
        late, early = F.col("__c") - back("__c", m), back("__c", m) - back("__c", 2 * m)
        need = max(1, math.ceil(least * m))
        d = F.try_divide(F.col("__s") - back("__s", m), late) - F.try_divide(back("__s", m) - back("__s", 2 * m), early)
        return F.when((F.col("__i") >= 2 * m) & (late >= need) & (early >= need), d)

    rows = s.select(*group, "__n", F.array(*[gap(m) for m in taus]).alias("__gaps")).select(*group, "__n", F.posexplode("__gaps").alias("__k", "d"))
    tau = F.element_at(F.array(*[F.lit(m) for m in taus]), F.col("__k") + 1)
    g = rows.groupBy(*group, tau.alias("tau")).agg(F.count("d").alias("n"), F.avg(F.col("d") * F.col("d")).alias("s"), F.first("__n").alias("__n"))
    enough = F.col("n") >= pairs
    return g.select(*group, "tau", "n", F.when(enough, F.floor(F.col("__n") / (2 * F.col("tau"))).cast("bigint")).otherwise(0).alias("independent"), F.when(enough, F.sqrt(F.col("s") / 2)).alias("adev"))


def loglog_slope(df: DataFrame, group: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """(group, points, slope) of log y over log x, of points where both are positive; null for fewer than `least`."""
    d = df.where((F.col(x) > 0) & (F.col(y) > 0))
    g = d.groupBy(*group).agg(F.count(F.lit(1)).alias("points"), F.regr_slope(F.log10(y), F.log10(x)).alias("slope"))
    return g.select(*group, "points", F.when(F.col("points") >= least, F.col("slope")).alias("slope"))


# --- resampling


def seed_of(key: tuple, seed: int) -> int:
    return zlib.crc32(repr((seed, *map(str, key))).encode())


_STATS = {"median": np.median, "mean": np.mean}
#: Numbers of resampled values that are in memory together.
DRAWN_AT_ONCE = 4_000_000


def _draw(rng: np.random.Generator, v: np.ndarray, draws: int, stat: str) -> np.ndarray:
    """The statistic of `draws` resamples of v (rows of v, if it has two axes, stay together)."""
    step = max(1, DRAWN_AT_ONCE // max(1, len(v)))
    return np.concatenate([_STATS[stat](v[rng.integers(0, len(v), (min(step, draws - i), len(v)))], axis=1) for i in range(0, draws, step)])


def _interval(own: float, boot: np.ndarray, level: float) -> dict[str, list]:
    boot = boot[np.isfinite(boot)]
    lo, hi = (float(np.quantile(boot, q)) for q in ((1 - level) / 2, (1 + level) / 2)) if len(boot) else (None, None)
    return {"estimate": [float(own)], "lo": [lo], "hi": [hi]}


_NO_INTERVAL = {"estimate": [None], "lo": [None], "hi": [None]}


def _by_group(df: DataFrame, group: list[str], cols: list[str], counts: list[str], f: Callable[[np.random.Generator, pd.DataFrame], tuple[list[int], dict]], seed: int) -> DataFrame:
    """(group, counts, estimate, lo, hi) from f(generator, rows without gaps, in a fixed order)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, out = f(np.random.default_rng(seed_of(key, seed)), pdf[cols].dropna().sort_values(cols))
        return pd.DataFrame({**dict(zip(group, ([k] for k in key), strict=True)), **dict(zip(counts, ([x] for x in n), strict=True)), **out})

    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return df.groupBy(*group).applyInPandas(one, f"{kinds}, {', '.join(f'{c} bigint' for c in counts)}, estimate double, lo double, hi double")


def bootstrap_ci(df: DataFrame, group: list[str], y: str, stat: str = "median", draws: int = 2000, level: float = 0.95, seed: int = 0, least: int = 3) -> DataFrame:
    """(group, n, estimate, lo, hi) by resampling a group's values; null for fewer than `least`."""

    def f(rng, pdf):
        v = pdf[y].to_numpy(dtype=float)
        return [len(v)], _interval(_STATS[stat](v), _draw(rng, v, draws, stat), level) if len(v) >= least else _NO_INTERVAL

    return _by_group(df, group, [y], ["n"], f, seed)


def bootstrap_two(df: DataFrame, group: list[str], side: str, y: str, how: str = "difference", stat: str = "median", draws: int = 2000, level: float = 0.95, seed: int = 0, least: int = 3) -> DataFrame:
    """(group, n0, n1, estimate, lo, hi): difference (or ratio) of the statistic of rows with side 1 to those with side 0, both resampled by themselves."""
    gap = {"difference": np.subtract, "ratio": np.divide}[how]

    def f(rng, pdf):
        a, b = (pdf.loc[pdf[side] == i, y].to_numpy(dtype=float) for i in (0, 1))
        if min(len(a), len(b)) < least:
            return [len(a), len(b)], _NO_INTERVAL
        with np.errstate(divide="ignore", invalid="ignore"):
            low = _draw(rng, a, draws, stat)
            return [len(a), len(b)], _interval(gap(_STATS[stat](b), _STATS[stat](a)), gap(_draw(rng, b, draws, stat), low), level)

    return _by_group(df, group, [side, y], ["n0", "n1"], f, seed)


def bootstrap_paired(df: DataFrame, group: list[str], a: str, b: str, stat: str = "median", draws: int = 2000, level: float = 0.95, seed: int = 0, least: int = 3) -> DataFrame:
    """(group, n, estimate, lo, hi) of b - a, resampling pairs."""
    return bootstrap_ci(df.withColumn("__d", F.col(b) - F.col(a)), group, "__d", stat, draws, level, seed, least)


def bootstrap_sessions(df: DataFrame, group: list[str], session: str, y: str, stat: str = "median", draws: int = 2000, level: float = 0.95, seed: int = 0, least: int = 3) -> DataFrame:
    """(group, sessions, estimate, lo, hi): whole sessions are resampled, each standing for its own statistic, so rows of one session don't count as independent."""
    own = df.groupBy(*group, session).agg((F.median(y) if stat == "median" else F.avg(y)).alias("__y"))
    return bootstrap_ci(own, group, "__y", stat, draws, level, seed, least).withColumnRenamed("n", "sessions")


def bootstrap_difference(a: np.ndarray, b: np.ndarray, draws: int = 2000, level: float = 0.95, seed: int = 0, f=np.median) -> tuple[float, float, float]:
    """Difference of a statistic between two samples, with a percentile interval."""
    rng = np.random.default_rng(seed)
    boot = np.array([f(a[rng.integers(0, len(a), len(a))]) - f(b[rng.integers(0, len(b), len(b))]) for _ in range(draws)])
    return float(f(a) - f(b)), float(np.quantile(boot, (1 - level) / 2)), float(np.quantile(boot, (1 + level) / 2))


def block_bootstrap_variance(v: np.ndarray, block: int, draws: int = 200, seed: int = 0) -> float:
    """Variance of the median when overlapping blocks of a series are drawn until it is as long again."""
    n = len(v)
    if not n:
        return float("nan")
    rng = np.random.default_rng(seed)
    starts = rng.integers(0, max(1, n - block + 1), (draws, -(-n // block)))
    at = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]
    return float(np.median(v[np.minimum(at, n - 1)], axis=1).var(ddof=1))


def permutation_p(df: DataFrame, group: list[str], x: str, y: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(group, n, rho, p): two-sided p-value of a rank correlation when one side is shuffled."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[[x, y]].dropna().sort_values([x, y])
        n = len(d)
        rho = p = None
        if n > 2 and d[x].nunique() > 1 and d[y].nunique() > 1:
            a, b = (d[c].rank().to_numpy() for c in (x, y))
            a, b = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
            rho = float((a * b).mean())
            rng = np.random.default_rng(seed_of(key, seed))
            null = np.array([(a * rng.permutation(b)).mean() for _ in range(draws)])
            p = float((1 + (np.abs(null) >= abs(rho) - 1e-12).sum()) / (draws + 1))
        return pd.DataFrame({**dict(zip(group, ([k] for k in key), strict=True)), "n": [n], "rho": [rho], "p": [p]})

    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    return df.groupBy(*group).applyInPandas(one, f"{kinds}, n bigint, rho double, p double")


def rotation_p(values: np.ndarray, phase: np.ndarray, draws: int = 1000, seed: int = 0) -> float:
    """p-value of the amplitude at a phase when the series is turned against it by random shifts."""
    v = values - values.mean()
    power = lambda s: abs(np.exp(1j * phase) @ np.roll(v, s))
    rng = np.random.default_rng(seed)
    own = power(0)
    return (1 + sum(power(int(s)) >= own for s in rng.integers(1, len(v), draws))) / (draws + 1)


def block_permutation_p(values: np.ndarray, labels: np.ndarray, block: int, draws: int = 1000, seed: int = 0) -> float:
    """p-value of the difference of means between labels 1 and 0 when whole blocks of labels are shuffled."""
    rng = np.random.default_rng(seed)
    n = len(values) // block * block
    v, lab = values[:n], labels[:n].reshape(-1, block)
    gap = lambda x: abs(v[x == 1].mean() - v[x == 0].mean()) if 0 < x.sum() < n else 0.0
    own = gap(lab.reshape(-1))
    return (1 + sum(gap(rng.permutation(lab).reshape(-1)) >= own - 1e-12 for _ in range(draws))) / (draws + 1)


# --- special functions, without SciPy


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by a continued fraction evaluated backwards from a depth that it needs."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    depth = int(60 + 4 * math.sqrt(max(a, b)))
    f = 1.0
    for i in range(depth, 0, -1):
        m = i // 2
        d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        f = 1 + d / f
    return front / f


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    f = 0.0
    for i in range(int(200 + 4 * math.sqrt(x)), 0, -1):
        f = i * (i - a) / (x + 2 * i + 1 - a - f)
    return front / (x + 1 - a - f)


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_tail(x: float, k: float) -> float:
    return gamma_q(k / 2, x / 2)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_inc(k, n - k + 1, p)


def binomial_two_sided(k: int, n: int) -> float:
    """Two-sided sign test."""
    return min(1.0, 2 * min(binomial_tail(k, n, 0.5), 1 - binomial_tail(k + 1, n, 0.5)))


def correlation_p(r: float, n: int) -> float:
    return 1.0 if n < 3 else 0.0 if abs(r) >= 1 else t_tail(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def critical_r(n: int, alpha: float = 0.05) -> float:
    """Least correlation that is significant with n points."""
    lo, hi = 0.0, 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if correlation_p(mid, n) > alpha else (lo, mid)
    return hi


def detection_floor(n: int, tests: int, alpha: float = 0.05) -> float:
    """Least correlation that n points show after a Sidak correction for several tests."""
    return critical_r(n, 1 - (1 - alpha) ** (1 / tests))


def ks_uniform(p: np.ndarray) -> tuple[float, float]:
    """Largest distance of the empirical distribution from the uniform one, and its asymptotic p-value."""
    s, n = np.sort(p), len(p)
    d = float(max((np.arange(1, n + 1) / n - s).max(), (s - np.arange(n) / n).max()))
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return d, float(min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * math.exp(-2 * j * j * x * x) for j in range(1, 101)))))


def range_p(w: float, n: int) -> float:
    """P(range of n uniform values <= w)."""
    w = min(max(w, 0.0), 1.0)
    return n * w ** (n - 1) - (n - 1) * w**n if n > 1 else float("nan")


def range_test(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """(group, n, span, p): range of values in [0, 1], and how probable one as small is among uniform ones; null for a single value."""
    n, w = F.col("n"), F.least(F.greatest("span", F.lit(0.0)), F.lit(1.0))
    g = df.groupBy(*group).agg(F.count(x).alias("n"), (F.max(x) - F.min(x)).alias("span"))
    return g.select(*group, "n", "span", F.when(n > 1, n * F.pow(w, n - 1) - (n - 1) * F.pow(w, n)).alias("p"))


def ks_test(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """(group, n, d, p): largest distance of values in [0, 1] from the uniform distribution, and its asymptotic p-value."""
    w = Window.partitionBy(*group)
    r = df.where(F.col(x).isNotNull()).select(*group, F.col(x).alias("__x"), F.row_number().over(w.orderBy(x)).alias("__i"), F.count(F.lit(1)).over(w).alias("n"))
    g = r.groupBy(*group, "n").agg(F.max(F.greatest(F.col("__i") / F.col("n") - F.col("__x"), F.col("__x") - (F.col("__i") - 1) / F.col("n"))).alias("d"))
    z = (F.sqrt("n") + 0.12 + F.lit(0.11) / F.sqrt("n")) * F.col("d")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * j * j * z * z))
    return g.select(*group, "n", "d", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * terms)).alias("p"))


def effective_number(df: DataFrame, variable: str, index: str, y: str) -> DataFrame:
    """One row (variables, effective): how many independent tests as many correlated variables amount to.

    It follows from the variance of the eigenvalues of their correlations, which is that of the correlations' squares, so no matrix
    is formed: pairs of variables meet on the index. Pairs without a correlation count as uncorrelated.
    """
    a, b = (df.select(F.col(variable).alias(f"__{s}"), F.col(index).alias("__i"), F.col(y).alias(f"__y{s}")) for s in "ab")
    pairs = a.join(b, "__i").where("__a < __b").groupBy("__a", "__b").agg(F.corr("__ya", "__yb").alias("r"))
    squares = pairs.agg(F.coalesce(F.sum(F.when(~F.isnan("r"), F.col("r") * F.col("r"))), F.lit(0.0)).alias("s"))
    m = F.col("variables")
    return df.agg(F.countDistinct(variable).alias("variables")).crossJoin(squares).select("variables", F.when(m > 1, 1 + (m - 1) * (1 - 2 * F.col("s") / ((m - 1) * m))).otherwise(1.0).alias("effective"))  # one row each


# --- periods


def phase_fold(df: DataFrame, group: list[str], t: str, hits: str, frames: str, periods: list[float], bins: int = 24) -> DataFrame:
    """(group, period, hits, frames, resultant, modulation, chi2, dof, depth): rate of hits for each frame, folded on each period.

    df has sums of hits and frames of short spans at t. Rates by phase take out that frames are uneven in phase; a rate
    r0 (1 + m cos) has the resultant m / 2. chi2 compares hits with an even rate; depth is the range of rates over their mean.
    """
    every = F.explode(F.array(*[F.lit(float(p)) for p in periods]))
    d = df.select(*group, F.col(t).cast("double").alias("__t"), F.col(hits).cast("double").alias("__h"), F.col(frames).cast("double").alias("__f"), every.alias("period"))
    b = F.least(F.floor(F.pmod("__t", F.col("period")) / F.col("period") * bins), F.lit(bins - 1))
    c = d.groupBy(*group, "period", b.alias("__b")).agg(F.sum("__h").alias("h"), F.sum("__f").alias("f")).where("f > 0")
    w = Window.partitionBy(*group, "period")
    c = c.withColumn("r", F.col("h") / F.col("f")).withColumn("e", F.sum("h").over(w) * F.col("f") / F.sum("f").over(w))
    turn = 2 * F.pi() * (F.col("__b") + 0.5) / bins
    g = c.groupBy(*group, "period").agg(F.sum("h").alias("hits"), F.sum("f").alias("frames"), F.sum(F.col("r") * F.cos(turn)).alias("x"), F.sum(F.col("r") * F.sin(turn)).alias("y"), F.sum("r").alias("s"), F.sum(F.when(F.col("e") > 0, F.pow(F.col("h") - F.col("e"), 2) / F.col("e"))).alias("chi2"), F.count_if(F.col("e") > 0).alias("cells"), ((F.max("r") - F.min("r"))).alias("wide"), F.avg("r").alias("usual"))
    some = F.col("s") > 0
    long = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / F.col("s")
    return g.select(*group, "period", "hits", "frames", F.when(some, long).alias("resultant"), F.when(some, 2 * long).alias("modulation"), F.when(some, F.col("chi2")).alias("chi2"), F.when(some, F.col("cells") - 1).alias("dof"), F.when(some, F.col("wide") / F.col("usual")).alias("depth"))


def sinusoid_scan(df: DataFrame, group: list[str], t: str, y: str, periods: list[float], least: int = 20) -> DataFrame:
    """(group, period, n, r2): share of the variance of a series without its line that a sinusoid of each period explains; groups of fewer than `least` points are absent."""
    w = Window.partitionBy(*group)
    d = df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*group, F.col(t).cast("double").alias("__t"), F.col(y).cast("double").alias("__y"), F.count(F.lit(1)).over(w).alias("n"))
    d = d.where(F.col("n") >= least).withColumn("__x", F.col("__t") - F.avg("__t").over(w)).withColumn("__v", F.col("__y") - F.avg("__y").over(w))
    slope = F.try_divide(F.sum(F.col("__x") * F.col("__v")).over(w), F.sum(F.col("__x") * F.col("__x")).over(w))
    d = d.withColumn("__v", F.col("__v") - F.coalesce(slope, F.lit(0.0)) * F.col("__x")).withColumn("period", F.explode(F.array(*[F.lit(float(p)) for p in periods])))
    turn = 2 * F.pi() * F.col("__t") / F.col("period")
    d = d.withColumn("c", F.cos(turn)).withColumn("s", F.sin(turn))
    g = d.groupBy(*group, "period").agg(F.first("n").alias("n"), *[F.covar_pop(a, b).alias(a.strip("_") + b.strip("_")) for a, b in (("c", "c"), ("s", "s"), ("c", "s"), ("c", "__v"), ("s", "__v"), ("__v", "__v"))])
    explained = F.col("cv") * F.col("cv") * F.col("ss") - 2 * F.col("cv") * F.col("sv") * F.col("cs") + F.col("sv") * F.col("sv") * F.col("cc")
    return g.select(*group, "period", "n", F.try_divide(explained, F.col("vv") * (F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs"))).alias("r2"))


def effective_tests(corr: np.ndarray) -> float:
    """Number of independent tests that correlated ones amount to, from the spread of the eigenvalues."""
    m = len(corr)
    return 1 + (m - 1) * (1 - float(np.var(np.linalg.eigvalsh(corr), ddof=1)) / m) if m > 1 else 1.0


def fit_shapes(t: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Bayesian information criterion of a constant, a line, the best exponential approach and the best step."""
    n = len(t)
    bic = lambda rss, k: n * math.log(max(rss, 1e-300) / n) + k * math.log(n)

    def rss(x: np.ndarray) -> float:
        a = np.column_stack([np.ones(n), x])
        return float(((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum())

    span = float(t.max() - t.min()) or 1.0
    u = t - t.min()
    return {
        "constant": bic(float(((y - y.mean()) ** 2).sum()), 1),
        "line": bic(rss(u), 2),
        "exponential": bic(min(rss(np.exp(-u / tau)) for tau in span * np.geomspace(0.02, 2, 25)), 3),
        "step": bic(min(rss((u > c).astype(float)) for c in np.unique(u)[1:-1]), 3) if len(np.unique(u)) > 2 else float("inf"),
    }


#: Lags of a circular shift that one row of work tries.
LAGS = 256


def _change_scores(x: np.ndarray, y: np.ndarray, w: int, lags: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(steps of x, steps of y, scores by lag and place). A step is the median of w values less that of the w before. Medians of y run around its end, so a lag only moves its steps."""
    med = np.median(np.lib.stride_tricks.sliding_window_view(x, w), axis=1)
    sx = med[w:] - med[:-w]
    around = np.median(np.lib.stride_tricks.sliding_window_view(np.concatenate([y, y[: w - 1]]), w), axis=1)
    turned = np.roll(around, -w) - around
    sy = turned[(np.arange(len(sx)) - lags[:, None]) % len(y)]
    return sx, turned[: len(sx)], np.where(np.sign(sx) == np.sign(sy), np.round(np.minimum(np.abs(sx), np.abs(sy)) / unit, 9), 0.0)


def replicated_change(df: DataFrame, group: list[str], t: str, a: str, b: str, widths: tuple[int, ...] = (5, 15, 30), unit: float = 1.0, least: int = 5) -> DataFrame:
    """(group, width, n, boundary, step_a, step_b, score, p, bh) of the largest step that two paired series have together.

    The longest run of consecutive t with both values is tested, the first of several; runs of fewer than 2 width + least values have no row. A
    score is the smaller of two steps of one sign, in units. p compares the largest score with that of every circular shift of b, which keeps
    both series but not their common time; bh adjusts over all rows. A run is one row (of bins); its lags are dealt out in blocks of LAGS.
    """
    w = Window.partitionBy(*group)
    j = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(t).isNotNull()).withColumn("__run", F.col(t) - F.row_number().over(w.orderBy(t)))
    run = j.groupBy(*group, "__run").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")))).alias("s"))
    one = run.withColumn("__at", F.row_number().over(w.orderBy(F.col("n").desc(), "__run"))).where("__at = 1").select(*group, "n", "s", F.explode(F.array(*map(F.lit, widths))).alias("width")).where(F.col("n") >= 2 * F.col("width") + least)
    work = one.withColumn("__first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(LAGS).cast("bigint")))).repartition(*group, "width", "__first")

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False, name=None):
                row = dict(zip(batch.columns, r, strict=True))
                s, width = row["s"], int(row["width"])
                x, y = (np.array([v[c] for v in s], dtype=float) for c in ("a", "b"))
                lags = np.arange(row["__first"], min(row["__first"] + LAGS, len(s)))
                sx, sy, scores = _change_scores(x, y, width, np.append(0, lags), unit)
                at = int(scores[0].argmax())
                top = scores[1:].max(1)
                out.append([*(row[g] for g in group), width, len(s), int(s[width + at]["t"]), sx[at], sy[at], scores[0, at], int(((lags > 0) & (top >= scores[0, at])).sum())])
            yield pd.DataFrame(out, columns=[*group, "width", "n", "boundary", "step_a", "step_b", "score", "over"])

    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    parts = work.mapInPandas(tried, f"{kinds}, width int, n bigint, boundary bigint, step_a double, step_b double, score double, over bigint")
    whole = parts.groupBy(*group, "width", "n", "boundary", "step_a", "step_b", "score").agg(((F.sum("over") + 1) / F.col("n")).alias("p"))
    return benjamini_hochberg(whole.withColumn("__all", F.lit(0)), ["__all"], "p", "width").drop("__all")


def _ranked(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    d = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)).select(*group, *cols)
    return d.withColumns({f"__r{i}": rank_ties(c, group) for i, c in enumerate(cols)})


#: Buckets into which the distinct values of a group are cut.
RANK_BUCKETS = 64


def _ranked_apart(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """_ranked() for groups of any size: no task orders a whole group.

    Equal values are counted first, a sketch cuts a group's values into buckets, and a rank is the rows of the buckets before, those before in its
    bucket and half of its equals. Rows find the ranks of their values by equi joins. Buckets are written, so that all who read them see the same ones.
    """
    d = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in cols)).select(*group, *cols)
    path, rows = scratch(df.sparkSession, "ranks"), d
    names = [f"__g{i}" for i in range(len(group))]
    keys = [F.col(g).alias(n) for g, n in zip(group, names, strict=True)]
    cuts = [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)]
    for i, c in enumerate(cols):
        counts = d.groupBy(*keys, F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        sketch = counts.groupBy(*[F.col(n).alias(f"s{n}") for n in names]).agg(F.percentile_approx(F.col("__v").cast("double"), cuts, 20 * RANK_BUCKETS).alias("__e"))
        b = counts.join(sketch, [F.col(n).eqNullSafe(F.col(f"s{n}")) for n in names])
        b.select(*names, "__v", "__n", F.size(F.filter("__e", lambda e: e < F.col("__v").cast("double"))).alias("__b")).write.parquet(f"{path}/{i}")
        b = df.sparkSession.read.parquet(f"{path}/{i}")
        sums = b.groupBy(*[F.col(n).alias(f"s{n}") for n in names], F.col("__b").alias("s__b")).agg(F.sum("__n").alias("__s"))  # at most RANK_BUCKETS rows for each group
        sums = sums.withColumn("__f", F.coalesce(F.sum("__s").over(Window.partitionBy(*[f"s{n}" for n in names]).orderBy("s__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.coalesce(F.sum("__n").over(Window.partitionBy(*names, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranks = b.withColumn("__i", inside).join(sums, [F.col(n).eqNullSafe(F.col(f"s{n}")) for n in names] + [F.col("__b") == F.col("s__b")])
        ranks = ranks.select(*names, "__v", (F.col("__f") + F.col("__i") + (F.col("__n") + 1) / 2.0).alias(f"__r{i}"))
        rows = rows.join(ranks, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names, strict=True)] + [F.col(c) == F.col("__v")]).drop(*names, "__v")
    return rows


#: Share of a column's variance below which controls leave nothing of it.
NOTHING = 1e-12


def partial_spearman_many(df: DataFrame, group: list[str], x: str, y: str, controls: list[str]) -> DataFrame:
    """(group, n, zero, rho): correlation of ranks, and that with several controls held fixed.

    One aggregation has the correlations of all pairs; controls are then eliminated one after the other. A control that is constant, or that the
    ones before explain, takes nothing away. rho is null with fewer than controls + 4 rows, or where controls explain x or y.
    """
    cols = [x, y, *controls]
    m = len(cols)
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
    g = _ranked_apart(df, group, cols).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.covar_pop(f"__r{i}", f"__r{j}").alias(f"__c{i}_{j}") for i, j in pairs], *[F.var_pop(f"__r{i}").alias(f"__s{i}") for i in range(m)])
    g = g.withColumns({f"__c{i}_{j}": F.when((F.col(f"__s{i}") > 0) & (F.col(f"__s{j}") > 0), F.col(f"__c{i}_{j}") / F.sqrt(F.col(f"__s{i}") * F.col(f"__s{j}"))).otherwise(0.0) for i, j in pairs} | {f"__v{i}": F.when(F.col(f"__s{i}") > 0, 1.0).otherwise(0.0) for i in range(m)})
    g = g.withColumn("zero", F.col("__c0_1"))
    at = lambda i, j: F.col(f"__c{min(i, j)}_{max(i, j)}")
    for z in range(2, m):
        rest = [i for i in range(m) if i < 2 or i > z]
        r = {i: F.when(F.col(f"__v{z}") > NOTHING, at(i, z)).otherwise(0.0) for i in rest}
        left = {i: 1 - r[i] * r[i] for i in rest}
        new = {f"__c{i}_{j}": F.when((left[i] > NOTHING) & (left[j] > NOTHING), (at(i, j) - r[i] * r[j]) / F.sqrt(left[i] * left[j])).otherwise(0.0) for i in rest for j in rest if i < j}
        g = g.withColumns(new | {f"__v{i}": F.col(f"__v{i}") * left[i] for i in rest})
    told = (F.col("n") >= len(controls) + 4) & (F.col("__v0") > NOTHING) & (F.col("__v1") > NOTHING)
    return g.select(*group, "n", "zero", F.when(told, F.col("__c0_1")).alias("rho"))


#: Permutations that one row of work draws.
DRAWS_A_ROW = 1000


def _residuals(r: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The first two columns of ranks without what the others explain; None where that leaves nothing."""
    r = r - r.mean(0)
    own, z = r[:, :2], r[:, 2:]
    left = own - z @ np.linalg.lstsq(z, own, rcond=None)[0] if z.shape[1] else own
    if ((left**2).sum(0) <= NOTHING * np.maximum((own**2).sum(0), 1)).any():
        return None
    return left[:, 0], left[:, 1]


def partial_permutation_p(df: DataFrame, group: list[str], x: str, y: str, controls: list[str], draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(group, n, rho, p) of series of bins: the partial rank correlation, and the share of permutations of x's residual ranks that correlate as much. A group's ranks are one row; its draws are dealt out in rows of DRAWS_A_ROW."""
    cols = [x, y, *controls]
    ranks = F.array(*[F.col(f"__r{i}") for i in range(len(cols))])
    one = _ranked(df, group, cols).groupBy(*group).agg(F.sort_array(F.collect_list(ranks)).alias("r"))
    work = one.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_A_ROW)))).repartition(*group, "first")

    def tried(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                r = np.array([list(v) for v in row["r"]], dtype=float)
                key, left = tuple(row[g] for g in group), _residuals(r) if len(r) >= len(controls) + 4 else None
                rho, over = None, 0
                if left is not None:
                    a, b = left
                    size = math.sqrt((a @ a) * (b @ b))
                    rho = float(a @ b) / size
                    rng = np.random.default_rng([seed_of(key, seed), row["first"]])
                    null = np.array([abs(rng.permutation(a) @ b) for _ in range(min(DRAWS_A_ROW, draws - row["first"]))])
                    over = int((null / size >= abs(rho) - 1e-12).sum())
                out.append([*key, len(r), rho, over])
            yield pd.DataFrame(out, columns=[*group, "n", "rho", "over"])

    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    parts = work.mapInPandas(tried, f"{kinds}, n bigint, rho double, over bigint")
    return parts.groupBy(*group).agg(F.max("n").alias("n"), F.max("rho").alias("rho"), F.sum("over").alias("over")).select(*group, "n", "rho", F.when(F.col("rho").isNotNull(), (F.col("over") + 1) / (draws + 1)).alias("p"))


def split_halves(df: DataFrame, group: list[str], session: str, order: list[str], y: str, least: int = 40, sessions: int = 3) -> DataFrame:
    """(group, sessions, within, between, ratio, drift_sd): medians of the early and the late half of each session against those of sessions that follow each other.

    within: the median gap of a session's halves; between: that of neighbouring sessions (session + 1). A session has `least` rows, a group `sessions`
    sessions. drift_sd: what the variance of session medians has beyond a quarter of the mean squared gap of halves, 0 if nothing.
    """
    w = Window.partitionBy(*group, session)
    d = df.where(F.col(y).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count(F.lit(1)).over(w))
    early = F.col("__i") <= F.floor(F.col("__n") / 2)
    s = d.where(F.col("__n") >= least).groupBy(*group, session).agg((F.median(F.when(early, F.col(y))) - F.median(F.when(~early, F.col(y)))).alias("__h"), F.median(y).alias("__m"))
    s = s.withColumn("__old", F.lag(session).over(Window.partitionBy(*group).orderBy(session))).withColumn("__was", F.lag("__m").over(Window.partitionBy(*group).orderBy(session)))
    g = s.groupBy(*group).agg(F.count(F.lit(1)).alias("sessions"), F.median(F.abs("__h")).alias("within"), F.median(F.when(F.col(session) == F.col("__old") + 1, F.abs(F.col("__m") - F.col("__was")))).alias("between"), (F.var_samp("__m") - F.avg(F.col("__h") * F.col("__h")) / 4).alias("__v"))
    return g.where(F.col("sessions") >= sessions).select(*group, "sessions", "within", "between", F.when(F.col("within") > 0, F.col("between") / F.col("within")).alias("ratio"), F.sqrt(F.greatest(F.col("__v"), F.lit(0.0))).alias("drift_sd"))


def order_control(df: DataFrame, group: list[str], order: list[str], row: str, y: str, widths: tuple[int, ...], seed: int = 0) -> DataFrame:
    """(group, width, windows, real, shuffled, expected): spread of medians of windows of rows in their order, and in an order by digest of the row; and the spread of the shortest windows over the root of how much longer these are.

    Averaging the same rows, the two differ by what neighbours have in common. Widths with fewer than two whole windows have no row.
    """
    mixed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row).cast("string")).cast("binary"))
    w = Window.partitionBy(*group)
    d = df.where(F.col(y).isNotNull()).select(*group, F.col(y).alias("__y"), (F.row_number().over(w.orderBy(*order)) - 1).alias("real"), (F.row_number().over(w.orderBy(mixed, row)) - 1).alias("shuffled"))
    both = d.withColumn("width", F.explode(F.array(*map(F.lit, widths)))).select(*group, "__y", "width", F.explode(F.create_map(F.lit("real"), F.col("real"), F.lit("shuffled"), F.col("shuffled"))).alias("__how", "__i"))
    one = both.groupBy(*group, "width", "__how", F.floor(F.col("__i") / F.col("width")).alias("__w")).agg(F.median("__y").alias("m"), F.count(F.lit(1)).alias("n")).where("n = width")
    g = one.groupBy(*group, "width").agg(F.count_if(F.col("__how") == "real").alias("windows"), *[F.stddev_samp(F.when(F.col("__how") == h, F.col("m"))).alias(h) for h in ("real", "shuffled")]).where("windows >= 2")
    first = Window.partitionBy(*group).orderBy("width").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return g.withColumn("expected", F.first("real").over(first) / F.sqrt(F.col("width") / F.first("width").over(first)))
