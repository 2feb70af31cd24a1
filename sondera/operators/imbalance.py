"""Imbalance of mirror places of spectra: products that don't depend on a frame's phase, as sums that merge.

With H'(k) = a H(k) e^jp + b s(k) conj(H(-k)) e^-jp, a frame's unknown phase p turns the channel's part of H'(k) H'(-k) by 2p, so that it
averages away over frames; the part of the imbalance b / a doesn't turn and stays. A frame loses its phase ramp and its mean over
places, never its phase. Each task adds up what it has read of a source, so a source shuffles one row for each task, and everything else is derived
from sums: the estimate, its halves of alternate frames, nulls of signs drawn by digest and of mirror places moved by SHIFTS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import wrap
from . import kernels

#: Signs of the training sequence at the used places, -26 to -1 and 1 to 26 (fixed values of the published standard).
TRAINING = np.array([int(x + "1") for x in "++--++-+-++++++--++-+-++++" + "+--++-+-+-----++--+-+-++++"], dtype=np.float64)
K, PLACES = kernels.FREQUENCIES, len(kernels.FREQUENCIES)
SIGNS = TRAINING * TRAINING[::-1]
#: Distances of wrong partners; patterns of the null of signs; a coherence counts from so many times that of chance.
SHIFTS, NULLS, OVER_CHANCE = (2, 5, 9, 13), 64, 5.0
_PARTNERS = np.stack([np.arange(PLACES)[::-1]] + [(PLACES - 1 - np.arange(PLACES) + d) % PLACES for d in SHIFTS])
#: Sums: frames and products of both halves, power by place, products with wrong partners, mirror symmetry, size of each frame's estimate.
_CUTS = np.cumsum([2, 2 * PLACES, 2 * PLACES, PLACES, 2 * PLACES * len(SHIFTS), 2 * PLACES, 1])
#: Sources whose sums a task holds at once.
HELD = 2048


def null_signs() -> np.ndarray:
    """(NULLS, places): signs that are even in the place, by the first digit of a digest."""
    one = lambda i, k: 1.0 if hashlib.md5(f"{i}:{k}".encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[one(i, abs(k)) for k in K.tolist()] for i in range(NULLS)])


def unramped(h: np.ndarray) -> np.ndarray:
    """Spectra (n, 52) without the phase ramp that neighbours within a half share, and without their mean over places."""
    step = h[:, 1:] * np.conj(h[:, :-1])
    step[:, PLACES // 2 - 1] = 0  # the centre lies between
    g = h * np.exp(-1j * np.angle(step.sum(1))[:, None] * K)
    return g - g.mean(1, keepdims=True)


def frame_sums(h: np.ndarray, which: np.ndarray, second: np.ndarray, groups: int, divided: bool = True) -> np.ndarray:
    """(groups, sums) of spectra; which: the group of each, second: whether it is of the second half. Frames without power, or that aren't finite, don't count."""
    g = unramped(h if divided else h * TRAINING)
    w = np.abs(g) ** 2
    power = w.sum(1)
    good = np.isfinite(power) & (power > 0)
    g, w, which, half = g[good], w[good], which[good], second[good].astype(bool)
    own = g * g[:, ::-1]
    cols = [np.stack([~half, half], 1), *[np.where(x[:, None], own, 0) for x in (~half, half)], w, *[g * g[:, p] for p in _PARTNERS[1:]], g * np.conj(g[:, ::-1]), np.abs(own @ SIGNS)[:, None]]
    flat = np.concatenate([x.astype(np.float64) if not np.iscomplexobj(x) else np.concatenate([x.real, x.imag], 1) for x in cols], axis=1)
    out = np.zeros((groups, _CUTS[-1]))
    order = np.argsort(which, kind="stable")
    at, first = np.unique(which[order], return_index=True)
    if len(at):
        out[at] = np.add.reduceat(flat[order], first, axis=0)
    return out


def sums(df: DataFrame, by: str, iq: str, order: str, divided: bool = True) -> DataFrame:
    """(by, sums) of rows with interleaved spectra iq; alternate numbers in `order` are the halves. divided: spectra are divided by the training signs already."""
    src = df.where(F.size(iq) >= 128).select(F.col(by).alias("by"), F.slice(iq, 1, 128).cast("array<double>").alias("iq"), F.pmod(F.col(order), F.lit(2)).cast("int").alias("half"))

    kind = src.schema["by"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), b.schema.field(0).type), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["by", "sums"])

        b = None
        for b in batches:
            keys = b.column(0).dictionary_encode("encode")
            iq = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 128)
            s = frame_sums(kernels.spectrum(iq), keys.indices.to_numpy(), b.column(2).to_numpy(), len(keys.dictionary), divided)
            for k, row in zip(keys.dictionary.to_pylist(), s, strict=True):
                held[k] = held[k] + row if k in held else row
            if len(held) > HELD:
                yield out(b)
                held.clear()
        if held:
            yield out(b)

    parts = src.mapInArrow(run, f"by {kind}, sums array<double>").select("by", F.posexplode("sums").alias("place", "x")).groupBy("by", "place").agg(F.sum("x").alias("x"))
    whole = parts.groupBy("by").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("sums"))  # a fixed number of places
    return whole.select(F.col("by").alias(by), "sums")


def estimate(s: np.ndarray) -> dict[str, np.ndarray]:
    """What sums (n, sums) say. kappa: half the sum of signed products over the power, as is nu for mirror symmetry; both halves are compared with it, and its nulls."""
    parts = np.split(s, _CUTS[:-1], axis=1)
    both = lambda x: x.reshape(len(x), -1, 2, PLACES)[:, :, 0] + 1j * x.reshape(len(x), -1, 2, PLACES)[:, :, 1]
    n, power = parts[0].sum(1), parts[3].sum(1)
    c1, c2, wrong, even = both(parts[1])[:, 0], both(parts[2])[:, 0], both(parts[4]), both(parts[5])[:, 0]
    c = c1 + c2
    safe = np.where(power > 0, power, 1)
    share = lambda x: np.abs((x * SIGNS).sum(-1)) / np.maximum(np.abs(x).sum(-1), 1e-300)
    kappa = (c @ SIGNS) / (2 * safe)
    first, second = (c1 @ SIGNS) / safe, (c2 @ SIGNS) / safe
    null = np.abs(c @ null_signs().T).max(1) / (2 * safe)
    coherence = np.abs(c @ SIGNS) / np.maximum(parts[6][:, 0], 1e-300)
    align, moved = share(c), share(wrong).max(1)
    steady = (np.abs(first - second) < np.abs(first + second) / 2) & (coherence >= OVER_CHANCE * 0.886 / np.sqrt(np.maximum(n, 1)))
    nu = (even @ SIGNS) / (2 * safe)
    return {"n": n, "kappa_re": kappa.real, "kappa_im": kappa.imag, "nu_re": nu.real, "nu_im": nu.imag, "null_max": null, "halves_gap": np.abs(first - second), "coherence": coherence, "align": align, "align_moved": moved, "detected": steady & (np.abs(kappa) > null), "detected_pairs": steady & (align > moved)}


FEATURES = ("kappa_re", "kappa_im", "nu_re", "nu_im", "null_max", "halves_gap", "coherence", "align", "align_moved")


def features(summed: DataFrame, by: str) -> DataFrame:
    """(by, n, FEATURES, detected: against signs by chance, detected_pairs: against wrong partners) of sums(). Sources without a frame that counts have nulls, and aren't detected."""

    def run(s: pd.Series) -> pd.DataFrame:
        e = estimate(np.stack(s.to_list()) if len(s) else np.zeros((0, _CUTS[-1])))
        return pd.DataFrame({c: e[c].astype("int64") if c == "n" else e[c] for c in ("n", *FEATURES, "detected", "detected_pairs")})

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, "n bigint, " + ", ".join(f"{c} double" for c in FEATURES) + ", detected boolean, detected_pairs boolean")
    o = summed.select(by, udf("sums").alias("o"))
    return o.select(by, "o.n", *[F.when(F.col("o.n") > 0, F.col(f"o.{c}")).alias(c) for c in FEATURES], "o.detected", "o.detected_pairs")


#: Ratio of spread to shared turn up to which a turn is common, and beyond which it isn't; sources that tell.
COMMON, NOT_COMMON, LEAST_SOURCES = 0.25, 1.0, 3


def turns(df: DataFrame, by: str, session: str, angle: str) -> DataFrame:
    """(session, by, turn): the angle of a source less its angle in the session before, in (-pi, pi]."""
    old = df.select(F.col(by), (F.col(session) + 1).alias(session), F.col(angle).alias("__old"))
    return df.join(old, [by, session]).select(session, by, wrap(F.col(angle) - F.col("__old")).alias("turn"))


def _shared(df: DataFrame, session: str) -> DataFrame:
    x, y = F.avg(F.cos("turn")), F.avg(F.sin("turn"))
    length = F.least(F.lit(1.0), F.greatest(F.lit(1e-12), F.sqrt(x * x + y * y)))
    return df.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.atan2(y, x).alias("shared"), F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(length))).alias("spread"))


def without_shared(df: DataFrame, session: str) -> DataFrame:
    """turns() with `own`: what a source turned beside the circular mean of its session."""
    return df.join(_shared(df, session), session).withColumn("own", wrap(F.col("turn") - F.col("shared")))


def common_mode(df: DataFrame, session: str) -> DataFrame:
    """(session, n, shared, spread, ratio, removed, verdict) of turns(). removed: the share of squared turns that the shared one takes off; null where nothing turned."""
    e = without_shared(df, session).groupBy(session, "n", "shared", "spread").agg(F.sum(F.pow("turn", 2)).alias("total"), F.sum(F.pow("own", 2)).alias("rest"))
    ratio = F.when(F.abs("shared") > 1e-9, F.col("spread") / F.abs("shared")).otherwise(F.lit(float("inf")))
    verdict = F.when(F.col("n") < LEAST_SOURCES, "TOO FEW").when(F.col("ratio") <= COMMON, "COMMON").when(F.col("ratio") > NOT_COMMON, "NOT COMMON").otherwise("PARTIAL")
    return e.withColumn("ratio", ratio).select(session, "n", "shared", "spread", "ratio", F.when(F.col("total") > 0, 1 - F.col("rest") / F.col("total")).alias("removed"), verdict.alias("verdict"))
