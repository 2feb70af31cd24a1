"""Column expressions that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Added before rounding, so that a mean such as 1 / 32, which lies halfway between two results, doesn't round by the order of its sum.
STEADY = 1e-11


def r6(c: Column | str) -> Column:
    """Rounded to 6 places, halves up by a margin, without a negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(STEADY), 6) + F.lit(0.0)


def no_nan(c: Column) -> Column:
    """Missing is null, never NaN."""
    return F.when(~F.isnan(c), c)


def wrap(c: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(c), F.cos(c))


def circular_diff(a: Column, b: Column, modulus: int = 65536) -> Column:
    """Signed difference a - b on a counter that wraps."""
    return F.pmod(a - b + modulus // 2, F.lit(modulus)) - modulus // 2


def arr_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def arr_mean(a: Column) -> Column:
    return arr_sum(a) / F.size(a)


def arr_median(a: Column) -> Column:
    """Median of an array; of an even number the mean of the middle two."""
    s, n = F.sort_array(a), F.size(a)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)


def dot(a: Column, b: Column) -> Column:
    return arr_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unwrap(a: Column) -> Column:
    """Phase unwrapping along an array: jumps of more than pi are folded back."""
    two_pi = 2 * math.pi
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("add"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        d = x - s["last"]
        turn = -F.floor((d + math.pi) / two_pi) * two_pi
        # a step of exactly pi stays as it is
        fix = F.when(s["last"].isNull() | (F.abs(d) <= math.pi), F.lit(0.0)).otherwise(turn + F.when((d + turn == -math.pi) & (d > 0), two_pi).otherwise(0.0))
        add = s["add"] + fix
        return F.struct(x.alias("last"), add.alias("add"), F.concat(s["out"], F.array(x + add)).alias("out"))

    return F.aggregate(a, start, step, lambda s: s["out"])
