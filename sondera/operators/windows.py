"""Count windows, time bins, rolling frames, islands, ranks and screens over ordered frames.

All are window or grouping expressions keyed by source, so that sources spread over tasks and Spark spills by itself. Nothing here
orders a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def ordered(keys: str | list[str], order: str | list[str]) -> Window:
    return Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))


def count_windows(df: DataFrame, keys: str | list[str], order: str | list[str], size: int, aggs: dict[str, Column], index: str = "window") -> DataFrame:
    """Aggregate each run of `size` rows of a key; the incomplete last run is dropped."""
    w = F.floor((F.row_number().over(ordered(keys, order)) - 1) / size).cast("bigint")
    out = df.withColumn(index, w).groupBy(*_cols(keys), index).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in aggs.items()])
    return out.where(F.col("__n") == size).drop("__n")


def time_bins(df: DataFrame, keys: str | list[str], us: str, width_us: int, aggs: dict[str, Column], least: int = 1, bin_col: str = "bin") -> DataFrame:
    """Tumbling bins of the time axis; bins with fewer than `least` rows are dropped."""
    out = df.withColumn(bin_col, F.floor(F.col(us) / width_us).cast("bigint")).groupBy(*_cols(keys), bin_col).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in aggs.items()])
    return out.where(F.col("__n") >= least).drop("__n")


def multiscale(df: DataFrame, keys: str | list[str], us: str, scales_s: list[int], aggs: dict[str, Column]) -> DataFrame:
    """time_bins() at several widths in one aggregation; medians don't compose, so each width starts from rows."""
    wide = df.withColumn("scale_s", F.explode(F.array(*[F.lit(s).cast("bigint") for s in scales_s]))).withColumn("bin", F.floor(F.col(us) / (F.col("scale_s") * 1_000_000)).cast("bigint"))
    return wide.groupBy(*_cols(keys), "scale_s", "bin").agg(*[c.alias(n) for n, c in aggs.items()])


def trailing(value: Column, keys: str | list[str], order: str | list[str], rows: int, f=F.stddev_pop, least: int | None = None) -> Column:
    """f over the last `rows` rows, null while fewer than `least` values are there (max(3, rows / 2) by default)."""
    w = ordered(keys, order).rowsBetween(-(rows - 1), 0)
    need = max(3, rows // 2) if least is None else least
    return F.when(F.count(value).over(w) >= need, f(value).over(w))


def unwrapped_clock(clock: Column, keys: str | list[str], order: str | list[str], bits: int = 32) -> Column:
    """A counter that wraps at 2**bits, made to run on: each drop by more than half the range adds the range."""
    w = ordered(keys, order)
    fell = F.when(clock - F.lag(clock).over(w) < -(1 << (bits - 1)), 1).otherwise(0)
    return fell  # summed by unwrap_clock(), as windows don't nest


def unwrap_clock(df: DataFrame, clock: str, keys: str | list[str], order: str | list[str], bits: int = 32, out: str = "clock") -> DataFrame:
    fell = df.withColumn("__fell", unwrapped_clock(F.col(clock), keys, order, bits))
    run = ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return fell.withColumn(out, F.col(clock) + F.lit(1 << bits) * F.sum("__fell").over(run)).drop("__fell")


def wrapped_total(df: DataFrame, counter: str, keys: str | list[str], order: str | list[str], modulus: int = 65536, out: str = "total") -> DataFrame:
    """What a wrapping counter has counted in each key."""
    step = F.pmod(F.col(counter) - F.lag(counter).over(ordered(keys, order)), F.lit(modulus))
    return df.withColumn("__step", step).groupBy(*_cols(keys)).agg(F.coalesce(F.sum("__step"), F.lit(0)).cast("bigint").alias(out))


def islands(df: DataFrame, keys: str | list[str], order: str | list[str], state: Column, aggs: dict[str, Column]) -> DataFrame:
    """Runs of rows with one state. Null is a state."""
    w = ordered(keys, order)
    first = df.withColumn("state", state)
    changed = F.when(F.row_number().over(w) == 1, 1).when(F.col("state").eqNullSafe(F.lag("state").over(w)), 0).otherwise(1)
    run = first.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*_cols(keys), "run").agg(F.first("state").alias("state"), *[c.alias(n) for n, c in aggs.items()])


def consecutive(df: DataFrame, keys: str | list[str], index: str) -> DataFrame:
    """Runs of consecutive integers: (keys, first, last, n)."""
    base = df.select(*_cols(keys), index).distinct().withColumn("__at", F.col(index) - F.row_number().over(ordered(keys, index)))
    return base.groupBy(*_cols(keys), "__at").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n")).drop("__at")


def rank_ties(value: str, keys: str | list[str]) -> Column:
    """Rank from 1; equal values share the mean of their ranks."""
    return F.rank().over(ordered(keys, value)) + (F.count(F.lit(1)).over(Window.partitionBy(*_cols(keys), value)) - 1) / 2.0


def circular_screen(df: DataFrame, counter: str, keys: str | list[str], order: str | list[str], half: int = 4, tolerance: int = 100, modulus: int = 65536, out: str = "passes") -> DataFrame:
    """Whether a wrapping counter stays within tolerance of the upper median of its neighbours; frames shrink at the ends and need 3 rows."""
    near = F.collect_list(F.col(counter)).over(ordered(keys, order).rowsBetween(-half, half))
    c = F.col(counter)
    off = F.sort_array(F.transform(near, lambda v: F.pmod(v - c + modulus // 2, F.lit(modulus)) - modulus // 2))
    median = F.element_at(off, F.floor(F.size(off) / 2).cast("int") + 1)
    return df.withColumn(out, F.when(F.size(near) >= 3, F.abs(median) <= tolerance).otherwise(F.lit(True)))


def median_screen(df: DataFrame, value: str, keys: str | list[str], order: str | list[str], half: int = 4, out: str = "smooth") -> DataFrame:
    """Running median over 2 * half + 1 rows; beyond the ends the first and last values repeat."""
    w = ordered(keys, order)
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*_cols(keys))), F.row_number().over(w)
    near = F.collect_list(F.col(value)).over(w.rowsBetween(-half, half))
    edged = df.withColumns({"__near": near, "__lead": F.greatest(F.lit(0), F.lit(half + 1) - i).cast("int"), "__tail": F.greatest(F.lit(0), i + half - n).cast("int"), "__first": F.first(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__last": F.last(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    full = F.sort_array(F.concat(F.array_repeat(F.col("__first"), F.col("__lead")), F.col("__near"), F.array_repeat(F.col("__last"), F.col("__tail"))))
    return edged.withColumn(out, F.element_at(full, half + 1)).drop("__near", "__lead", "__tail", "__first", "__last")


def shift_scores(df: DataFrame, keys: str | list[str], index: str, value: str, width: int, out: str = "shift") -> DataFrame:
    """Median of the next `width` bins, this one first, less that of the `width` before; null unless all 2 * width are there without gaps."""
    w = ordered(keys, index)
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    whole = (F.count(value).over(before) == width) & (F.count(value).over(after) == width) & (F.max(index).over(after) - F.min(index).over(before) == 2 * width - 1)
    return df.withColumn(out, F.when(whole, F.percentile(value, F.lit(0.5)).over(after) - F.percentile(value, F.lit(0.5)).over(before)))


def fill_gaps(df: DataFrame, keys: str | list[str], index: str, value: str, longest: int, out: str = "filled") -> DataFrame:
    """Linear values for null rows inside gaps of at most `longest` rows; ends and longer gaps stay null. Rows must have every index."""
    w = ordered(keys, index)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    has = F.when(F.col(value).isNotNull(), F.struct(F.col(index).alias("i"), F.col(value).alias("v")))
    a, b = F.last(has, ignorenulls=True).over(back), F.first(has, ignorenulls=True).over(ahead)
    d = df.withColumns({"__a": a, "__b": b})
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(index) - F.col("__a.i")) / (F.col("__b.i") - F.col("__a.i"))
    return d.withColumn(out, F.coalesce(F.col(value), F.when(F.col("__b.i") - F.col("__a.i") - 1 <= longest, line))).drop("__a", "__b")


def dense(df: DataFrame, keys: str | list[str], index: str) -> DataFrame:
    """(keys, index) for every integer between a key's first and last index."""
    ends = df.groupBy(*_cols(keys)).agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"))
    return ends.select(*_cols(keys), F.explode(F.sequence("__lo", "__hi")).alias(index))


def chronological(df: DataFrame, keys: str | list[str], order: str | list[str], share: float = 0.6, out: str = "trains") -> DataFrame:
    """Marks the first max(1, floor(n * share)) rows of each key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*_cols(keys)))
    return df.withColumn(out, F.row_number().over(ordered(keys, order)) <= F.greatest(F.floor(n * share), F.lit(1)))


def densest(df: DataFrame, keys: str | list[str], us: str, span_us: int, out: str = "most") -> DataFrame:
    """Most rows of each key in any span of time that ends at a row."""
    w = Window.partitionBy(*_cols(keys)).orderBy(us).rangeBetween(-span_us, 0)
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).groupBy(*_cols(keys)).agg(F.max("__n").alias(out))
