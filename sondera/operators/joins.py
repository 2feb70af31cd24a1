"""As-of, nearest, range, overlap and replication joins, and pairs of sources.

Time joins become equi joins: an as-of join is a window over the union of both sides, a range join is keyed by time buckets
(each row goes to its own bucket, each range to all buckets it touches), so both sides are hashed on (key, bucket) and none is copied whole.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch


def complete(df: DataFrame, keys: list[str], member: str, members: int) -> DataFrame:
    """Rows of keys for which all `members` members are present."""
    full = df.groupBy(*keys).agg(F.count_distinct(member).alias("__n")).where(F.col("__n") == members).select(*keys)
    return df.join(full, keys, "left_semi")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, out: str, forward: bool = False) -> DataFrame:
    """left with the value in force: that of the last right row at or before `at` (forward: the first at or after), null if none.

    Of right rows at one time the greatest value counts.
    """
    r = right.groupBy(*keys, at).agg(F.max(value).alias("__v")).select(*keys, at, F.struct("__v").alias("__r"))
    rest = [c for c in left.columns if c not in (*keys, at)]
    cols = F.struct(*rest) if rest else F.struct(F.lit(1).alias("__none"))
    both = left.select(*keys, at, cols.alias("__row")).withColumn("__side", F.lit(1)).unionByName(r.select(*keys, at, "__r").withColumn("__side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    w = w.orderBy(F.col(at).desc(), "__side") if forward else w.orderBy(at, "__side")
    seen = both.withColumn("__r", F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where(F.col("__side") == 1).select(*keys, at, *[F.col(f"__row.{c}") for c in rest], F.col("__r.__v").alias(out))


def nearest_gap(left: DataFrame, right: DataFrame, keys: list[str], at: str, out: str) -> DataFrame:
    """left with the least distance in time to any right row of its key."""
    r = right.select(*keys, at, F.col(at).alias("__t"))
    back = as_of(left, r, keys, at, "__t", "__b")
    both = as_of(back, r, keys, at, "__t", "__f", forward=True)
    return both.withColumn(out, F.least(F.col(at) - F.col("__b"), F.col("__f") - F.col(at))).drop("__b", "__f")


def nearest_value(left: DataFrame, right: DataFrame, twice: str, t: str, value: str, bucket: int, out: str, away: str) -> DataFrame:
    """left with the value of the right row nearest in time to half of `twice`, and how far away it is, in halves of a unit of time.

    Of rows equally near the earliest counts, and of those the one of least value. A time meets the right rows of its own bucket and
    the ends of the nearest filled buckets before and after, so that only buckets are ordered as a whole.
    """
    r = right.groupBy(F.col(t).alias("__t")).agg(F.min(value).alias("__v")).withColumn("__b", F.floor(F.col("__t") / bucket))
    ends = r.groupBy("__b").agg(F.min(F.struct("__t", "__v")).alias("first"), F.max(F.struct("__t", "__v")).alias("last"))
    l = left.withColumn("__b", F.floor(F.col(twice) / 2 / bucket))  # noqa: E741
    grid = l.select("__b").distinct()
    back = as_of(grid.select((F.col("__b") - 1).alias("at")), ends.select(F.col("__b").alias("at"), "last"), [], "at", "last", "back").select((F.col("at") + 1).alias("__b"), "back")
    ahead = as_of(grid.select((F.col("__b") + 1).alias("at")), ends.select(F.col("__b").alias("at"), "first"), [], "at", "first", "ahead", forward=True).select((F.col("at") - 1).alias("__b"), "ahead")
    far = lambda x: F.when(x["__t"].isNotNull(), F.struct(F.abs(F.col(twice) - 2 * x["__t"]).alias("d"), x["__t"].alias("t"), x["__v"].alias("v")))
    met = l.join(r.select("__b", F.struct("__t", "__v").alias("own")), "__b", "left").groupBy(*left.columns, "__b").agg(F.min(far(F.col("own"))).alias("own"))
    best = met.join(back, "__b", "left").join(ahead, "__b", "left").withColumn("__best", F.array_min(F.array_compact(F.array("own", far(F.col("back")), far(F.col("ahead"))))))
    return best.select(*left.columns, F.col("__best.v").alias(out), F.col("__best.d").alias(away))


def in_range(ranges: DataFrame, points: DataFrame, keys: list[str], lo: str, hi: str, at: str, bucket: int, closed: bool = True, how: str = "inner") -> DataFrame:
    """Pairs of a range and a point in it: lo <= at <= hi, or < hi if not closed."""
    a = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    b = points.withColumn("__b", F.floor(F.col(at) / bucket))
    end = F.col(at) <= F.col(hi) if closed else F.col(at) < F.col(hi)
    joined = a.join(b.withColumnsRenamed({k: f"__{k}" for k in keys} | {"__b": "__pb"}), [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__b") == F.col("__pb"), F.col(at) >= F.col(lo), end], how)
    return joined.drop("__b", "__pb", *[f"__{k}" for k in keys])


#: Spans of a block, about; a span that meets it makes so many rows in memory at a time.
SPANS_A_BLOCK = 4096


def overlaps(spans: DataFrame, key: str, lo: str, hi: str, bucket: int, least: int = 1, size: int = SPANS_A_BLOCK) -> DataFrame:
    """(a, b, overlap) of pairs of spans, a < b, that share more than `least` of the axis. An end that is null doesn't bind.

    Spans in order of the buckets in which they start are packed into blocks of about `size`, each a row of arrays. Blocks meet, if their ends let
    them overlap, and pairs of spans are formed where two blocks lie: a span moves once for each block, not for each pair.
    One of the two blocks comes span by span, as Spark holds all rows that it makes of one.
    """
    spark = spans.sparkSession
    path = scratch(spark, "spans")
    spans.select(F.col(key).alias("k"), F.col(lo).alias("lo"), F.col(hi).alias("hi")).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    count = max(1, math.ceil(rows.count() / size))
    placed = rows.repartitionByRange(count, F.floor(F.col("lo") / bucket), "k").withColumn("i", F.spark_partition_id())
    end = lambda c, of: F.when(F.count(c) == F.count(F.lit(1)), of(c))
    packed = placed.groupBy("i").agg(end("lo", F.min).alias("first"), end("hi", F.max).alias("last"), F.collect_list(F.struct("k", "lo", "hi")).alias("s"))
    packed.select("i", "first", "last", "s.k", "s.lo", "s.hi").write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    named = lambda n, *cols: blocks.select(*[F.col(c).alias(f"{c}{n}") for c in ("i", *cols)])
    may = F.coalesce(F.least("lastx", "lasty") - F.greatest("firstx", "firsty") > least, F.lit(True))
    pairs = named("x", "first", "last").join(named("y", "first", "last"), (F.col("ix") <= F.col("iy")) & may).select("ix", "iy")
    # merge joins take a row of the left side at a time; a hash join may take a block and find all the spans that meet it
    x, y = (pairs.repartition(count, f"i{n}").hint("merge").join(named(n, "k", "lo", "hi").repartition(count, f"i{n}"), f"i{n}") for n in "xy")
    x = x.select("ix", "iy", F.inline(F.arrays_zip("kx", "lox", "hix")))
    x, y = (d.repartition(min(2000, count * (count + 1) // 2), "ix", "iy") for d in (x, y))
    met = x.hint("merge").join(y, ["ix", "iy"]).select("ix", "iy", "kx", "lox", "hix", "ky", "hiy", F.posexplode("loy").alias("at", "lo"))
    k, hi_ = F.get("ky", "at"), F.get("hiy", "at")
    common = F.least("hix", hi_) - F.greatest("lox", "lo")
    once = F.when(F.col("ix") < F.col("iy"), F.col("kx") != k).otherwise(F.col("kx") < k)
    return met.where(once & (common > least)).select(F.least("kx", k).alias("a"), F.greatest("kx", k).alias("b"), common.alias("overlap"))


def unordered_pairs(df: DataFrame, key: str, on: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """Pairs a < b of rows of a small table of sources, in each group of `on`; columns get suffixes _a and _b."""
    on = on or []
    cols = cols or [c for c in df.columns if c not in (key, *on)]
    a = df.select(*on, F.col(key).alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = df.select(*[F.col(c).alias(f"__{c}") for c in on], F.col(key).alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, [F.col(c) == F.col(f"__{c}") for c in on] + [F.col("a") < F.col("b")]).drop(*[f"__{c}" for c in on])


def replicated(events: DataFrame, node: str, key: list[str], at: str, size: str, within: int, unit: float) -> DataFrame:
    """events with `replica`: the best event of another node, of the same key and sign, within `within` of its time, of size unit or more."""
    b = events.select(*[F.col(k).alias(f"__key_{k}") for k in key], F.col(node).alias("__by"), F.col(at).alias("__at"), F.col(size).alias("__size"), F.explode(F.array(*[F.floor(F.col(at) / within) + d for d in (-1, 0, 1)])).alias("__bucket"))
    e = events.withColumn("__own", F.floor(F.col(at) / within))
    near = e.join(b.where(F.abs("__size") >= unit), [F.col(k) == F.col(f"__key_{k}") for k in key] + [F.col("__own") == F.col("__bucket"), F.col(node) != F.col("__by"), F.signum(size) == F.signum("__size"), F.abs(F.col(at) - F.col("__at")) <= within], "left")
    best = near.groupBy(node, *key, at, size).agg(F.min(F.when(F.col("__at").isNotNull(), F.struct(F.abs(F.col(at) - F.col("__at")).alias("dt"), (-F.abs("__size")).alias("rank"), F.col("__by").alias("node"), F.col("__at").alias("at")))).alias("__best"))
    return best.select(node, *key, at, size, F.col("__best").isNotNull().alias("replicated"), F.col("__best.node").alias("replica_node"), F.col("__best.at").alias("replica_at"))


def around(events: DataFrame, points: DataFrame, keys: list[str], at: str, t: str, value: str, width: int, bucket: int) -> DataFrame:
    """Medians of a value in [at - width, at) and [at, at + width) around each event, null where there are no rows."""
    e = events.withColumn("__lo", F.col(at) - width).withColumn("__hi", F.col(at) + width)
    pairs = in_range(e, points.select(*keys, t, value), keys, "__lo", "__hi", t, bucket, closed=False)
    return pairs.groupBy(*keys, at).agg(F.median(F.when(F.col(t) < F.col(at), F.col(value))).alias("before"), F.median(F.when(F.col(t) >= F.col(at), F.col(value))).alias("after"), F.count(F.lit(1)).alias("n"))


def _median(x: list[float]) -> float | None:
    n = len(x)
    return None if not n else x[n // 2] if n % 2 else (x[n // 2 - 1] + x[n // 2]) / 2


def sliding_around(events: DataFrame, points: DataFrame, keys: list[str], at: str, t: str, value: str, width: int, bucket: int) -> DataFrame:
    """around() for as many events as points: all columns of events with before, after and n.

    A key's events in a bucket of time meet the points in reach of them in one task. Both windows slide along with the events as sorted lists,
    so that a point enters and leaves each once, however many events it is near. Rows without a value aren't points.
    """
    reach = F.explode(F.sequence(F.floor((F.col(t) - width) / bucket), F.floor((F.col(t) + width) / bucket)))
    p = points.where(F.col(value).isNotNull()).select(*keys, F.col(t).cast("bigint").alias("__t"), F.col(value).cast("double").alias("__v"), reach.alias("__b"))
    e = events.withColumns({"__t": F.col(at).cast("bigint"), "__b": F.floor(F.col(at) / bucket), "__event": F.lit(True)})

    kept = events.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__t", kind="stable")
        is_event = pdf["__event"].notna().to_numpy()
        ev, pt = pdf[is_event], pdf[~is_event]
        when, what = pt["__t"].tolist(), pt["__v"].tolist()
        before, after, out = [], [], []
        lo = mid = hi = 0  # points gone from before, gone over to it, come into after
        for now in ev["__t"].tolist():
            while hi < len(when) and when[hi] < now + width:
                insort(after, what[hi])
                hi += 1
            while mid < hi and when[mid] < now:
                del after[bisect_left(after, what[mid])]
                insort(before, what[mid])
                mid += 1
            while lo < mid and when[lo] < now - width:
                del before[bisect_left(before, what[lo])]
                lo += 1
            out.append((_median(before), _median(after), hi - lo))
        got = pd.DataFrame(out, columns=["before", "after", "n"], index=ev.index)
        return pd.concat([ev[kept], got], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    both = e.unionByName(p, allowMissingColumns=True)
    return both.groupBy(*keys, "__b").applyInPandas(run, f"{fields}, before double, after double, n bigint")


def near_miss(df: DataFrame, key: str, size: str, ratio: float) -> DataFrame:
    """(a, b) of whole-number keys, a < b, that differ in one place of their digits while either size is at least `ratio` times the other.

    Keys are padded to the longest of them. A pair meets under the one way to leave its place out; ten keys at most share such a way.
    """
    s = df.select(F.col(key).alias("k"), F.col(size).alias("size"), F.col(key).cast("string").alias("id"))
    s = s.crossJoin(F.broadcast(s.agg(F.max(F.length("id")).alias("places"))))  # one row
    s = s.withColumn("id", F.lpad("id", F.col("places"), F.lit("0")))
    ways = F.transform(F.sequence(F.lit(1), F.col("places")), lambda i: F.concat(i.cast("string"), F.lit(":"), F.overlay("id", F.lit("_"), i, F.lit(1))))
    x, y = (s.select("k", "size", F.explode(ways).alias("way")).alias(n) for n in "xy")
    far = F.greatest("x.size", "y.size") >= ratio * F.least("x.size", "y.size")
    return x.join(y, (F.col("x.way") == F.col("y.way")) & (F.col("x.k") < F.col("y.k")) & far).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))


def hamming(a: Column, b: Column, sep: str = ":") -> Column:
    """Positions in which two separated strings of equal length differ."""
    return F.size(F.filter(F.zip_with(F.split(a, sep), F.split(b, sep), lambda x, y: x != y), lambda d: d))


def range_sums(ranges: DataFrame, points: DataFrame, lo: str, hi: str, at: str, value: str, bucket: int, n: str, total: str) -> DataFrame:
    """ranges with the count and the sum of points' values in lo <= at <= hi (whole numbers), null values aside; no range meets the points inside it.

    Points run up within a bucket of time, and buckets by their totals; either end of a range takes both as of its time, and the difference
    is the range's. Sums are decimals of nine places, so that differences are exact. Only buckets are ordered as a whole.
    """
    key = [c for c in ranges.columns if c not in (n, total)]
    p = points.where(F.col(value).isNotNull()).groupBy(F.col(at).alias("__t")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(28,9)")).alias("s")).withColumn("__b", F.floor(F.col("__t") / bucket))
    up = lambda w: F.struct(F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s"))
    inside = p.select("__b", "__t", up(Window.partitionBy("__b").orderBy("__t")).alias("__in"))
    whole = p.groupBy("__b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = whole.select(F.col("__b").alias("__at"), up(Window.orderBy("__b")).alias("__up"))  # a row for each bucket
    ends = ranges.select(F.struct(*key).alias("__key"), F.explode(F.array(F.struct((F.col(lo) - 1).alias("t"), F.lit(-1).alias("sign")), F.struct(F.col(hi).alias("t"), F.lit(1).alias("sign")))).alias("e"))
    ends = ends.select("__key", F.col("e.t").alias("__t"), F.col("e.sign").alias("__sign"), F.floor(F.col("e.t") / bucket).alias("__b"))
    grid = ends.select((F.col("__b") - 1).alias("__at")).distinct()
    before = as_of(grid, whole, [], "__at", "__up", "__before").select((F.col("__at") + 1).alias("__b"), "__before")
    met = as_of(ends, inside, ["__b"], "__t", "__in", "__within").join(before, "__b")
    part = lambda c: F.coalesce(F.col(f"__within.{c}"), F.lit(0)) + F.coalesce(F.col(f"__before.{c}"), F.lit(0))
    out = met.groupBy("__key").agg(F.sum(F.col("__sign") * part("n")).alias(n), F.sum(F.col("__sign") * part("s")).alias(total))
    return out.select("__key.*", n, F.col(total).cast("double").alias(total))
