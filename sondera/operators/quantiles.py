"""Exact quantiles of groups of any size.

Spark's `percentile` keeps all distinct values of a group in one buffer. That is right for windows and bins, whose size
is bounded, and wrong for a group that may hold a third of a large table. Here equal values are counted first, a mergeable sketch
cuts each group into buckets of about equal counts, counts of buckets tell which of them hold the wanted ranks, and only those
buckets are ordered, each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def exact_quantiles(df: DataFrame, keys: list[str], value: Column | str, ps: list[float], buckets: int = BUCKETS) -> DataFrame:
    """(keys, n, q array<double>): linear quantiles, as `percentile` gives them. Null values don't count; a group without values is absent."""
    v = F.col(value) if isinstance(value, str) else value
    names = [f"__k{i}" for i in range(len(keys))]
    d = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], v.cast("double").alias("__v")).where("__v IS NOT NULL")
    counts = d.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__c"))
    cuts = [i / buckets for i in range(1, buckets)]
    sketch = d.groupBy(*names).agg(F.percentile_approx("__v", cuts, 20 * buckets).alias("__e"), F.count(F.lit(1)).alias("__n"))
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in names]
    b = counts.join(sketch.withColumnsRenamed({k: f"s{k}" for k in names}), same("s")).drop(*[f"s{k}" for k in names])
    b = b.withColumn("__b", F.size(F.filter("__e", lambda e: e < F.col("__v")))).drop("__e")
    sums = b.groupBy(*names, "__b", "__n").agg(F.sum("__c").alias("__s"))  # at most `buckets` rows for each group
    ahead = Window.partitionBy(*names).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__f", F.coalesce(F.sum("__s").over(ahead), F.lit(0)))
    at = [(F.col("__n") - 1) * F.lit(float(p)) for p in ps]
    holds = F.lit(False)
    for h in at:
        holds = holds | ((F.ceil(h) >= F.col("__f")) & (F.floor(h) < F.col("__f") + F.col("__s")))
    wanted = sums.where(holds).select(*[F.col(k).alias(f"w{k}") for k in names], F.col("__b").alias("w__b"), "__f")
    rows = b.join(wanted, [*same("w"), F.col("__b") == F.col("w__b")]).drop(*[f"w{k}" for k in names], "w__b")
    inside = Window.partitionBy(*names, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__r", F.col("__f") + F.coalesce(F.sum("__c").over(inside), F.lit(0)))

    def of(rank: Column) -> Column:
        return F.max(F.when((F.col("__r") <= rank) & (rank < F.col("__r") + F.col("__c")), F.col("__v")))

    ends = [x for i, h in enumerate(at) for x in (of(F.floor(h)).alias(f"__lo{i}"), of(F.ceil(h)).alias(f"__hi{i}"))]
    got = rows.groupBy(*names, "__n").agg(*ends)
    part = lambda i, h: F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (h - F.floor(h))
    return got.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.col("__n").alias("n"), F.array(*[part(i, h) for i, h in enumerate(at)]).alias("q"))
