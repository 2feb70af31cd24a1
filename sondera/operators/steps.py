"""Steps that many series have at once: standardised steps of each, their root mean square, its peaks, and an index of motion."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch
from .windows import ordered

#: Bins of one bucket in which peaks are searched; a multiple of the standard deviation that a median deviation stands for.
BUCKET, MAD_SIGMA = 4096, 1.4826


def _whole(df: DataFrame, cell: str, index: str, value: str) -> DataFrame:
    """A row for each cell and each index between the first and the last of all."""
    d = df.where(F.col(value).isNotNull()).select(cell, index, value)
    ends = d.agg(F.min(index).alias("__lo"), F.max(index).alias("__hi"))  # one row
    grid = d.select(cell).distinct().join(F.broadcast(ends)).select(cell, "__lo", "__hi", F.explode(F.sequence("__lo", "__hi")).alias(index))
    return grid.join(d, [cell, index], "left")


def coherent_steps(df: DataFrame, cell: str, index: str, value: str, width: int) -> DataFrame:
    """(index, cells, rms) of series of bins with gaps.

    A step is the mean of `width` bins from the index on less that of the bins before, over sigma sqrt(2 / width); sigma is the deviation of a
    series' differences over sqrt 2. Up to a quarter of either window may be missing; windows lie within the range of all series.
    """
    w = ordered(cell, index)
    d = _whole(df, cell, index, value)
    after, before = w.rowsBetween(0, width - 1), w.rowsBetween(-width, -1)
    d = d.withColumns({"__d": F.col(value) - F.lag(value).over(w), "__a": F.avg(value).over(after), "__b": F.avg(value).over(before), "__na": F.count(value).over(after), "__nb": F.count(value).over(before)})
    d = d.withColumn("__s", F.stddev_pop("__d").over(Window.partitionBy(cell)) / math.sqrt(2))
    least = width - width // 4
    ok = (F.col(index) >= F.col("__lo") + width) & (F.col(index) <= F.col("__hi") - width) & (F.col("__na") >= least) & (F.col("__nb") >= least) & (F.col("__s") > 0)
    z = (F.col("__a") - F.col("__b")) / (F.col("__s") * math.sqrt(2 / width))
    return d.where(ok).select(index, z.alias("z")).groupBy(index).agg(F.count("z").alias("cells"), F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("rms"))


def motion_index(df: DataFrame, cell: str, index: str, value: str, times: float = 3.0) -> DataFrame:
    """(index, motion, threshold, moved): the mean over series of a difference's size over its median one; moved: beyond the median index and `times` its deviation (from the median deviation)."""
    w = ordered(cell, index)
    d = _whole(df, cell, index, value).withColumn("__d", F.abs(F.col(value) - F.lag(value).over(w))).where("__d IS NOT NULL")
    usual = d.groupBy(F.col(cell).alias("__c")).agg(F.median("__d").alias("__m")).where("__m > 0")
    m = d.join(usual, d[cell] == usual["__c"]).groupBy(index).agg(F.avg(F.col("__d") / F.col("__m")).alias("motion"))
    mid = m.agg(F.median("motion").alias("__mid"))
    off = m.join(F.broadcast(mid)).agg(F.first("__mid").alias("__mid"), F.median(F.abs(F.col("motion") - F.col("__mid"))).alias("__mad"))
    out = m.join(F.broadcast(off)).withColumn("threshold", F.col("__mid") + times * MAD_SIGMA * F.col("__mad"))
    return out.select(index, "motion", "threshold", (F.col("motion") > F.col("threshold")).alias("moved"))


def peaks(df: DataFrame, index: str, value: str, apart: int) -> DataFrame:
    """Rows that a search from the highest value down keeps, if it drops all others nearer than `apart`; of equal values the smaller index counts as higher. Null values are no peaks.

    Rounds of local maxima: a row that none of the undecided rows around it exceeds is a peak, and decides its neighbours. Rows meet
    in buckets of BUCKET indices with a margin, so no task has them all; as many rounds as the longest descent from peak to peak.
    """
    names = df.columns
    rank = F.struct(F.col(value).alias("v"), (-F.col(index)).alias("i"))
    bucket = lambda i: F.floor(i / max(BUCKET, apart))
    margin = F.array_distinct(F.array(bucket(F.col(index)), bucket(F.col(index) - apart + 1), bucket(F.col(index) + apart - 1)))
    around = Window.partitionBy("__b").orderBy(index).rangeBetween(-(apart - 1), apart - 1)
    own = F.col("__b") == bucket(F.col(index))

    def kept(d: DataFrame, step: str) -> DataFrame:
        path = scratch(df.sparkSession, step)
        d.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    left, found = kept(df.where(F.col(value).isNotNull()).withColumn("__peak", F.lit(False)), "left"), None
    while True:
        d = left.withColumn("__b", F.explode(margin)).withColumn("__peak", F.max(rank).over(around) == rank)
        # a row at the margin of a bucket may see too little there, so only its own bucket tells
        d = kept(d.where(own).drop("__b"), "peaks")
        new = d.where("__peak").select(*names)
        found = new if found is None else found.unionByName(new)
        near = d.withColumn("__b", F.explode(margin)).withColumn("__near", F.max(F.col("__peak").cast("int")).over(around))
        left = kept(near.where(own & (F.col("__near") == 0)).drop("__b", "__near"), "left")
        if left.isEmpty():
            return found
