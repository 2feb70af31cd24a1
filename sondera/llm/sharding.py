"""Sharding by weighted rendezvous hashing of stable record keys.

Each shard draws a uniform number from a hash of (key, shard) and scores ``-weight / ln(u)``; the highest score takes
the record. Only the key, the shards and their weights decide, so one more shard takes records only into itself,
about its share of the weight, and moves nothing else.

Defined cases: null keys share one shard; a null text has no bytes and crc32 0; rows with equal keys go to one shard
and get slots of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import keep

#: Rows of a run of slots that one task numbers, about; and runs of a shard at least.
RUN_ROWS, LEAST_RUNS = 50_000, 48


def score(key: Column, shard: int, weight: float) -> Column:
    """The record's score at a shard; u lies strictly between 0 and 1."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return F.lit(-float(weight)) / F.ln(u)


def rendezvous(key: Column, weights: list[float], grown_by: float | None = None) -> Column:
    """struct(shard, grown_shard): the shard of a key, and the one it has when a shard of weight grown_by joins (else null)."""
    ranked = F.array_max(F.array(*[F.struct(score(key, i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights) if w > 0]))
    shard = (-ranked["shard"]).cast("int")
    if grown_by is None:
        return F.struct(shard.alias("shard"), F.lit(None).cast("int").alias("grown_shard"))
    return F.struct(shard.alias("shard"), F.when(score(key, len(weights), grown_by) > ranked["score"], F.lit(len(weights))).otherwise(shard).cast("int").alias("grown_shard"))


def assign(docs: DataFrame, weights: list[float], grown_by: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row of docs.

    Slots count from 0 in each shard without gaps. A shard is cut into runs by a hash of id and text; a window numbers the rows of a
    run, and the sizes of the runs before it are added, so no task sees a whole shard. A run that many equal rows make too
    long is cut further by their places in the table.
    """
    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), rendezvous(F.col(id_col), weights, grown_by).alias("__to"), F.monotonically_increasing_id().alias("__row"))
    rows = keep(rows.select(id_col, "size", "text_crc32", "__to.*", "__row"), "shards")
    runs = max(LEAST_RUNS, rows.count() // (max(1, len(weights)) * RUN_ROWS))
    rows = rows.withColumn("__run", F.pmod(F.xxhash64(F.col(id_col), F.col("text_crc32"), F.lit("run")), F.lit(runs)).cast("int"))
    long = rows.groupBy("shard", "__run").count().where(F.col("count") > 2 * RUN_ROWS).select("shard", "__run", F.ceil(F.col("count") / RUN_ROWS).alias("__cuts"))
    rows = rows.join(long, ["shard", "__run"], "left").withColumn("__cut", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__cuts")), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("__run", "__cut").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("shard", "__run", "__cut").count().select("shard", "__run", "__cut", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__first"))
    placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__run", "__cut").orderBy(id_col, "text_crc32", "size")) - 1)
    return placed.join(sizes, ["shard", "__run", "__cut"]).select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__first") + F.col("__at")).cast("bigint").alias("slot"), "grown_shard")
