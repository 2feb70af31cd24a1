"""A bit table of bounded size that tells which rows can't be in a set of ids, so that only the others go through a join.

It is a Bloom filter of one hash, kept as 64-bit words. A table of n ids has 16 n bits, but never more than MOST_BITS, so what is
broadcast is bounded whatever the data. Rows of other ids may pass by chance (a sixteenth of them, or more where MOST_BITS binds)
and then merely move; no row of an id of the set is ever held back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 524,288 words at most, some 40 MB as a hashed relation.
LEAST_BITS, MOST_BITS, BITS_AN_ID = 1 << 10, 1 << 25, 16


def _place(c: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(bits).cast("bigint"))


def split(df: DataFrame, col: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose col may be among the ids, rows that certainly aren't). ids: a written table, as it is counted first; null is never among them."""
    n = ids.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_AN_ID * n).bit_length()))
    h = _place(F.col(id_col), bits)
    names = [F.col(f"`{c}`") for c in df.columns]
    words = ids.where(F.col(id_col).isNotNull()).select(F.floor(h / 64).cast("bigint").alias("__sieve_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int")).alias("__sieve_bit")).groupBy("__sieve_word").agg(F.bit_or("__sieve_bit").alias("__sieve_bits"))
    at = _place(F.col(col), bits)
    marked = df.withColumn("__sieve_word", F.floor(at / 64).cast("bigint")).join(F.broadcast(words), "__sieve_word", "left")
    bit = F.call_function("shiftrightunsigned", F.coalesce("__sieve_bits", F.lit(0).cast("bigint")), F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    may = F.col(col).isNotNull() & (bit == 1)
    marked = marked.withColumn("__sieve_may", may)
    return marked.where("__sieve_may").select(*names), marked.where("not __sieve_may").select(*names)


def without(df: DataFrame, key: Column, gone: DataFrame, gone_col: str) -> DataFrame:
    """Rows of df whose key isn't in gone (a written table); rows that can't be there don't move. A null key stays."""
    names = [F.col(f"`{c}`") for c in df.columns]
    may, stay = split(df.withColumn("__sieve_key", key), "__sieve_key", gone, gone_col)
    out = may.join(gone.select(F.col(gone_col).alias("__sieve_gone")).distinct().hint("merge"), F.col("__sieve_key") == F.col("__sieve_gone"), "left_anti")
    return stay.select(*names).unionByName(out.select(*names))


def document_key(doc_id: Column, text: Column) -> Column:
    """128 bits that tell documents apart by id and text; a null text is an empty one."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))
