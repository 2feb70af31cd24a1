"""Mixing sources by temperature, in DataFrame functions only.

A source's share p of all tokens becomes a weight proportional to ``p ** exponent``: 1 keeps the natural mix, 0 makes it
even. The exponent is bisected to meet a target: the smallest that repeats no source more than `max_repeats` times, or the
largest whose weights have an entropy of at least a share `entropy` of the even mix's. Weights become token
budgets: the least repeated source is read once in whole, so no document is lost, unless `total_tokens` sets the sum of budgets.

Budgets are spent by block permutations. A source's documents are dealt into blocks by hash; an epoch orders
blocks, and documents inside a block, by hashes of its own. Whole epochs take all documents, the last one takes documents
in its order while the tokens before them are within the budget. Sums of blocks give each block its place, so no task orders a source.

Defined cases: a null source is the source ""; a null text has 0 tokens; rows equal in id and text move together;
a source without tokens is read once; an empty table gives an empty result; extra columns stay (`apply`) or are ignored (`schedule`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import keep

#: Tokens of a block, about, and blocks of a source at least.
BLOCK_TOKENS, LEAST_BLOCKS = 4_000_000, 64
#: Halvings of the exponent's interval; or rounds of TRIES exponents, for a target entropy.
BISECTIONS, ROUNDS, TRIES = 60, 9, 100
WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _even(per: DataFrame, entropy: float) -> float:
    """The largest exponent whose weights have at least a share `entropy` of the even mix's entropy.

    With Z the sum of p ** a and E that of p ** a ln p, the entropy is ln Z - a E / Z: two sums of an aggregation over sources. A round
    tries TRIES exponents at once, so the interval shrinks TRIES + 1 times.
    """
    lo, hi = 0.0, 1.0
    if per.limit(2).count() < 2:
        return hi
    for _ in range(ROUNDS):
        at = [lo + (hi - lo) * (i + 1) / (TRIES + 1) for i in range(TRIES)]
        sums = per.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.pow("p", F.lit(a))) for a in at]).alias("z"), F.array(*[F.sum(F.pow("p", F.lit(a)) * F.ln("p")) for a in at]).alias("e")).first()
        enough = [math.log(z) - a * e / z >= entropy * math.log(sums.n) for a, z, e in zip(at, sums.z, sums.e, strict=True)]
        good = [lo, *[a for a, ok in zip(at, enough, strict=True) if ok]][-1]
        bad = [a for a, ok in zip(at, enough, strict=True) if not ok and a > good]
        lo, hi = good, bad[0] if bad else hi
    return lo


def budgets(rows: DataFrame, max_repeats: float | None = None, entropy: float | None = None, total_tokens: int | None = None) -> DataFrame:
    """(source, tokens, exponent, weight, budget, epochs, rest, blocks) of each source of rows (source, n_tokens). Sources may be as many as rows: they are only aggregated."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    per = keep(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    ends = per.where("tokens > 0").agg(F.sum("tokens").alias("all"), F.max("tokens").alias("top"), F.min("tokens").alias("low"))
    if max_repeats is not None:
        # the repetition limit binds for the smallest source against the largest alone
        def half(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            low = F.pow(F.col("top") / F.col("low"), 1 - mid) <= max_repeats
            return F.struct(F.when(low, s["lo"]).otherwise(mid).alias("lo"), F.when(low, mid).otherwise(s["hi"]).alias("hi"))

        exponent = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), half)["hi"]
    else:
        shares = keep(per.where("tokens > 0").crossJoin(F.broadcast(ends)).select((F.col("tokens") / F.col("all")).alias("p")), "shares")  # one row on the right
        exponent = F.lit(_even(shares, float(entropy)))
    ends = ends.withColumn("exponent", F.when(F.col("all").isNotNull(), F.round(exponent, 9)))
    z = per.where("tokens > 0").crossJoin(F.broadcast(ends)).agg(F.sum(F.pow(F.col("tokens") / F.col("all"), F.col("exponent"))).alias("z"))
    one = ends.crossJoin(z).select("all", "exponent", "z", (F.col("top") / F.col("all")).alias("__most"))  # one row each
    share = F.col("tokens") / F.col("all")
    weight = F.pow(share, F.col("exponent")) / F.col("z")
    # repeats relative to the least repeated source, the largest one
    times = F.pow(F.col("__most") / share, 1 - F.col("exponent")) if total_tokens is None else weight * F.lit(float(total_tokens)) / F.col("tokens")
    if max_repeats is not None and total_tokens is None:
        times = F.least(F.lit(float(max_repeats)), times)
    empty = F.col("tokens") == 0
    out = per.crossJoin(F.broadcast(one))  # one row
    out = out.select("source", "tokens", "exponent", F.when(empty, 0.0).otherwise(weight).alias("weight"), F.when(empty, 0).otherwise(F.round(F.col("tokens") * F.round(times, 6))).cast("bigint").alias("budget"))
    epochs = F.when(empty, 1).otherwise(F.floor(F.col("budget") / F.col("tokens"))).cast("bigint")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.when(empty, 0).otherwise(F.col("epochs") * F.col("tokens"))).withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("bigint"))


def _key(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def _block(seed: int, mark: Column, blocks: Column) -> Column:
    return F.conv(F.substring(_key(seed, F.lit("block"), mark), 1, 8), 16, 10).cast("bigint") % blocks


def _order(seed: int, epoch: Column, source: Column, block: Column, mark: Column) -> tuple[Column, Column]:
    return _key(seed, epoch, source, block), _key(seed, epoch, mark)


def _marked(docs: DataFrame) -> DataFrame:
    """docs with __source, __tokens and __mark, which tells documents apart."""
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    return docs.withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn("__tokens", token_count(F.col("text"))).withColumn("__mark", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))


def _plan(rows: DataFrame, seed: int, **target) -> tuple[DataFrame, DataFrame]:
    """rows: (doc_id, source, n_tokens, mark), kept. The budgets, and a row for each document and epoch with its place."""
    b = keep(budgets(rows, **target), "budgets")
    per = rows.join(_small(b.drop("tokens", "exponent", "weight")), "source")
    per = per.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("rest") > 0, F.col("epochs")).otherwise(F.col("epochs") - 1)))).where("epochs > 0 or rest > 0")
    per = per.withColumn("block", _block(seed, F.col("mark"), F.col("blocks")))
    block_key, doc_key = _order(seed, F.col("epoch"), F.col("source"), F.col("block"), F.col("mark"))
    per = per.withColumn("doc_key", doc_key)
    sums = per.groupBy("source", "epoch", "block").agg(F.sum("n_tokens").alias("__sum"))
    ahead = Window.partitionBy("source", "epoch").orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("block_key", block_key).withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = Window.partitionBy("source", "epoch", "block").orderBy("doc_key").rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy("source", "epoch", "block", "doc_key")
    placed = per.withColumn("__in", F.sum("n_tokens").over(inside) - F.sum("n_tokens").over(same)).join(sums, ["source", "epoch", "block"])
    return b, placed.withColumn("at", F.col("__ahead") + F.col("__in")).where((F.col("epoch") < F.col("epochs")) | (F.col("at") < F.col("rest")))


def _small(b: DataFrame) -> DataFrame:
    """Broadcast the sources' budgets while they are few."""
    return F.broadcast(b) if b.limit(10_001).count() <= 10_000 else b


def schedule(docs: DataFrame, seed: int = 1, **target) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place, mix_at): each reading of a document; ascending mix_at, in [0, 1), is the mix.

    place counts the tokens of its source before it, over all epochs; mix_at is place / budget.
    """
    m = _marked(docs.select("doc_id", "source", "text"))
    rows = keep(m.select("doc_id", F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__mark").alias("mark")), "mix")
    b, placed = _plan(rows, seed, **target)
    placed = placed.join(_small(b.select("source", "tokens")), "source")
    place = F.col("epoch") * F.col("tokens") + F.col("at")
    return placed.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), "block", place.cast("bigint").alias("place"), F.coalesce(F.round(F.try_divide(place, F.col("budget")), 9), F.lit(0.0)).alias("mix_at"))


def apply(docs: DataFrame, seed: int = 1, **target) -> DataFrame:
    """docs, each as often as the mix reads it, with all their columns. Texts are not shuffled: each source's last epoch ends at a key."""
    m = _marked(docs)
    rows = keep(m.select("doc_id", F.col("__source").alias("source"), F.col("__tokens").alias("n_tokens"), F.col("__mark").alias("mark")), "mix")
    b, placed = _plan(rows, seed, **target)
    ends = placed.where(F.col("epoch") == F.col("epochs")).groupBy("source").agg(F.max(F.struct("block_key", "doc_key")).alias("__end"))
    b = keep(b.join(ends, "source", "left").select(F.col("source").alias("__s"), F.col("epochs").alias("__epochs"), F.col("blocks").alias("__blocks"), "__end"), "ends")
    out = m.join(_small(b), F.col("__source") == F.col("__s"))
    block_key, doc_key = _order(seed, F.col("__epochs"), F.col("__source"), _block(seed, F.col("__mark"), F.col("__blocks")), F.col("__mark"))
    more = F.coalesce(F.struct(block_key.alias("block_key"), doc_key.alias("doc_key")) <= F.col("__end"), F.lit(False))
    times = (F.col("__epochs") + more.cast("bigint")).cast("int")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])
