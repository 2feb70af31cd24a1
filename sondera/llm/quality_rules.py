"""Quality rules with risk-controlled cutoffs.

Each rule is a measure in [0, 1], where high is bad, on a grid of 1/GRID steps; a document goes if a measure lies above
its stratum's cutoff. Cutoffs are picked in two steps on the labelled good documents of a stratum (its language) that the base
rule passes, as cutoffs apply to them alone:

1. A tuning part lays a path of ever stricter rule sets. The mildest have cutoffs above all of that part, with less and less room;
   then, at level q, each rule's cutoff is the lowest that rejects at most a share q of it. Rule sets along the path are nested.
2. The other part, the holdout, certifies levels in this order. A level is taken while the exact binomial tail
   ``P(Bin(n, alpha) <= rejected)`` is at most ``delta / strata``, and the first failure ends the walk. The fixed order
   needs no further correction within a stratum, Bonferroni covers the strata: with probability 1 - delta no stratum
   loses more than a share alpha of its good documents to the cutoffs. What the base rule rejects is fixed from outside and
   isn't covered by this promise.

Documents go to the two parts by a hash of their text, so exact copies are in one part and don't count as independent
evidence for what was chosen on them.

A stratum with too few good holdout rows to certify anything gets no cutoffs, and its documents pass the rules.

Statistics are counts by (stratum, rule, step) and by (stratum, level) over all labelled rows; no rows are sampled.

Defined cases: a null text has no words; a null stratum is a stratum of its own; documents without a label, or with
contradicting labels, take no part in the choice; repeated rows count each; an empty table gives an empty result, and
without labels there are no cutoffs; extra columns stay as they are (`judge` keeps them, `measure` does not read them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import sieve, textstats
from .base import keep

GRID = 1000
#: Levels of the path, from the mildest: a negative one stands for room above the highest value of the tuning part, a share of what lies between it and 1.
LEVELS = (-0.5, -0.25, -0.1, -0.05, -0.02, 0.0, 0.0002, 0.0005, 0.001)
ALPHA, DELTA = 0.01, 0.05
#: The base rule: fewer words, or a larger share of words in repeated windows in percent, fail.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Rule → value from the named features.
RULES = {
    "symbols": lambda f: f["symbol_share"],
    "marked_words": lambda f: f["marked_share"],
    "upper": lambda f: f["upper_share"],
    "capital_words": lambda f: f["caps_word_share"],
    "exclamations": lambda f: f["bang_share"],
    "digits": lambda f: f["digit_share"],
    "punctuation": lambda f: f["punct_share"],
    "repeated_lines": lambda f: f["dup_line_share"],
    "repeated_windows": lambda f: f["repeat_share"],
    "bars": lambda f: f["pipe_share"],
    "top_word": lambda f: f["top_word_share"],
    "long_words": lambda f: f["long_share"],
}
#: Strata up to which the table of cutoffs is sent to all tasks; beyond, it is joined.
BROADCAST_STRATA = 10_000
_STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, steps array<smallint>"


def _stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for text in texts:
            base = textstats.base_counts(text or "")
            f = dict(zip(textstats.FEATURES, textstats.features(text or "", base), strict=True))
            rows.append([*base[1:], [min(GRID, int(min(1.0, rule(f)) * GRID)) for rule in RULES.values()]])
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _STATS.split(", ")])


def measure(text: Column) -> Column:
    """struct of the base counts and `steps`, the grid step of each rule's measure."""
    # a filter on one field must not run it a second time below a join: Spark keeps nondeterministic functions where they stand
    f = F.pandas_udf(_stats, f"struct<{', '.join(x.replace(' ', ': ', 1) for x in _STATS.split(', '))}>").asNondeterministic()
    return f(F.coalesce(text.cast("string"), F.lit("")))


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)


def binomial_tail(rejected: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= rejected): terms in logs from the largest count down, until they no longer change the sum."""
    if n <= 0 or rejected >= n:
        return 1.0
    lp, lq, total = math.log(p), math.log1p(-p), 0.0
    for k in range(rejected, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * lp + (n - k) * lq)
        total += term
        if k < p * n and term < total * 1e-18:
            break
    return min(1.0, total)


def certified(rejected: list[int], n: int, alpha: float, delta: float) -> int:
    """How many levels pass, walked from the mildest. A share over alpha fails without summing."""
    for i, k in enumerate(rejected):
        if k >= alpha * n or binomial_tail(k, n, alpha) > delta:
            return i
    return len(rejected)


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, levels: tuple[float, ...] = LEVELS, good: int = 1) -> DataFrame:
    """(stratum, cut array<int>, level, n_holdout, n_rejected): each certified stratum's cutoffs, in the order of RULES.

    stats: (doc_id, stratum, key, base_failed, steps); labels: (doc_id, quality).
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    fine = stats.where("not base_failed").join(marked.where((F.col("lo") == good) & (F.col("hi") == good)).select("doc_id"), "doc_id", "left_semi")
    fine = keep(fine.select("stratum", "steps", (F.pmod(F.xxhash64(F.lit("tune"), "key"), F.lit(2)) == 0).alias("tunes")), "good")
    # The path: at level q a rule's cutoff is the highest step from which on more than a share q of the tuning part lies, and at
    # level -r it lies a share r of the way from the highest step to the end of the grid.
    counts = fine.where("tunes").select("stratum", F.posexplode("steps").alias("rule", "step")).groupBy("stratum", "rule", "step").agg(F.count(F.lit(1)).alias("n"))
    one = Window.partitionBy("stratum", "rule")
    over = counts.withColumn("over", F.sum("n").over(one.orderBy(F.desc("step")))).withColumn("all", F.sum("n").over(one))
    at_level = lambda q: F.max(F.when(F.col("over") > q * F.col("all"), F.col("step"))) if q >= 0 else F.max("step") + F.ceil((GRID - F.max("step")) * F.lit(-q))
    cuts = over.groupBy("stratum", "rule").agg(*[at_level(q).cast("int").alias(f"q{i}") for i, q in enumerate(levels)])
    sets = cuts.groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("rule", *[f"q{i}" for i in range(len(levels))]))).alias("rules"))  # an entry for each rule
    level = lambda i: F.transform("rules", lambda r: r[f"q{i}"])
    paths = keep(sets.select("stratum", F.array(*[level(i) for i in range(len(levels))]).alias("path")), "paths")
    rejects = F.array_position(F.transform("path", lambda cut: F.exists(F.zip_with("steps", cut, lambda s, c: s > c), lambda x: x)), True)
    # the first level that rejects a document; 0: none does
    first = fine.where(~F.col("tunes")).join(_sized(paths).withColumnRenamed("stratum", "__s"), F.col("stratum").eqNullSafe(F.col("__s"))).select("stratum", "path", rejects.cast("int").alias("first"))
    upto = [F.count_if((F.col("first") > 0) & (F.col("first") <= i + 1)) for i in range(len(levels))]
    held = first.groupBy("stratum").agg(F.first("path").alias("path"), F.count(F.lit(1)).alias("n"), F.array(*upto).alias("rejected"))
    strata = max(1, fine.select("stratum").distinct().count())

    def passed(rejected: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([certified([int(x) for x in r], int(k), alpha, delta / strata) for r, k in zip(rejected, n, strict=True)], dtype="int32")

    passed.__annotations__ = {"rejected": pd.Series, "n": pd.Series, "return": pd.Series}
    held = held.withColumn("passed", F.pandas_udf(passed, "int").asNondeterministic()("rejected", "n")).where("passed > 0")  # a row for each stratum
    at = F.array(*[F.lit(q) for q in levels])
    return keep(held.select("stratum", F.element_at("path", F.col("passed")).alias("cut"), F.element_at(at, F.col("passed")).alias("level"), F.col("n").alias("n_holdout"), F.element_at("rejected", F.col("passed")).alias("n_rejected")), "cutoffs")


def _sized(small: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_STRATA rows; more are left to the planner's join."""
    return F.broadcast(small) if small.select("stratum").limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else small


def judge(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows, which have `__of` (stratum) and `__m` (measure()), with __failed and __kept."""
    c = _sized(cuts).select(F.col("stratum").alias("__stratum"), F.col("cut").alias("__cut"))
    failed = base_failed(F.col("__m.n_words"), F.col("__m.n_repeat_words"))
    over = F.coalesce(F.exists(F.zip_with("__m.steps", "__cut", lambda s, x: s > x), lambda x: x), F.lit(False))
    out = rows.join(c, F.col("__of").eqNullSafe(F.col("__stratum")), "left")
    return out.withColumn("__failed", failed).withColumn("__kept", ~failed & ~over).drop("__stratum", "__cut")


def stats_of(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """(doc_id, __key, __of, __m) of each document, kept in the shared folder: texts are read once."""
    key = sieve.document_key(F.col("doc_id"), F.col("text"))
    same = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    return keep(docs.select("doc_id", key.alias("__key"), same.alias("__text"), F.col(stratum_col).cast("string").alias("__of"), measure(F.col("text")).alias("__m")), "stats", texts=True)


def fit(stats: DataFrame, labels: DataFrame) -> DataFrame:
    failed = base_failed(F.col("__m.n_words"), F.col("__m.n_repeat_words"))
    return cutoffs(stats.select("doc_id", F.col("__of").alias("stratum"), F.col("__text").alias("key"), failed.alias("base_failed"), F.col("__m.steps").alias("steps")), labels.select("doc_id", "quality"))


def verdicts(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of each document."""
    stats = stats_of(docs, stratum_col)
    return judge(stats, fit(stats, labels)).select("doc_id", "__m.n_words", "__m.word_chars", "__m.n_symbols", "__m.n_dup_lines", "__m.n_repeat_words", F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """The documents that base rule and cutoffs keep, with all their columns. Texts are measured once, and move only where their document can be one that goes."""
    stats = stats_of(docs, stratum_col)
    gone = keep(judge(stats, fit(stats, labels)).where("not __kept").select("__key", "__of").distinct(), "gone")
    # one id and text may lie in several strata
    key = lambda of, k: F.concat_ws(":", k, F.coalesce(of, F.lit("null")))
    return sieve.without(docs, key(F.col(stratum_col).cast("string"), sieve.document_key(F.col("doc_id"), F.col("text"))), keep(gone.select(key(F.col("__of"), F.col("__key")).alias("__gone")), "gone"), "__gone")
