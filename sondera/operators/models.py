"""Per-source Gaussian and centroid models, scoring and evaluation, as aggregates and joins with the small table of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 95 % and 99 % points of chi-square with two degrees of freedom; variances below the floors are raised to them (fixed values).
MATCH, MARGINAL = 5.991, 9.210
FLOOR_X, FLOOR_Y = 1.0, 1e-8
LEAST_ROWS = 5
#: Models up to which they are sent to all tasks.
MAX_MODELS = 100_000


def gaussian(df: DataFrame, keys: list[str], x: str, y: str, floor_x: float = FLOOR_X, floor_y: float = FLOOR_Y) -> DataFrame:
    """(keys, n, mx, my, vx, vy, cxy): mean and sample covariance of each key, with floors; fewer than 2 rows have the floors alone."""
    g = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("cxy"))
    few = F.col("n") < 2
    return g.select(*keys, "n", "mx", "my", F.when(few, floor_x).otherwise(F.greatest("vx", F.lit(floor_x))).alias("vx"), F.when(few, floor_y).otherwise(F.greatest("vy", F.lit(floor_y))).alias("vy"), F.when(few, 0.0).otherwise(F.col("cxy")).alias("cxy"))


def mahalanobis2(dx: Column, dy: Column, vx: Column, vy: Column, cxy: Column) -> Column:
    det = vx * vy - cxy * cxy
    return (vy * dx * dx - 2 * cxy * dx * dy + vx * dy * dy) / det


def small(models: DataFrame) -> DataFrame:
    """Broadcast a table of models while it has at most MAX_MODELS rows."""
    return F.broadcast(models) if models.limit(MAX_MODELS + 1).count() <= MAX_MODELS else models


def least_of(rows: DataFrame, models: DataFrame, row_id: list[str], score: Callable[[Column], Column], out: str) -> DataFrame:
    """rows with `out`, the least score(model) over all models (structs); null without models.

    Up to MAX_MODELS models are one array that is sent to all tasks, and no row moves. More of them are dealt into blocks of that size
    by hash: rows meet one block after another, each block being a single row, and only a score for each row and block is aggregated.
    """
    fields = F.struct(*models.columns).alias("m")
    if models.limit(MAX_MODELS + 1).count() <= MAX_MODELS:
        one = models.agg(F.collect_list(fields).alias("__models"))
        return rows.join(F.broadcast(one), how="inner", on=F.lit(True)).withColumn(out, F.array_min(F.transform("__models", score))).drop("__models")
    n = -(-models.count() // (MAX_MODELS // 2))
    blocks = models.groupBy(F.pmod(F.xxhash64(*models.columns), F.lit(n)).alias("__block")).agg(F.collect_list(fields).alias("__models"))
    dealt = rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))).join(blocks.hint("shuffle_hash"), "__block")
    best = dealt.withColumn("__least", F.array_min(F.transform("__models", score))).groupBy(*row_id).agg(F.min("__least").alias(out))
    return rows.join(best, row_id, "left")


def least_in(rows: DataFrame, models: DataFrame, row_key: str, model_key: str, row_id: list[str], score: Callable[[Column], Column], out: str) -> DataFrame:
    """least_of() where a row meets the models of its own key alone (a fold, a receiver); rows of a key without models are absent."""
    fields = F.struct(*models.columns)
    if models.limit(MAX_MODELS + 1).count() <= MAX_MODELS:
        per = models.groupBy(F.col(model_key).alias("__key")).agg(F.collect_list(fields).alias("__models"))
        return rows.join(F.broadcast(per), F.col(row_key) == F.col("__key")).withColumn(out, F.array_min(F.transform("__models", score))).drop("__key", "__models")
    met = rows.join(models.select(F.col(model_key).alias("__key"), fields.alias("__model")), F.col(row_key) == F.col("__key")).withColumn(out, score(F.col("__model")))
    return rows.join(met.groupBy(*row_id).agg(F.min(out).alias(out)), row_id)


def classify(rows: DataFrame, models: DataFrame, row_id: list[str], model_id: str, x: str, y: str, match: float = MATCH, marginal: float = MARGINAL, least: int = LEAST_ROWS, exclude: str | None = None) -> DataFrame:
    """(row_id, nearest, d2, verdict): MATCH, MARGINAL or STRANGER by the nearest model, UNSCORED without a model of `least` rows. exclude: a column of rows that names a model which isn't asked."""
    m = models.where(F.col("n") >= least).select(F.col(model_id).alias("__m"), "mx", "my", "vx", "vy", "cxy")

    def score(c: Column) -> Column:
        d2 = mahalanobis2(F.col(x) - c["mx"], F.col(y) - c["my"], c["vx"], c["vy"], c["cxy"])
        return F.when(d2.isNotNull() if exclude is None else d2.isNotNull() & ~c["__m"].eqNullSafe(F.col(exclude)), F.struct(d2.alias("d2"), c["__m"].alias("m")))

    best = least_of(rows, m, row_id, score, "__best")
    d = F.col("__best.d2")
    verdict = F.when(d.isNull(), "UNSCORED").when(d <= match, "MATCH").when(d <= marginal, "MARGINAL").otherwise("STRANGER")
    return best.select(*row_id, F.col("__best.m").alias("nearest"), d.alias("d2"), verdict.alias("verdict"))


def separations(models: DataFrame, key: str, least: int = LEAST_ROWS) -> DataFrame:
    """(a, b, d): distance of each pair of sources of `least` rows under their pooled covariance."""
    models = models.where(F.col("n") >= least)
    pooled = models.agg((F.sum((F.col("n") - 1) * F.col("vx")) / F.sum(F.col("n") - 1)).alias("pvx"), (F.sum((F.col("n") - 1) * F.col("vy")) / F.sum(F.col("n") - 1)).alias("pvy"), (F.sum((F.col("n") - 1) * F.col("cxy")) / F.sum(F.col("n") - 1)).alias("pcxy"))
    a = models.select(F.col(key).alias("a"), F.col("mx").alias("ax"), F.col("my").alias("ay"))
    b = models.select(F.col(key).alias("b"), F.col("mx").alias("bx"), F.col("my").alias("by"))
    pairs = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(pooled))  # one row
    return pairs.select("a", "b", F.sqrt(mahalanobis2(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"), F.col("pvx"), F.col("pvy"), F.col("pcxy"))).alias("d"))


def nearest_centroid(train: DataFrame, test: DataFrame, label: str, row_id: str, vector: str) -> DataFrame:
    """(row_id, predicted): nearest class by distance to medians in units of each feature's spread (1.4826 x MAD over all training rows); ties go to the least label."""
    long = train.select(label, F.posexplode(vector).alias("j", "v"))
    centre = long.groupBy(label, "j").agg(F.median("v").alias("c"))
    mid = long.groupBy("j").agg(F.median("v").alias("m"))
    spread = long.join(small(mid), "j").groupBy("j").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("m")))).alias("s")).select("j", F.when(F.col("s") > 0, F.col("s")).otherwise(1e-9).alias("s"))
    model = centre.join(spread, "j").select(F.col(label).alias("__l"), "j", "c", "s")
    t = test.select(row_id, F.posexplode(vector).alias("j", "v"))
    d = t.join(small(model), "j").groupBy(row_id, "__l").agg(F.sum(F.pow((F.col("v") - F.col("c")) / F.col("s"), 2)).alias("d"))
    return d.groupBy(row_id).agg(F.min(F.struct(F.round("d", 9).alias("d"), "__l")).alias("b")).select(row_id, F.col("b.__l").alias("predicted"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def rates(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """One row: n, precision, recall, false positive rate, balanced accuracy."""
    t, p = F.sum(F.when(truth & predicted, 1).otherwise(0)), F.sum(F.when(predicted, 1).otherwise(0))
    pos, neg = F.sum(F.when(truth, 1).otherwise(0)), F.sum(F.when(truth, 0).otherwise(1))
    fp = F.sum(F.when(~truth & predicted, 1).otherwise(0))
    ratio = lambda a, b: F.when(b > 0, a / b)
    return df.agg(F.count(F.lit(1)).alias("n"), ratio(t, p).alias("precision"), ratio(t, pos).alias("recall"), ratio(fp, neg).alias("fpr"), ((ratio(t, pos) + 1 - ratio(fp, neg)) / 2).alias("balanced"))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg): rows of each distinct score, so that ties count half and one value is one row."""
    return df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))


def _both_kinds(df: DataFrame, label: str, score: str, group: list[str]) -> DataFrame:
    """(group, score, pos, neg, allpos, allneg): rows of each distinct score, in groups that have both labels."""
    c = df.groupBy(*group, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"))
    w = Window.partitionBy(*group)
    return c.withColumn("allpos", F.sum("pos").over(w)).withColumn("allneg", F.sum("neg").over(w)).where("allpos > 0 AND allneg > 0")


def auc(df: DataFrame, label: str, score: str, group: list[str]) -> DataFrame:
    """(group, auc) by rank sums, ties counting half; a group with one label alone is absent."""
    below = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = _both_kinds(df, label, score, group).withColumn("__below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    return won.groupBy(*group).agg((F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2.0)) / (F.first("allpos") * F.first("allneg"))).alias("auc"))


def eer(df: DataFrame, label: str, score: str, group: list[str]) -> DataFrame:
    """(group, eer, threshold): where false accepts (score >= threshold) and false rejects are closest; a group with one label alone is absent."""
    run = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    r = _both_kinds(df, label, score, group).withColumn("frr", F.coalesce(F.sum("pos").over(run), F.lit(0)) / F.col("allpos")).withColumn("far", 1 - F.coalesce(F.sum("neg").over(run), F.lit(0)) / F.col("allneg"))
    best = r.groupBy(*group).agg(F.min(F.struct(F.round(F.abs(F.col("far") - F.col("frr")), 12).alias("gap"), F.col(score).alias("threshold"), "far", "frr")).alias("b"))
    return best.select(*group, ((F.col("b.far") + F.col("b.frr")) / 2).alias("eer"), F.col("b.threshold").alias("threshold"))


#: Cosine distance up to which a template is met.
MET = 0.15


def template_verdict(distance: Column, known: Column, met: float = MET) -> Column:
    """Of the distance to the nearest template of a library, and whether the library knows the id that was seen."""
    near = F.coalesce(distance <= met, F.lit(False))
    return F.when(near & known, "KNOWN").when(near, "MATCH OF A NEW ID").when(known, "KNOWN ID IS OFF").otherwise("STRANGER")


#: A change counts from so many times the drift; cosine of two moves from which they go together, or against each other.
BEYOND_DRIFT, TOGETHER = 3.0, 0.3


def swap_test(df: DataFrame, group: list[str], session: str, device: str, x: str, y: str) -> DataFrame:
    """(group, drift, d_dev, d_pos, cosine, sign, verdict) of two devices that changed places.

    df has a mean (x, y) for each session (0, 1 before, 2 after the swap) and device (0, 1). drift: mean distance between sessions 0 and 1, the band that counts as
    nothing. d_dev: the larger distance of a device to itself after the swap; d_pos: of a place to itself, where the other device stands then. cosine: of both
    devices' moves; a swap moves them against each other, a change of the room together. Groups without all six means have no verdict.
    """
    at = {(s, d): [F.max(F.when((F.col(session) == s) & (F.col(device) == d), F.col(c))) for c in (x, y)] for s in (0, 1, 2) for d in (0, 1)}
    g = df.groupBy(*group).agg(*[v.alias(f"__{i}{s}{d}") for (s, d), vs in at.items() for i, v in enumerate(vs)])
    p = lambda s, d: (F.col(f"__0{s}{d}"), F.col(f"__1{s}{d}"))
    far = lambda a, b: F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2))
    most = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
    m0, m1 = ([b - a for a, b in zip(p(0, d), p(2, d), strict=True)] for d in (0, 1))
    size = F.sqrt(m0[0] * m0[0] + m0[1] * m0[1]) * F.sqrt(m1[0] * m1[0] + m1[1] * m1[1])
    g = g.select(*group, ((far(p(0, 0), p(1, 0)) + far(p(0, 1), p(1, 1))) / 2).alias("drift"), most(far(p(0, 0), p(2, 0)), far(p(0, 1), p(2, 1))).alias("d_dev"), most(far(p(0, 0), p(2, 1)), far(p(0, 1), p(2, 0))).alias("d_pos"), F.when(size > 0, (m0[0] * m1[0] + m0[1] * m1[1]) / size).alias("cosine"))
    dev, pos, r = F.col("d_dev"), F.col("d_pos"), F.col("drift")
    verdict = F.when((dev <= r) & (pos > BEYOND_DRIFT * r), "DEVICE").when((pos <= r) & (dev > BEYOND_DRIFT * r), "POSITION").when((dev <= r) & (pos <= r), "UNDERPOWERED").when(dev.isNotNull() & pos.isNotNull() & r.isNotNull(), "MIXED")
    sign = F.when(F.col("cosine") < -TOGETHER, "AGAINST").when(F.col("cosine") > TOGETHER, "TOGETHER").when(F.col("cosine").isNotNull(), "NEITHER")
    return g.select(*group, "drift", "d_dev", "d_pos", "cosine", sign.alias("sign"), verdict.alias("verdict"))
