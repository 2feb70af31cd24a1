"""Arrays in a cell, Gaussian and centroid models, evaluation, and statistics; each with its SQL where SQL can say it."""

from __future__ import annotations

import itertools

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.expr import r6
from ..operators import models, stats
from ..operators import windows as win
from ..session import frames, table
from .catalog import register
from .frame_queries import DAY, _sql

_V = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_XY = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_G = "g AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, greatest(var_samp(x), 1.0) AS vx, greatest(var_samp(y), 1e-8) AS vy, covar_samp(x, y) AS cxy FROM p GROUP BY label)"


def _e(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _points(spark, sf_dir):
    e = _vectors(spark, sf_dir)
    return e.select("vec_id", "label", (F.col("v")[0] * 10).alias("x"), F.col("v")[1].alias("y"))


# --- arrays


@register(_e(_V, body="SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: v[2 * i])), 6) + 0.0 AS re, round(list_sum(list_transform(range(1, 33), lambda i: v[2 * i - 1])), 6) + 0.0 AS im FROM e WHERE len(v) >= 64"))
def prj1_complex(spark, sf_dir):
    """Interleaved [imaginary, real] pairs as two arrays; rows that are too short drop out."""
    i = F.sequence(F.lit(0), F.lit(31))
    e = _vectors(spark, sf_dir).where(F.size("v") >= 64)
    c = e.select("vec_id", F.transform(i, lambda k: F.get("v", 2 * k + 1)).alias("re"), F.transform(i, lambda k: F.get("v", 2 * k)).alias("im"))
    return c.select("vec_id", r6(expr.arr_sum(F.col("re"))).alias("re"), r6(expr.arr_sum(F.col("im"))).alias("im"))


@register(_e(_V, body="SELECT vec_id, v[59] AS first, v[27] AS last, round(list_sum(list_concat(v[39:64], v[2:27])), 6) + 0.0 AS total FROM e"))
def prj2_gather(spark, sf_dir):
    """The 52 used places of a 64-point spectrum in frequency order: -26 to -1, then 1 to 26."""
    v = F.concat(F.slice("v", 39, 26), F.slice("v", 2, 26))
    e = _vectors(spark, sf_dir).select("vec_id", v.alias("u"))
    return e.select("vec_id", F.get("u", F.lit(20)).alias("first"), F.get("u", F.lit(51)).alias("last"), r6(expr.arr_sum(F.col("u"))).alias("total"))


@register(_e(_V, body="SELECT vec_id, round(m, 6) + 0.0 AS mean, round(sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)), 6) + 0.0 AS rms, round(list_max(a) / m, 6) + 0.0 AS peak FROM (SELECT vec_id, a, list_sum(a) / len(a) AS m FROM (SELECT vec_id, list_transform(v, lambda x: abs(x)) AS a FROM e)) WHERE m > 0"))
def prj3_unit_mean(spark, sf_dir):
    e = _vectors(spark, sf_dir).select("vec_id", F.transform("v", F.abs).alias("a")).withColumn("m", expr.arr_mean(F.col("a"))).where("m > 0")
    return e.select("vec_id", r6("m").alias("mean"), r6(F.sqrt(expr.arr_sum(F.transform("a", lambda x: x * x)) / F.size("a"))).alias("rms"), r6(F.array_max(F.transform("a", lambda x: x / F.col("m")))).alias("peak"))


@register(_e(_V, body="SELECT vec_id, round(n, 6) + 0.0 AS norm, CASE WHEN n > 0 THEN round(v[1] / n, 6) + 0.0 ELSE 0.0 END AS first FROM (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)"))
def prj4_normalise(spark, sf_dir):
    e = _vectors(spark, sf_dir).withColumn("n", expr.norm(F.col("v")))
    return e.select("vec_id", r6("n").alias("norm"), F.when(F.col("n") > 0, r6(F.col("v")[0] / F.col("n"))).otherwise(0.0).alias("first"))


@register(_e(_V, body="SELECT vec_id, round(ln(greatest(abs(v[1]), 1e-300)), 6) + 0.0 AS f_log, round(v[2] - v[3], 6) + 0.0 AS f_diff, round(v[4], 6) + 0.0 AS f_raw FROM e"))
def prj8_feature_vector(spark, sf_dir):
    v = F.col("v")
    return _vectors(spark, sf_dir).select("vec_id", r6(F.ln(F.greatest(F.abs(v[0]), F.lit(1e-300)))).alias("f_log"), r6(v[1] - v[2]).alias("f_diff"), r6(v[3]).alias("f_raw"))


@register(_e(_V, body="SELECT vec_id, label FROM e WHERE len(list_filter(v[1:8], lambda x: abs(x) < 0.001)) <= 1 AND list_max(v) > 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0"))
def flt8_admissible(spark, sf_dir):
    small = F.size(F.filter(F.slice("v", 1, 8), lambda x: F.abs(x) < 0.001))
    return _vectors(spark, sf_dir).where((small <= 1) & F.exists("v", lambda x: x > 0) & (expr.dot(F.col("v"), F.col("v")) > 0)).select("vec_id", "label")


@register(_e(_V, "x AS (SELECT vec_id, unnest(range(64)) AS j, unnest(v) * 8 AS v FROM e)", "d AS (SELECT *, v - lag(v) OVER (PARTITION BY vec_id ORDER BY j) AS d FROM x)", "t AS (SELECT *, CASE WHEN d IS NULL OR abs(d) <= pi() THEN 0 ELSE -floor((d + pi()) / (2 * pi())) END AS turn FROM d)", body="SELECT vec_id, round(sum(u), 6) + 0.0 AS total, round(max(u) - min(u), 6) + 0.0 AS span FROM (SELECT vec_id, v + 2 * pi() * sum(turn) OVER (PARTITION BY vec_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS u FROM t) GROUP BY vec_id"))
def dsp1_unwrap(spark, sf_dir):
    """Phase unwrapping inside a vector, as a fold that stays in the JVM."""
    e = _vectors(spark, sf_dir).select("vec_id", expr.unwrap(F.transform("v", lambda x: x * 8)).alias("u"))
    return e.select("vec_id", r6(expr.arr_sum(F.col("u"))).alias("total"), r6(F.array_max("u") - F.array_min("u")).alias("span"))


@register(_e(_V, body="SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * (i - 32.5))) / list_sum(list_transform(range(1, 65), lambda i: (i - 32.5) * (i - 32.5))), 6) + 0.0 AS slope FROM e"))
def dsp5_ols(spark, sf_dir):
    k = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i - F.lit(32.5))
    return _vectors(spark, sf_dir).withColumn("k", k).select("vec_id", r6(expr.dot(F.col("v"), F.col("k")) / expr.dot(F.col("k"), F.col("k"))).alias("slope"))


@register(_e(_V, body="SELECT vec_id, round(list_sum(list_transform(range(1, 64), lambda i: abs(v[i + 1] - v[i]))) / 63, 6) + 0.0 AS roughness, round(sqrt(list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / 64) / list_sum(list_transform(v, lambda x: abs(x))) * 64, 6) + 0.0 AS cv, len(list_filter(v, lambda x: x = 0)) AS zeros FROM (SELECT vec_id, v, list_sum(v) / 64 AS m FROM e)"))
def dsp7_shape(spark, sf_dir):
    v = F.col("v")
    rough = expr.arr_sum(F.zip_with(F.slice(v, 2, 63), F.slice(v, 1, 63), lambda a, b: F.abs(a - b))) / 63
    e = _vectors(spark, sf_dir).withColumn("m", expr.arr_sum(v) / 64)
    sd = F.sqrt(expr.arr_sum(F.transform("v", lambda x: (x - F.col("m")) * (x - F.col("m")))) / 64)
    return e.select("vec_id", r6(rough).alias("roughness"), r6(sd / expr.arr_sum(F.transform("v", F.abs)) * 64).alias("cv"), F.size(F.filter("v", lambda x: x == 0)).cast("bigint").alias("zeros"))


@register(_e(_V, body="SELECT vec_id, label, CASE WHEN p IS NOT NULL THEN round(list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - p[i]))) / 64, 6) + 0.0 END AS motion FROM (SELECT vec_id, label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM e)"))
def dsp15_frame_motion(spark, sf_dir):
    e = _vectors(spark, sf_dir).withColumn("p", F.lag("v").over(Window.partitionBy("label").orderBy("vec_id")))
    return e.select("vec_id", "label", F.when(F.col("p").isNotNull(), r6(expr.arr_sum(F.zip_with("v", "p", lambda a, b: F.abs(a - b))) / 64)).alias("motion"))


@register(_e(_V, body="SELECT i AS x, j AS y, round(sum(w * exp(-sqrt((i - px) * (i - px) + (j - py) * (j - py)) / 3)), 6) + 0.0 AS field FROM (SELECT unnest(range(8)) AS i) a, (SELECT unnest(range(8)) AS j) b, (SELECT label % 8 AS px, (label * 3) % 8 AS py, avg(list_sum(list_transform(v, lambda x: abs(x))) / len(v)) AS w FROM e GROUP BY label) l GROUP BY i, j"))
def dsp14_field(spark, sf_dir):
    """A field on a fixed grid as the sum of decaying contributions of links; a link weighs what its vectors deviate on average."""
    link = _vectors(spark, sf_dir).groupBy("label").agg(F.avg(expr.arr_mean(F.transform("v", F.abs))).alias("w")).select((F.col("label") % 8).alias("px"), (F.col("label") * 3 % 8).alias("py"), "w")
    grid = F.sequence(F.lit(0), F.lit(7))
    g = link.withColumn("x", F.explode(grid)).withColumn("y", F.explode(grid))  # 64 cells for each link
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2))
    return g.groupBy(F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).agg(r6(F.sum(F.col("w") * F.exp(-d / 3))).alias("field"))


@register(_e(_V, "t AS (SELECT label, j, avg(x) AS c FROM (SELECT label, unnest(range(64)) AS j, unnest(v) AS x FROM e WHERE label < 7) GROUP BY label, j)", "q AS (SELECT vec_id, unnest(range(64)) AS j, unnest(v) AS x FROM e)", "d AS (SELECT q.vec_id, t.label, round(1 - sum(q.x * t.c) / (sqrt(sum(q.x * q.x)) * sqrt(sum(t.c * t.c))), 6) + 0.0 AS d FROM q JOIN t ON q.j = t.j GROUP BY q.vec_id, t.label)", body="SELECT vec_id, min(label) AS nearest, min(d) AS distance, CASE WHEN min(d) <= 0.15 THEN CASE WHEN any_value(own) < 7 THEN 'KNOWN' ELSE 'MATCH OF A NEW ID' END WHEN any_value(own) < 7 THEN 'KNOWN ID IS OFF' ELSE 'STRANGER' END AS verdict FROM (SELECT d.*, e.label AS own, min(d) OVER (PARTITION BY vec_id) AS best FROM d JOIN e USING (vec_id)) WHERE d = best GROUP BY vec_id"))
def ml8_cosine(spark, sf_dir):
    """Nearest template of a library of ids (labels below 7) by cosine distance, and one of four verdicts: near one or not, of an id that the library knows or not."""
    e = _vectors(spark, sf_dir)
    known = F.col("label") < 7
    t = e.where(known).select("label", F.posexplode("v").alias("j", "x")).groupBy("label", "j").agg(F.avg("x").alias("c")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "c"))), lambda s: s["c"]).alias("c"))
    t = t.select(F.col("label").alias("__l"), "c", expr.norm(F.col("c")).alias("cn"))
    far = lambda m: F.struct(r6(1 - expr.dot(F.col("v"), m["c"]) / (F.col("vn") * m["cn"])).alias("d"), m["model"].alias("model"))
    best = models.least_of(e.select("vec_id", "v", expr.norm(F.col("v")).alias("vn"), known.alias("known")), t.withColumnRenamed("__l", "model"), ["vec_id", "known"], far, "b")
    return best.select("vec_id", F.col("b.model").alias("nearest"), F.col("b.d").alias("distance"), models.template_verdict(F.col("b.d"), F.col("known")).alias("verdict"))


# --- Gaussian models


@register(_e(_XY, _G, body="SELECT label, n, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy, round(cxy, 6) + 0.0 AS cxy FROM g"))
def agg14_cov(spark, sf_dir):
    g = models.gaussian(_points(spark, sf_dir), ["label"], "x", "y")
    return g.select("label", "n", *[r6(c).alias(c) for c in ("mx", "my", "vx", "vy", "cxy")])


@register(_e(_XY, _G, body="SELECT round(sum((n - 1) * vx) / sum(n - 1), 6) + 0.0 AS vx, round(sum((n - 1) * vy) / sum(n - 1), 6) + 0.0 AS vy, round(sum((n - 1) * cxy) / sum(n - 1), 6) + 0.0 AS cxy FROM g"))
def agg15_pooled_cov(spark, sf_dir):
    g = models.gaussian(_points(spark, sf_dir), ["label"], "x", "y").where("n > 1")
    pool = lambda c: r6(F.sum((F.col("n") - 1) * F.col(c)) / F.sum(F.col("n") - 1)).alias(c)
    return g.agg(pool("vx"), pool("vy"), pool("cxy"))


_D2 = "(g.vy * (p.x - g.mx) * (p.x - g.mx) - 2 * g.cxy * (p.x - g.mx) * (p.y - g.my) + g.vx * (p.y - g.my) * (p.y - g.my)) / (g.vx * g.vy - g.cxy * g.cxy)"


@register(_e(_XY, _G, f"d AS (SELECT p.vec_id, g.label, {_D2} AS d2 FROM p, g WHERE g.n >= 5)", body="SELECT vec_id, round(min(d2), 6) + 0.0 AS d2, CASE WHEN min(d2) <= 5.991 THEN 'MATCH' WHEN min(d2) <= 9.21 THEN 'MARGINAL' ELSE 'STRANGER' END AS verdict, arg_min(label, d2) AS nearest FROM d GROUP BY vec_id"))
def ml1_mahalanobis(spark, sf_dir):
    p = _points(spark, sf_dir)
    c = models.classify(p, models.gaussian(p, ["label"], "x", "y"), ["vec_id"], "label", "x", "y")
    return c.select("vec_id", r6("d2").alias("d2"), "verdict", "nearest")


@register(_e(_XY, _G, body=f"SELECT p.vec_id, p.label, round({_D2}, 6) + 0.0 AS d2 FROM p JOIN g ON p.label = g.label WHERE g.n >= 5"))
def ml2_self_consistency(spark, sf_dir):
    """Distance of each row to its own source's model; sources of under five rows have none yet."""
    p = _points(spark, sf_dir)
    j = p.join(models.gaussian(p, ["label"], "x", "y").where(F.col("n") >= models.LEAST_ROWS), "label")
    c = F.col
    return j.select("vec_id", "label", r6(models.mahalanobis2(c("x") - c("mx"), c("y") - c("my"), c("vx"), c("vy"), c("cxy"))).alias("d2"))


@register(_e(_XY, _G.replace("GROUP BY label", "GROUP BY label HAVING count(*) >= 5"), "q AS (SELECT sum((n - 1) * vx) / sum(n - 1) AS vx, sum((n - 1) * vy) / sum(n - 1) AS vy, sum((n - 1) * cxy) / sum(n - 1) AS cxy FROM g)", body="SELECT a.label AS a, b.label AS b, round(sqrt((q.vy * (a.mx - b.mx) * (a.mx - b.mx) - 2 * q.cxy * (a.mx - b.mx) * (a.my - b.my) + q.vx * (a.my - b.my) * (a.my - b.my)) / (q.vx * q.vy - q.cxy * q.cxy)), 6) + 0.0 AS d FROM g a JOIN g b ON a.label < b.label, q"))
def ml3_separation(spark, sf_dir):
    s = models.separations(models.gaussian(_points(spark, sf_dir), ["label"], "x", "y"), "label")
    return s.select("a", "b", r6("d").alias("d"))


_SPLIT = "s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) <= greatest(CAST(floor(count(*) OVER (PARTITION BY label) * 0.6) AS BIGINT), 1) AS trains FROM p)"
_GT = "g AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, greatest(var_samp(x), 1.0) AS vx, greatest(var_samp(y), 1e-8) AS vy, covar_samp(x, y) AS cxy FROM s WHERE trains GROUP BY label)"


@register(_e(_XY, _SPLIT, _GT, f"d AS (SELECT p.vec_id, p.label AS truth, g.label, {_D2} AS d2 FROM s p, g WHERE g.n >= 5 AND NOT p.trains)", "c AS (SELECT vec_id, truth, arg_min(label, d2) AS said, min(d2) AS d2 FROM d GROUP BY vec_id, truth)", body="SELECT truth, count(*) AS n, count(*) FILTER (WHERE said = truth AND d2 <= 9.21) AS correct, count(*) FILTER (WHERE said <> truth AND d2 <= 9.21) AS wrong, count(*) FILTER (WHERE d2 > 9.21) AS refused FROM c GROUP BY truth"))
def ml4_holdout(spark, sf_dir):
    """Models from the first 60 % of each source, the rest classified: right, wrong or refused."""
    s = win.chronological(_points(spark, sf_dir), "label", "vec_id")
    g = models.gaussian(s.where("trains"), ["label"], "x", "y")
    test = s.where(~F.col("trains")).withColumnRenamed("label", "truth")
    c = models.classify(test, g, ["vec_id", "truth"], "label", "x", "y")
    in_gate = F.col("d2") <= models.MARGINAL
    return c.groupBy("truth").agg(F.count(F.lit(1)).alias("n"), F.count_if(in_gate & (F.col("nearest") == F.col("truth"))).alias("correct"), F.count_if(in_gate & (F.col("nearest") != F.col("truth"))).alias("wrong"), F.count_if(~in_gate).alias("refused"))


_FOLDS = (
    "x AS (SELECT vec_id, vec_id % 2 AS h, label, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "c AS (SELECT h, label, j, median(v) AS c FROM x GROUP BY h, label, j)",
    "m AS (SELECT h, j, median(v) AS m FROM x GROUP BY h, j)",
    "s AS (SELECT x.h, x.j, 1.4826 * median(abs(x.v - m.m)) AS s FROM x JOIN m ON x.h = m.h AND x.j = m.j GROUP BY x.h, x.j)",
    "d AS (SELECT x.vec_id, c.label, round(sum(((x.v - c.c) / s.s) * ((x.v - c.c) / s.s)), 9) AS d FROM x JOIN c ON x.j = c.j AND x.h = 1 - c.h JOIN s ON x.j = s.j AND x.h = 1 - s.h GROUP BY x.vec_id, c.label)",
)


@register(_e(*_FOLDS, body="SELECT vec_id, min(label) AS predicted FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS best FROM d) WHERE d = best GROUP BY vec_id"))
def ml5_nearest_centroid(spark, sf_dir):
    """All vectors by all their components, each half (the operator's fold) against centroids of the other."""
    e = _vectors(spark, sf_dir).select("vec_id", "label", "v")
    halves = [e.where(F.col("vec_id") % 2 == i) for i in (0, 1)]
    a, b = (models.nearest_centroid(halves[i], halves[1 - i], "label", "vec_id", "v") for i in (0, 1))
    return a.unionByName(b)


@register(_e(_XY, body="SELECT vec_id, label, round((x - m) / (1.4826 * mad), 6) + 0.0 AS z FROM (SELECT p.*, b.m, b.mad FROM p JOIN (SELECT a.label, a.m, median(abs(p.x - a.m)) AS mad FROM p JOIN (SELECT label, median(x) AS m FROM p GROUP BY label) a ON p.label = a.label GROUP BY a.label, a.m) b ON p.label = b.label) WHERE mad > 0"))
def ml6_robust_z(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("m", F.median("x").over(Window.partitionBy("label")))
    mad = F.median(F.abs(F.col("x") - F.col("m"))).over(Window.partitionBy("label"))
    return p.withColumn("mad", mad).where("mad > 0").select("vec_id", "label", r6((F.col("x") - F.col("m")) / (1.4826 * F.col("mad"))).alias("z"))


_SCORES = "t AS (SELECT d.lang AS g, CAST(l.quality AS INTEGER) AS y, round(d.n_chars / 100.0) AS s FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _scores(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    return d.join(l, "doc_id").select(F.col("lang").alias("g"), F.col("quality").alias("y"), F.round(F.col("n_chars") / 100.0).alias("s"))


@register(_e(_SCORES, body="SELECT a.g, round(sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) / count(*), 6) + 0.0 AS auc FROM t a JOIN t b ON a.g = b.g AND a.y = 1 AND b.y = 0 GROUP BY a.g"))
def ml7_auc(spark, sf_dir):
    a = models.auc(_scores(spark, sf_dir), "y", "s", ["g"])
    return a.select("g", r6("auc").alias("auc"))


@register(_e(_SCORES, "c AS (SELECT g, s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM t WHERE g IN (SELECT g FROM t GROUP BY g HAVING min(y) = 0 AND max(y) = 1) GROUP BY g, s)", "r AS (SELECT g, s, coalesce(sum(pos) OVER w, 0) / sum(pos) OVER (PARTITION BY g) AS frr, 1 - coalesce(sum(neg) OVER w, 0) / sum(neg) OVER (PARTITION BY g) AS far FROM c WINDOW w AS (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", "k AS (SELECT *, round(abs(far - frr), 12) AS gap, min(round(abs(far - frr), 12)) OVER (PARTITION BY g) AS best FROM r)", body="SELECT g, round((far + frr) / 2, 6) + 0.0 AS eer, s AS threshold FROM k WHERE gap = best QUALIFY row_number() OVER (PARTITION BY g ORDER BY s) = 1"))
def ml7_eer(spark, sf_dir):
    e = models.eer(_scores(spark, sf_dir), "y", "s", ["g"])
    return e.select("g", r6("eer").alias("eer"), "threshold")


@register(_e(_SCORES, body="SELECT y AS truth, CASE WHEN s > 15 THEN 1 ELSE 0 END AS said, count(*) AS n FROM t GROUP BY 1, 2"))
def agg17_confusion(spark, sf_dir):
    t = _scores(spark, sf_dir).select(F.col("y").alias("truth"), F.when(F.col("s") > 15, 1).otherwise(0).alias("said"))
    return models.confusion(t, "truth", "said")


@register(_e(_SCORES, "x AS (SELECT y = 1 AS t, s > 15 AS p FROM t)", "n AS (SELECT count(*) AS n, count(*) FILTER (WHERE t AND p) * 1.0 AS tp, count(*) FILTER (WHERE NOT t AND p) * 1.0 AS fp, count(*) FILTER (WHERE p) AS pp, count(*) FILTER (WHERE t) AS pos, count(*) FILTER (WHERE NOT t) AS neg FROM x)", body="SELECT n, round(tp / pp, 6) + 0.0 AS precision, round(tp / pos, 6) + 0.0 AS recall, round(fp / neg, 6) + 0.0 AS fpr, round((tp / pos + 1 - fp / neg) / 2, 6) + 0.0 AS balanced FROM n"))
def agg17_rates(spark, sf_dir):
    r = models.rates(_scores(spark, sf_dir), F.col("y") == 1, F.col("s") > 15)
    return r.select("n", *[r6(c).alias(c) for c in ("precision", "recall", "fpr", "balanced")])


@register(_sql("SELECT node, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS motion_pct, round(avg(CASE WHEN value BETWEEN 20 AND 50 THEN 1.0 ELSE 0.0 END) * 100, 6) + 0.0 AS breath_pct FROM fr GROUP BY node"))
def ml16_label_scores(spark, sf_dir):
    pct = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100)
    return frames(spark, sf_dir).groupBy("node").agg(pct(F.col("value") > 50).alias("motion_pct"), pct(F.col("value").between(20, 50)).alias("breath_pct"))


@register(_sql("SELECT node, n, CASE WHEN n < 100 THEN 'NOT RUNNABLE' WHEN med < 40 AND hi > 90 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT node, count(*) AS n, median(value) AS med, max(value) AS hi FROM fr GROUP BY node)"))
def ml15_verdicts(spark, sf_dir):
    """Three-valued: too little data is neither a pass nor a failure."""
    g = frames(spark, sf_dir).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("med"), F.max("value").alias("hi"))
    return g.select("node", "n", F.when(F.col("n") < 100, "NOT RUNNABLE").when((F.col("med") < 40) & (F.col("hi") > 90), "PASS").otherwise("FAIL").alias("verdict"))


_SWAP = "m AS (SELECT node, source // 2 % 3 AS s, source % 2 AS d, avg(value) AS x, avg(us % 86400000000) / 864000000.0 AS y FROM fr GROUP BY ALL), p AS (SELECT node, " + ", ".join(f"max({c}) FILTER (WHERE s = {s} AND d = {d}) AS {c}{s}{d}" for s in range(3) for d in range(2) for c in "xy") + " FROM m GROUP BY node), f AS (SELECT node, " + ", ".join(f"sqrt((x{a} - x{b}) ** 2 + (y{a} - y{b}) ** 2) AS {n}" for n, a, b in (("r0", "00", "10"), ("r1", "01", "11"), ("v0", "00", "20"), ("v1", "01", "21"), ("q0", "00", "21"), ("q1", "01", "20"))) + ", x20 - x00 AS a0, y20 - y00 AS b0, x21 - x01 AS a1, y21 - y01 AS b1 FROM p), g AS (SELECT node, (r0 + r1) / 2 AS drift, greatest(v0, v1) AS d_dev, greatest(q0, q1) AS d_pos, (a0 * a1 + b0 * b1) / (v0 * v1) AS cosine FROM f)"


@register(_sql("SELECT node, round(drift, 6) + 0.0 AS drift, round(d_dev, 6) + 0.0 AS d_dev, round(d_pos, 6) + 0.0 AS d_pos, round(cosine, 6) + 0.0 AS cosine, CASE WHEN cosine < -0.3 THEN 'AGAINST' WHEN cosine > 0.3 THEN 'TOGETHER' ELSE 'NEITHER' END AS sign, CASE WHEN d_dev <= drift AND d_pos > 3 * drift THEN 'DEVICE' WHEN d_pos <= drift AND d_dev > 3 * drift THEN 'POSITION' WHEN d_dev <= drift AND d_pos <= drift THEN 'UNDERPOWERED' ELSE 'MIXED' END AS verdict FROM g", _SWAP))
def ml17_swap(spark, sf_dir):
    """Two devices that changed places between sessions: does the signature follow the device or the place, beyond its drift, and did both move against each other?"""
    f = frames(spark, sf_dir)
    m = f.groupBy("node", F.floor(F.col("source") / 2 % 3).alias("s"), (F.col("source") % 2).alias("d")).agg(F.avg("value").alias("x"), (F.avg(F.col("us") % DAY) / 864000000.0).alias("y"))
    return models.swap_test(m, ["node"], "s", "d", "x", "y").select("node", *[r6(c).alias(c) for c in ("drift", "d_dev", "d_pos", "cosine")], "sign", "verdict")


@register(_sql("SELECT source, arg_max(node, share * 1000 - k) AS dominant, round(max(share), 6) + 0.0 AS share, round(sum(abs(share - 0.2)), 6) + 0.0 AS spread FROM (SELECT source, node, s / sum(s) OVER (PARTITION BY source) AS share, row_number() OVER (PARTITION BY source ORDER BY s DESC, node) / 1e6 AS k FROM (SELECT source, node, sum(value) AS s FROM fr GROUP BY source, node)) GROUP BY source"))
def ml12_event_profiles(spark, sf_dir):
    """Each source's profile over links: the dominant link and the distance from an even profile."""
    s = frames(spark, sf_dir).groupBy("source", "node").agg(F.sum("value").alias("s"))
    s = s.withColumn("share", F.col("s") / F.sum("s").over(Window.partitionBy("source")))
    return s.groupBy("source").agg(F.max_by("node", "s").alias("dominant"), r6(F.max("share")).alias("share"), r6(F.sum(F.abs(F.col("share") - 0.2))).alias("spread"))


@register(_sql("SELECT bin, string_agg(CAST(m AS VARCHAR), ',' ORDER BY node) AS fingerprint FROM (SELECT us // 86400000000 AS bin, node, CAST(round(median(value)) AS BIGINT) AS m FROM fr GROUP BY 1, 2) GROUP BY bin HAVING count(*) >= 4"))
def ml13_fingerprints(spark, sf_dir):
    """A day's medians of all links, in link order, if enough links are there."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"m": F.round(F.median("value")).cast("bigint")})
    g = d.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("node", "m"))).alias("f")).where(F.size("f") >= 4)  # as many entries as links
    return g.select("bin", F.array_join(F.transform("f", lambda x: x["m"].cast("string")), ",").alias("fingerprint"))


# --- statistics


@register(_sql("SELECT node, n, round(rho, 6) + 0.0 AS rho FROM (SELECT node, count(*) AS n, corr(a, b) AS rho FROM (SELECT node, rank() OVER (PARTITION BY node ORDER BY x) + (count(*) OVER (PARTITION BY node, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY node ORDER BY y) + (count(*) OVER (PARTITION BY node, y) - 1) / 2.0 AS b FROM (SELECT node, round(value) AS x, us // 3600000000 AS y FROM fr)) GROUP BY node)"))
def stat1_spearman(spark, sf_dir):
    f = frames(spark, sf_dir).select("node", F.round("value").alias("x"), F.floor(F.col("us") / 3600000000).alias("y"))
    return stats.spearman(f, ["node"], "x", "y").select("node", "n", r6("rho").alias("rho"))


def _pair(a: str, b: str) -> str:
    return min((a, b), key="xyzuw".index) + max((a, b), key="xyzuw".index)


_RK = "rank() OVER (PARTITION BY node ORDER BY {0}) + (count(*) OVER (PARTITION BY node, {0}) - 1) / 2.0 AS {1}"


@register(_sql(f"SELECT node, count(*) AS n, round((corr(a, b) - corr(a, c) * corr(b, c)) / sqrt((1 - corr(a, c) * corr(a, c)) * (1 - corr(b, c) * corr(b, c))), 6) + 0.0 AS rho FROM (SELECT node, {_RK.format('x', 'a')}, {_RK.format('y', 'b')}, {_RK.format('z', 'c')} FROM (SELECT node, round(value) AS x, us // 3600000000 AS y, source AS z FROM fr)) GROUP BY node"))
def stat1_partial(spark, sf_dir):
    f = frames(spark, sf_dir).select("node", F.round("value").alias("x"), F.floor(F.col("us") / 3600000000).alias("y"), F.col("source").alias("z"))
    return stats.partial_spearman(f, ["node"], "x", "y", "z").select("node", "n", r6("rho").alias("rho"))


#: Ranks of two columns and three controls; correlations of all pairs, from which one control after the other is eliminated.
_MANY = ("q AS (SELECT node, value AS x, us // 3600000000 AS y, source AS z, us % 86400000000 // 3600000000 AS u, round(value * source) % 50 AS w FROM fr)", f"k AS (SELECT node, {', '.join(_RK.format(c, 'r_' + c) for c in 'xyzuw')} FROM q)", "c0 AS (SELECT node, count(*) AS n, " + ", ".join(f"corr(r_{a}, r_{b}) AS {a}{b}" for a, b in itertools.combinations("xyzuw", 2)) + " FROM k GROUP BY node)",
    *[f"c{i + 1} AS (SELECT node, n, " + ("xy AS zero, " if i == 0 else "zero, ") + ", ".join(f"({a}{b} - {_pair(a, z)} * {_pair(b, z)}) / sqrt((1 - {_pair(a, z)} * {_pair(a, z)}) * (1 - {_pair(b, z)} * {_pair(b, z)})) AS {a}{b}" for a, b in itertools.combinations([c for c in "xyzuw" if c not in "zuw"[: i + 1]], 2)) + f" FROM c{i})" for i, z in enumerate("zuw")])


@register(_sql("SELECT node, n, round(zero, 6) + 0.0 AS zero, round(xy, 6) + 0.0 AS rho FROM c3", ", ".join(_MANY)))
def stat1_partial_many(spark, sf_dir):
    """Rank correlation of value and hour with three controls held fixed."""
    us = F.col("us")
    f = frames(spark, sf_dir).select("node", F.col("value").alias("x"), F.floor(us / 3600000000).alias("y"), F.col("source").alias("z"), F.floor(us % 86400000000 / 3600000000).alias("u"), (F.round(F.col("value") * F.col("source")) % 50).alias("w"))
    return stats.partial_spearman_many(f, ["node"], "x", "y", ["z", "u", "w"]).select("node", "n", r6("zero").alias("zero"), r6("rho").alias("rho"))


@register()
def stat1_partial_p(spark, sf_dir):
    """Daily medians against daily counts, with the day and the median source held fixed, and its p by permutation."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value"), "n": F.count(F.lit(1)), "m": F.median("source")})
    return stats.partial_permutation_p(d.withColumnRenamed("n", "size"), ["node"], "v", "size", ["bin", "m"]).select("node", "n", r6("rho").alias("rho"), "p")


_P = "t AS (SELECT source % 7 AS fam, source, 1.0 / (1 + count(*)) * avg(value) / 100 AS p FROM fr GROUP BY source)"


def _pvalues(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("source").agg((F.lit(1.0) / (1 + F.count(F.lit(1))) * F.avg("value") / 100).alias("p"))
    return g.withColumn("fam", F.col("source") % 7)


@register(_sql("SELECT fam, source, round(max(s) OVER (PARTITION BY fam ORDER BY p, source ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS holm FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY fam) - row_number() OVER (PARTITION BY fam ORDER BY p, source) + 1) * p) AS s FROM t)", _P))
def stat6_holm(spark, sf_dir):
    return stats.holm(_pvalues(spark, sf_dir), ["fam"], "p", "source").select("fam", "source", r6("holm").alias("holm"))


@register(_sql("SELECT fam, source, round(min(s) OVER (PARTITION BY fam ORDER BY p, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS bh FROM (SELECT *, least(1.0, count(*) OVER (PARTITION BY fam) * p / row_number() OVER (PARTITION BY fam ORDER BY p, source)) AS s FROM t)", _P))
def stat6_bh(spark, sf_dir):
    return stats.benjamini_hochberg(_pvalues(spark, sf_dir), ["fam"], "p", "source").select("fam", "source", r6("bh").alias("bh"))


@register(_sql("SELECT fam, source, round(1 - pow(1 - p, n), 6) + 0.0 AS sidak FROM (SELECT *, count(*) OVER (PARTITION BY fam) AS n FROM t)", _P))
def stat6_sidak(spark, sf_dir):
    t = _pvalues(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("fam")))
    return t.select("fam", "source", r6(stats.sidak(F.col("p"), F.col("n"))).alias("sidak"))


_DAYS = "d AS (SELECT node, us // 86400000000 AS bin, median(value) AS v FROM fr GROUP BY 1, 2)"


def _days(spark, sf_dir):
    return win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")}).select("node", "bin", "v")


@register(_sql("SELECT a.node, round(median((b.v - a.v) / (b.bin - a.bin)), 6) + 0.0 AS slope FROM d a JOIN d b ON a.node = b.node AND a.bin < b.bin GROUP BY a.node", _DAYS))
def stat7_theil_sen(spark, sf_dir):
    return stats.theil_sen(_days(spark, sf_dir), ["node"], "bin", "v").select("node", r6("slope").alias("slope"))


@register(_sql("SELECT node, round(regr_slope(v, bin), 6) + 0.0 AS slope FROM d GROUP BY node", _DAYS))
def stat7_ols_slope(spark, sf_dir):
    return _days(spark, sf_dir).groupBy("node").agg(r6(F.regr_slope("v", "bin")).alias("slope"))


@register(_sql("SELECT a.node, CAST(a.bin - b.bin AS INTEGER) AS lag, count(*) AS pairs, round(corr(a.v, b.v), 6) + 0.0 AS r FROM d a JOIN d b ON a.node = b.node AND a.bin - b.bin IN (1, 2, 7) GROUP BY 1, 2", _DAYS))
def stat11_acf(spark, sf_dir):
    return stats.autocorrelation(_days(spark, sf_dir), ["node"], "bin", "v", [1, 2, 7]).select("node", "lag", "pairs", r6("r").alias("r"))


@register(_sql("SELECT a.node, CAST(a.bin - b.bin AS INTEGER) AS lag, count(*) AS pairs, round(median(abs(a.v - b.v)), 6) + 0.0 AS typical, round(1.4826 * median(abs(a.v - b.v)) / sqrt(2.0), 6) + 0.0 AS drift_sd FROM d a JOIN d b ON a.node = b.node AND a.bin - b.bin IN (1, 3, 10) GROUP BY 1, 2", _DAYS))
def stat12_variogram(spark, sf_dir):
    """Median absolute difference of days at each lag, and the standard deviation of the drift that it stands for."""
    return stats.variogram(_days(spark, sf_dir), ["node"], "bin", "v", [1, 3, 10]).select("node", "lag", "pairs", r6("typical").alias("typical"), r6("drift_sd").alias("drift_sd"))


_HALVES = "r AS (SELECT node, us // 86400000000 AS day, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY node, us // 86400000000) AS n FROM fr WHERE value IS NOT NULL WINDOW w AS (PARTITION BY node, us // 86400000000 ORDER BY us, row_no)), s AS (SELECT node, day, median(value) FILTER (WHERE i <= n // 2) - median(value) FILTER (WHERE i > n // 2) AS h, median(value) AS m FROM r WHERE n >= 10 GROUP BY node, day), g AS (SELECT *, lag(day) OVER (PARTITION BY node ORDER BY day) AS old, lag(m) OVER (PARTITION BY node ORDER BY day) AS was FROM s), t AS (SELECT node, count(*) AS sessions, median(abs(h)) AS within, median(CASE WHEN day = old + 1 THEN abs(m - was) END) AS between_, var_samp(m) - avg(h * h) / 4 AS v FROM g GROUP BY node HAVING count(*) >= 3)"


@register(_sql("SELECT node, sessions, round(within, 6) + 0.0 AS within, round(between_, 6) + 0.0 AS between, round(between_ / within, 6) + 0.0 AS ratio, round(sqrt(greatest(v, 0)), 6) + 0.0 AS drift_sd FROM t", _HALVES))
def stat12_split_half(spark, sf_dir):
    """Early against late half of each day, beside day against day."""
    f = frames(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    return stats.split_halves(f, ["node"], "day", ["us", "row_no"], "value", least=10).select("node", "sessions", *[r6(c).alias(c) for c in ("within", "between", "ratio", "drift_sd")])


@register(_sql("SELECT node, round(max(s), 6) + 0.0 AS max_step, round(quantile_cont(s, 0.95), 6) + 0.0 AS p95_step, round(max(v) - min(v), 6) + 0.0 AS span FROM (SELECT node, v, abs(v - lag(v) OVER (PARTITION BY node ORDER BY bin)) AS s FROM d) GROUP BY node HAVING count(s) > 1", _DAYS))
def stat13_wander(spark, sf_dir):
    """How far a node's days wander by themselves: the largest step between neighbours, its 95th percentile, and the range."""
    s = F.abs(F.col("v") - F.lag("v").over(win.ordered("node", "bin")))
    g = _days(spark, sf_dir).select("node", "v", s.alias("s")).groupBy("node").agg(F.count("s").alias("n"), r6(F.max("s")).alias("max_step"), r6(F.percentile("s", F.lit(0.95))).alias("p95_step"), r6(F.max("v") - F.min("v")).alias("span"))
    return g.where("n > 1").drop("n")


_ORDERS = "r AS (SELECT node, value, row_number() OVER (PARTITION BY node ORDER BY us, row_no) - 1 AS real, row_number() OVER (PARTITION BY node ORDER BY md5('3:' || row_no), row_no) - 1 AS shuffled FROM fr), x AS (SELECT node, value, w, real // w AS a, shuffled // w AS b FROM r, (SELECT unnest([8, 32, 128]) AS w)), y AS (SELECT node, w, stddev_samp(m) AS real, count(*) AS windows FROM (SELECT node, w, a, median(value) AS m FROM x GROUP BY node, w, a HAVING count(*) = w) GROUP BY node, w), z AS (SELECT node, w, stddev_samp(m) AS shuffled FROM (SELECT node, w, b, median(value) AS m FROM x GROUP BY node, w, b HAVING count(*) = w) GROUP BY node, w)"


@register(_sql("SELECT node, w AS width, windows, round(real, 6) + 0.0 AS real, round(shuffled, 6) + 0.0 AS shuffled, round(first_value(real) OVER o / sqrt(w / first_value(w) OVER o), 6) + 0.0 AS expected FROM y JOIN z USING (node, w) WHERE windows >= 2 WINDOW o AS (PARTITION BY node ORDER BY w)", _ORDERS))
def stat14_order_shuffle(spark, sf_dir):
    """Spread of windows in their own order and in a shuffled one at three lengths, beside what independent frames would have."""
    t = stats.order_control(frames(spark, sf_dir), ["node"], ["us", "row_no"], "row_no", "value", (8, 32, 128), seed=3)
    return t.select("node", "width", "windows", *[r6(c).alias(c) for c in ("real", "shuffled", "expected")])


_GRID = _DAYS + ", e AS (SELECT node, min(bin) AS lo, max(bin) AS hi FROM d GROUP BY node), k AS (SELECT node, unnest(range(lo, hi + 1)) AS bin FROM e), g AS (SELECT k.node, k.bin, d.v, count(*) OVER (PARTITION BY k.node) AS total FROM k LEFT JOIN d ON k.node = d.node AND k.bin = d.bin)"
#: For each tau and row: means and counts of the tau rows from it on and of the tau rows after them.
_BLOCKS = "SELECT node, {0} AS tau, total, avg(v) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN CURRENT ROW AND {1} FOLLOWING) AS a, avg(v) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN {0} FOLLOWING AND {2} FOLLOWING) AS b, count(v) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN CURRENT ROW AND {1} FOLLOWING) AS na, count(v) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN {0} FOLLOWING AND {2} FOLLOWING) AS nb FROM g"
_ALLAN = _GRID + ", q AS (" + " UNION ALL ".join(_BLOCKS.format(m, m - 1, 2 * m - 1) for m in (1, 2, 4, 8)) + "), y AS (SELECT node, tau, count(CASE WHEN na >= ceil(0.9 * tau) AND nb >= ceil(0.9 * tau) THEN b - a END) AS n, any_value(total) AS total, avg(CASE WHEN na >= ceil(0.9 * tau) AND nb >= ceil(0.9 * tau) THEN (b - a) * (b - a) END) AS s FROM q GROUP BY node, tau)"


def _allan(spark, sf_dir):
    d = _days(spark, sf_dir)
    return stats.allan(win.dense(d, "node", "bin").join(d, ["node", "bin"], "left"), ["node"], "bin", "v", [1, 2, 4, 8])


@register(_sql("SELECT node, tau, n, CASE WHEN n >= 3 THEN total // (2 * tau) ELSE 0 END AS independent, CASE WHEN n >= 3 THEN round(sqrt(s / 2), 6) + 0.0 END AS adev FROM y", _ALLAN))
def dsp13_allan(spark, sf_dir):
    """Overlapping Allan deviation of each node's days; blocks need nine tenths of their days."""
    return _allan(spark, sf_dir).select("node", "tau", "n", "independent", r6("adev").alias("adev"))


@register(_sql("SELECT node, count(*) AS points, CASE WHEN count(*) >= 3 THEN round(regr_slope(log10(sqrt(s / 2)), log10(tau)), 6) + 0.0 END AS slope FROM y WHERE n >= 3 AND s > 0 GROUP BY node", _ALLAN))
def dsp13_slope(spark, sf_dir):
    """How fast averaging helps: slope of the Allan deviation over tau, both as logarithms."""
    return stats.loglog_slope(_allan(spark, sf_dir), ["node"], "tau", "adev").select("node", "points", r6("slope").alias("slope"))


@register(_sql("SELECT count(DISTINCT node) AS variables, round(1 + (count(DISTINCT node) - 1) * (1 - 2 * (SELECT sum(r * r) FROM (SELECT corr(a.v, b.v) AS r FROM d a JOIN d b ON a.bin = b.bin AND a.node < b.node GROUP BY a.node, b.node)) / ((count(DISTINCT node) - 1) * count(DISTINCT node))), 6) + 0.0 AS effective FROM d", _DAYS))
def stat6_effective_tests(spark, sf_dir):
    """How many independent tests the nodes' days amount to."""
    return stats.effective_number(_days(spark, sf_dir), "node", "bin", "v").select("variables", r6("effective").alias("effective"))


_ARRIVALS = "u AS (SELECT source, (us - lo) / (hi - lo) AS x FROM (SELECT source, us * 1.0::DOUBLE AS us, (SELECT min(us) FROM fr) AS lo, (SELECT max(us) FROM fr) AS hi FROM fr))"


def _arrivals(spark, sf_dir):
    """When frames of each source come, as a share of the whole time."""
    f = frames(spark, sf_dir)
    ends = f.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))  # one row
    return f.crossJoin(F.broadcast(ends)).select("source", ((F.col("us") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))


@register(_sql("SELECT source, n, round(d, 6) + 0.0 AS d, round(least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2 * j * j * pow((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d, 2)))))), 6) + 0.0 AS p FROM (SELECT source, n, max(greatest(i / n - x, x - (i - 1) / n)) AS d FROM (SELECT source, x, row_number() OVER (PARTITION BY source ORDER BY x) * 1.0::DOUBLE AS i, count(*) OVER (PARTITION BY source) AS n FROM u) GROUP BY source, n)", _ARRIVALS))
def stat9_ks(spark, sf_dir):
    """Whether frames of each source come evenly over the whole time."""
    return stats.ks_test(_arrivals(spark, sf_dir), ["source"], "x").select("source", "n", r6("d").alias("d"), r6("p").alias("p"))


@register(_sql("SELECT source, n, round(w, 6) + 0.0 AS span, CASE WHEN n > 1 THEN round(n * pow(w, n - 1) - (n - 1) * pow(w, n), 6) + 0.0 END AS p FROM (SELECT source, count(*) AS n, max(x) - min(x) AS w FROM u GROUP BY source)", _ARRIVALS))
def stat9_range(spark, sf_dir):
    """Whether frames of each source come closer together than even ones would."""
    return stats.range_test(_arrivals(spark, sf_dir), ["source"], "x").select("source", "n", r6("span").alias("span"), r6("p").alias("p"))


@register(_sql("SELECT band, count(*) AS n, round(corr(value, us / 1e12), 6) + 0.0 AS r FROM (SELECT CAST(floor(value / 25) AS BIGINT) AS band, value, us FROM fr) GROUP BY band HAVING count(*) >= 20"))
def agg28_stratified_corr(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("band", F.floor(F.col("value") / 25).cast("bigint"))
    g = f.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.corr("value", F.col("us") / 1e12).alias("r"))
    return g.where("n >= 20").select("band", "n", r6("r").alias("r"))

