"""Scans, screens, aggregates and window functions over `events` in the role of frames, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import steps
from ..operators import windows as win
from ..operators.quantiles import exact_quantiles
from ..session import frames, table
from .catalog import register

#: `events` as frames, in SQL.
FR = "fr AS (SELECT user_id AS source, event_type AS node, epoch_us(ts) AS us, event_id AS row_no, value FROM events)"
ORDER = ["us", "row_no"]
HOUR, DAY = 3_600_000_000, 86_400_000_000


def _sql(body: str, ctes: str = "") -> str:
    return f"WITH {FR}{', ' + ctes if ctes else ''} {body}"


# --- filters and projections


@register(_sql("SELECT row_no, source, us - min(us) OVER (PARTITION BY source) AS rel_us FROM fr QUALIFY us - min(us) OVER (PARTITION BY source) >= 86400000000 AND us - min(us) OVER (PARTITION BY source) < 864000000000"))
def flt1_relative_time(spark, sf_dir):
    f = frames(spark, sf_dir)
    rel = f.withColumn("rel_us", F.col("us") - F.min("us").over(Window.partitionBy("source")))
    return rel.where((F.col("rel_us") >= DAY) & (F.col("rel_us") < 10 * DAY)).select("row_no", "source", "rel_us")


@register(_sql("SELECT row_no, value FROM fr, m WHERE node = m.mode_node AND value >= 1.0 AND value <= 60.0", "m AS (SELECT min(node) AS mode_node FROM (SELECT node, count(*) AS n FROM fr GROUP BY node QUALIFY n = max(n) OVER ()))"))
def flt2_field_plausibility(spark, sf_dir):
    f = frames(spark, sf_dir)
    top = f.groupBy("node").count().agg(F.max(F.struct("count", "node")).alias("t"))
    least = f.groupBy("node").count().crossJoin(F.broadcast(top)).where(F.col("count") == F.col("t.count")).agg(F.min("node").alias("mode_node"))
    return f.where("value >= 1.0 AND value <= 60.0").crossJoin(F.broadcast(least)).where("node = mode_node").select("row_no", "value")


@register(_sql("SELECT row_no, source, CASE WHEN len(near) >= 3 THEN abs(list_sort(list_transform(near, lambda v: ((v - c + 32768) % 65536 + 65536) % 65536 - 32768))[len(near) // 2 + 1]) <= 100 ELSE true END AS passes FROM w", "w AS (SELECT row_no, source, (row_no * 17) % 65536 AS c, list((row_no * 17) % 65536) OVER (PARTITION BY source ORDER BY us, row_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM fr)"))
def flt3_circular_median9(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("c", F.col("row_no") * 17 % 65536)
    return win.circular_screen(f, "c", "source", ORDER).select("row_no", "source", "passes")


@register(_sql("SELECT row_no, source, round(list_sort(list_concat(list_concat(list_transform(range(greatest(0, 5 - i)), lambda x: a), near), list_transform(range(greatest(0, i + 4 - n)), lambda x: z)))[5], 6) + 0.0 AS smooth FROM w", "w AS (SELECT row_no, source, row_number() OVER o AS i, count(*) OVER (PARTITION BY source) AS n, list(value) OVER (PARTITION BY source ORDER BY us, row_no ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near, first_value(value) OVER (PARTITION BY source ORDER BY us, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, last_value(value) OVER (PARTITION BY source ORDER BY us, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM fr WINDOW o AS (PARTITION BY source ORDER BY us, row_no))"))
def flt4_median_screen(spark, sf_dir):
    return win.median_screen(frames(spark, sf_dir), "value", "source", ORDER).select("row_no", "source", r6("smooth").alias("smooth"))


@register(_sql("SELECT source, count(*) AS frames, count(*) FILTER (WHERE value >= 0.6 AND value <= 80) AS accepted, count(*) FILTER (WHERE value < 0.6) AS low_value, count(*) FILTER (WHERE value > 80) AS high_value FROM fr GROUP BY source"))
def flt6_gate_funnel(spark, sf_dir):
    """Rows by the first gate that rejects them."""
    why = F.when(F.col("value") < 0.6, "low").when(F.col("value") > 80, "high")
    f = frames(spark, sf_dir).withColumn("why", why)
    return f.groupBy("source").agg(F.count(F.lit(1)).alias("frames"), F.count_if(F.col("why").isNull()).alias("accepted"), F.count_if(F.col("why") == "low").alias("low_value"), F.count_if(F.col("why") == "high").alias("high_value"))


@register(_sql("SELECT source, count(*) AS n FROM fr WHERE value >= 0.6 AND value <= 80 GROUP BY source HAVING count(*) >= 5"))
def flt5_flt7_gate_and_support(spark, sf_dir):
    f = frames(spark, sf_dir).where("value >= 0.6 AND value <= 80")
    return f.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@register("SELECT s_suppkey, ((s_suppkey * 37) % 256) & 2 = 2 AS local_admin, length(s_name) - length(replace(s_name, '0', '')) AS zeros FROM supplier")
def flt9_id_bits(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", ((F.col("s_suppkey") * 37 % 256).bitwiseAND(F.lit(2).cast("bigint")) == 2).alias("local_admin"), (F.length("s_name") - F.length(F.replace("s_name", F.lit("0")))).cast("bigint").alias("zeros"))


@register(_sql("SELECT source, CASE WHEN n < 20 THEN 'S' WHEN hi > 4 * med THEN 'X' WHEN nodes < 3 THEN 'R' ELSE 'P?' END AS class FROM c", "c AS (SELECT source, count(*) AS n, max(value) AS hi, median(value) AS med, count(DISTINCT node) AS nodes FROM fr GROUP BY source)"))
def flt10_artefact_class(spark, sf_dir):
    c = frames(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"), F.median("value").alias("med"), F.count_distinct("node").alias("nodes"))
    return c.select("source", F.when(F.col("n") < 20, "S").when(F.col("hi") > 4 * F.col("med"), "X").when(F.col("nodes") < 3, "R").otherwise("P?").alias("class"))


@register(_sql("SELECT source, count(*) AS frames, round(count(*) * 3600000000.0 / (max(us) - min(us)), 6) + 0.0 AS per_hour FROM fr GROUP BY source HAVING count(*) >= 20 AND avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END) > 0.5"))
def flt11_beacon_signature(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("frames"), F.max("us").alias("hi"), F.min("us").alias("lo"), F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0)).alias("typical"))
    return g.where("frames >= 20 AND typical > 0.5").select("source", "frames", r6(F.col("frames") * 3600000000.0 / (F.col("hi") - F.col("lo"))).alias("per_hour"))


@register(_sql("SELECT source, CASE WHEN abs(a - b) > 5 THEN NULL ELSE round(a, 6) + 0.0 END AS floor_kept FROM g", "g AS (SELECT source, median(value) FILTER (WHERE row_no % 2 = 0) AS a, median(value) FILTER (WHERE row_no % 2 = 1) AS b FROM fr GROUP BY source)"))
def flt12_operating_point_guard(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("source").agg(F.median(F.when(F.col("row_no") % 2 == 0, F.col("value"))).alias("a"), F.median(F.when(F.col("row_no") % 2 == 1, F.col("value"))).alias("b"))
    return g.select("source", F.when(F.abs(F.col("a") - F.col("b")) > 5, None).otherwise(r6("a")).alias("floor_kept"))


@register(_sql("SELECT source, w AS window, max(us) - min(us) AS span_us, round(median(value), 6) + 0.0 AS med FROM r GROUP BY source, w HAVING count(*) = 8 AND max(us) - min(us) <= 259200000000", "r AS (SELECT source, us, value, (row_number() OVER (PARTITION BY source ORDER BY us, row_no) - 1) // 8 AS w FROM fr)"))
def flt13_span_gate(spark, sf_dir):
    g = win.count_windows(frames(spark, sf_dir), "source", ORDER, 8, {"span_us": F.max("us") - F.min("us"), "med": F.median("value")})
    return g.where(F.col("span_us") <= 3 * DAY).select("source", "window", "span_us", r6("med").alias("med"))


@register(_sql("SELECT row_no, source FROM (SELECT row_no, source, us - min(us) OVER (PARTITION BY source, run) AS age FROM r) WHERE age >= 3600000000", "l AS (SELECT *, CASE WHEN lag(node) OVER (PARTITION BY source ORDER BY us, row_no) = node THEN 0 ELSE 1 END AS new FROM fr), r AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY us, row_no ROWS UNBOUNDED PRECEDING) AS run FROM l)"))
def flt14_interval_interior(spark, sf_dir):
    """Rows at least an hour after the beginning of their run of one label."""
    w = win.ordered("source", ORDER)
    f = frames(spark, sf_dir).withColumn("new", F.when(F.lag("node").over(w) == F.col("node"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return f.withColumn("age", F.col("us") - F.min("us").over(Window.partitionBy("source", "run"))).where(F.col("age") >= HOUR).select("row_no", "source")


@register(_sql("SELECT node, count(*) AS n FROM fr WHERE contains(node, 'c') AND node <> '' GROUP BY node"))
def flt15_label_predicate(spark, sf_dir):
    return frames(spark, sf_dir).where(F.col("node").contains("c") & (F.col("node") != "")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@register(_sql("SELECT row_no, round(coalesce(CASE WHEN row_no % 3 = 0 THEN NULL ELSE value END, value * 2), 6) + 0.0 AS feature FROM fr"))
def prj5_coalesced_feature(spark, sf_dir):
    return frames(spark, sf_dir).select("row_no", r6(F.coalesce(F.when(F.col("row_no") % 3 == 0, None).otherwise(F.col("value")), F.col("value") * 2)).alias("feature"))


@register(_sql("SELECT row_no, value AS x FROM fr WHERE value IS NOT NULL AND (CASE WHEN row_no % 3 = 0 THEN NULL ELSE value END) IS NOT NULL"))
def prj6_strict_feature(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("y", F.when(F.col("row_no") % 3 == 0, None).otherwise(F.col("value")))
    return f.na.drop(subset=["value", "y"]).select("row_no", F.col("value").alias("x"))


@register(_sql("SELECT row_no, round(-value / (2 * pi() * 312500) * 1e9, 6) + 0.0 AS delay_ns FROM fr"))
def prj7_equivalent_delay(spark, sf_dir):
    """A phase slope per subcarrier, 312.5 kHz apart, as a delay."""
    return frames(spark, sf_dir).select("row_no", r6(-F.col("value") / (2 * F.pi() * 312500) * 1e9).alias("delay_ns"))


@register("SELECT c_custkey, regexp_extract(c_name, '([A-Za-z]+)#?0*([0-9]+)', 1) AS receiver, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS stamp FROM customer")
def prj9_name_parse(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.regexp_extract("c_name", "([A-Za-z]+)#?0*([0-9]+)", 1).alias("receiver"), F.regexp_extract("c_name", "([0-9]+)$", 1).cast("bigint").alias("stamp"))


@register(_sql("SELECT source, (min(us) < 1705276800000000) <> (max(us) < 1705276800000000) AS straddles FROM fr GROUP BY source"))
def prj10_straddle(spark, sf_dir):
    cut = 1705276800000000
    return frames(spark, sf_dir).groupBy("source").agg(((F.min("us") < cut) != (F.max("us") < cut)).alias("straddles"))


# --- aggregates


@register(_sql("SELECT source, count(*) AS n, round(sum(value), 4) + 0.0 AS total, round(avg(value), 6) + 0.0 AS mean, min(value) AS lo, max(value) AS hi, round(stddev_pop(value), 6) + 0.0 AS sd FROM fr GROUP BY source"))
def agg1_census(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("value"), 4) + 0.0).alias("total"), r6(F.avg("value")).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), r6(F.stddev_pop("value")).alias("sd"))


@register(_sql("SELECT source, round(median(value), 6) + 0.0 AS med FROM fr GROUP BY source"))
def agg2_median(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("source").agg(r6(F.median("value")).alias("med"))


@register(_sql("SELECT node, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS iqr, round(quantile_cont(value, 0.05), 6) + 0.0 AS p5, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95 FROM fr GROUP BY node"))
def agg3_iqr(spark, sf_dir):
    """Spread of each node: groups that grow with the table, so ranks are found bucket by bucket."""
    g = exact_quantiles(frames(spark, sf_dir), ["node"], "value", [0.05, 0.25, 0.75, 0.95])
    return g.select("node", r6(F.col("q")[2] - F.col("q")[1]).alias("iqr"), r6(F.col("q")[0]).alias("p5"), r6(F.col("q")[3]).alias("p95"))


@register(_sql("SELECT source, CASE WHEN n < 10 THEN NULL WHEN mad > 0 THEN round(1.4826 * mad, 6) + 0.0 WHEN sd > 0 THEN round(sd, 6) + 0.0 ELSE 1e-9 END AS spread FROM (SELECT source, count(*) AS n, median(abs(value - m)) AS mad, stddev_pop(value) AS sd FROM fr JOIN (SELECT source, median(value) AS m FROM fr GROUP BY source) USING (source) GROUP BY source)"))
def agg4_mad(spark, sf_dir):
    """Robust spread: 1.4826 x MAD, else the standard deviation, else 1e-9; null below 10 rows."""
    f = frames(spark, sf_dir).withColumn("m", F.median("value").over(Window.partitionBy("source")))
    g = f.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.median(F.abs(F.col("value") - F.col("m"))).alias("mad"), F.stddev_pop("value").alias("sd"))
    return g.select("source", F.when(F.col("n") < 10, None).when(F.col("mad") > 0, r6(1.4826 * F.col("mad"))).when(F.col("sd") > 0, r6("sd")).otherwise(1e-9).alias("spread"))


@register(_sql("SELECT source, node AS k, count(*) AS n FROM fr GROUP BY source, node"))
def agg5_frequency_map(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("source", "node").agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("counts"))  # as many entries as nodes
    return m.select("source", F.explode("counts").alias("k", "n"))


@register(_sql("SELECT node, quantile_disc(CAST(round(value) AS BIGINT), 0.5) AS p50, quantile_disc(CAST(round(value) AS BIGINT), 0.9) AS p90 FROM fr GROUP BY node"))
def agg6_percentile_disc(spark, sf_dir):
    """Nearest-rank percentiles from an integer histogram: counts first, so a group is as large as its histogram."""
    h = frames(spark, sf_dir).groupBy("node", F.round("value").cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("node").orderBy("v")
    c = h.withColumn("run", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("node")))
    at = lambda p: F.min(F.when(F.col("run") >= F.ceil(p * F.col("all")), F.col("v")))
    return c.groupBy("node").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


@register(_sql("SELECT b, count(*) AS n FROM (SELECT CASE WHEN dt < 1e9 THEN 0 WHEN dt < 1e10 THEN 1 WHEN dt < 1e11 THEN 2 ELSE 3 END AS b FROM (SELECT us - lag(us) OVER (PARTITION BY source ORDER BY us, row_no) AS dt FROM fr) WHERE dt IS NOT NULL) GROUP BY b"))
def agg7_log_buckets(spark, sf_dir):
    dt = F.col("us") - F.lag("us").over(win.ordered("source", ORDER))
    f = frames(spark, sf_dir).select(dt.alias("dt")).where("dt IS NOT NULL")
    return f.groupBy(F.when(F.col("dt") < 1e9, 0).when(F.col("dt") < 1e10, 1).when(F.col("dt") < 1e11, 2).otherwise(3).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@register(_sql("SELECT node, count(DISTINCT source) AS sources FROM fr GROUP BY node"))
def agg8_distinct(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("node").agg(F.count_distinct("source").alias("sources"))


@register(_sql("SELECT source, min(node) AS top FROM (SELECT source, node, count(*) AS n, max(count(*)) OVER (PARTITION BY source) AS best FROM fr GROUP BY source, node) WHERE n = best GROUP BY source"))
def agg9_mode(spark, sf_dir):
    """Most frequent node; of equals the least."""
    return frames(spark, sf_dir).groupBy("source").agg(F.mode("node", deterministic=True).alias("top"))


@register(_sql('SELECT source, w AS "window", count(*) AS n, round(median(value), 6) + 0.0 AS med, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS iqr, CAST(floor(median(us)) AS BIGINT) AS us FROM r GROUP BY source, w HAVING count(*) = 8', "r AS (SELECT source, us, value, (row_number() OVER (PARTITION BY source ORDER BY us, row_no) - 1) // 8 AS w FROM fr)"))
def agg10_count_window(spark, sf_dir):
    """Flagship: median and spread of every 8 frames of a source, incomplete last windows dropped."""
    aggs = {"n": F.count(F.lit(1)), "med": F.median("value"), "q": F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))), "us": F.floor(F.median("us")).cast("bigint")}
    g = win.count_windows(frames(spark, sf_dir), "source", ORDER, 8, aggs)
    return g.select("source", "window", "n", r6("med").alias("med"), r6(F.col("q")[1] - F.col("q")[0]).alias("iqr"), "us")


@register(_sql("SELECT node, us // 86400000000 AS bin, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS med FROM fr GROUP BY 1, 2 HAVING count(*) >= 3"))
def agg11_time_bin(spark, sf_dir):
    g = win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"n": F.count(F.lit(1)), "mean": r6(F.avg("value")), "med": r6(F.median("value"))}, least=3)
    return g.select("node", "bin", "n", "mean", "med")


@register(_sql("SELECT node, s AS scale_s, us // (s * 1000000) AS bin, count(*) AS n, round(median(value), 6) + 0.0 AS med FROM fr, (VALUES (21600::BIGINT), (86400::BIGINT), (432000::BIGINT)) AS t(s) GROUP BY 1, 2, 3"))
def agg12_multiscale(spark, sf_dir):
    return win.multiscale(frames(spark, sf_dir), "node", "us", [21600, 86400, 432000], {"n": F.count(F.lit(1)), "med": r6(F.median("value"))})


@register("SELECT label, j, count(*) AS n, round(sum(v), 4) + 0.0 AS s, round(sum(v * v), 4) + 0.0 AS s2 FROM (SELECT label, unnest(range(1, 65)) AS j, unnest(embedding) AS v0, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, j")
def agg13_mergeable_sums(spark, sf_dir):
    """Elementwise sums of vectors by key: partial sums merge, so the shuffle carries one row for each key, place and task."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("j", "v"))
    return e.groupBy("label", (F.col("j") + 1).cast("bigint").alias("j")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("v"), 4) + 0.0).alias("s"), (F.round(F.sum(F.col("v") * F.col("v")), 4) + 0.0).alias("s2"))


@register(_sql("SELECT source, max(m) FILTER (WHERE node = 'click') AS click, max(m) FILTER (WHERE node = 'error') AS error, max(m) FILTER (WHERE node = 'purchase') AS purchase, max(m) FILTER (WHERE node = 'signup') AS signup, max(m) FILTER (WHERE node = 'view') AS view FROM (SELECT source, node, round(median(value), 6) + 0.0 AS m FROM fr GROUP BY source, node) GROUP BY source"))
def agg16_pivot(spark, sf_dir):
    """Medians of each source with a column for each node; the nodes are read from the table, as many as Spark allows for a pivot (spark.sql.pivotMaxValues)."""
    return frames(spark, sf_dir).groupBy("source").pivot("node").agg(r6(F.median("value")))


@register(_sql("SELECT node, round(atan2(avg(sin(a)), avg(cos(a))), 6) + 0.0 AS mean_angle, round(sqrt(avg(sin(a)) * avg(sin(a)) + avg(cos(a)) * avg(cos(a))), 6) + 0.0 AS resultant, round(sqrt(-2 * ln(sqrt(avg(sin(a)) * avg(sin(a)) + avg(cos(a)) * avg(cos(a))))), 6) + 0.0 AS circular_sd FROM (SELECT node, 2 * pi() * (us % 86400000000) / 86400000000.0 AS a FROM fr) GROUP BY node"))
def agg18_circular(spark, sf_dir):
    """Mean direction of the hour of day."""
    a = 2 * F.pi() * (F.col("us") % DAY) / 86400000000.0
    g = frames(spark, sf_dir).groupBy("node").agg(F.avg(F.sin(a)).alias("s"), F.avg(F.cos(a)).alias("c"))
    r = F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c"))
    return g.select("node", r6(F.atan2("s", "c")).alias("mean_angle"), r6(r).alias("resultant"), r6(F.sqrt(-2 * F.ln(r))).alias("circular_sd"))


@register(_sql("SELECT source, min(us) AS first_us, max(us) AS last_us, arg_min(node, CAST(us AS HUGEINT) * 1000000 + row_no) AS first_node, arg_max(node, CAST(us AS HUGEINT) * 1000000 + row_no) AS last_node FROM fr GROUP BY source"))
def agg19_first_last(spark, sf_dir):
    at = F.struct("us", "row_no")
    return frames(spark, sf_dir).groupBy("source").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min_by("node", at).alias("first_node"), F.max_by("node", at).alias("last_node"))


@register(_sql("SELECT node, round(var_samp(m), 6) + 0.0 AS between_var, round(avg(v), 6) + 0.0 AS within_var, round(var_samp(m) / avg(v), 6) + 0.0 AS ratio FROM (SELECT node, source, avg(value) AS m, var_samp(value) AS v FROM fr GROUP BY node, source HAVING count(*) > 1) GROUP BY node"))
def agg20_variance_ratio(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("node", "source").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.groupBy("node").agg(r6(F.var_samp("m")).alias("between_var"), r6(F.avg("v")).alias("within_var"), r6(F.var_samp("m") / F.avg("v")).alias("ratio"))


@register(_sql("SELECT source, coalesce(sum(((d % 65536) + 65536) % 65536), 0)::BIGINT AS total FROM (SELECT source, (row_no * 17) % 65536 - lag((row_no * 17) % 65536) OVER (PARTITION BY source ORDER BY us, row_no) AS d FROM fr) GROUP BY source"))
def agg21_wrap_counter(spark, sf_dir):
    return win.wrapped_total(frames(spark, sf_dir).withColumn("c", F.col("row_no") * 17 % 65536), "c", "source", ORDER)


@register(_sql("SELECT node, us // 86400000000 AS day, row_no FROM fr QUALIFY row_number() OVER (PARTITION BY node, us // 86400000000 ORDER BY md5('7:' || row_no), row_no) <= 3"))
def agg22_reservoir(spark, sf_dir):
    """A uniform sample of 3 frames of each node and day: those with the least keyed hash."""
    f = frames(spark, sf_dir).withColumn("day", F.floor(F.col("us") / DAY))
    w = Window.partitionBy("node", "day").orderBy(F.md5(F.concat(F.lit("7:"), F.col("row_no").cast("string")).cast("binary")), "row_no")
    return f.withColumn("k", F.row_number().over(w)).where("k <= 3").select("node", "day", "row_no")


@register(_sql("SELECT node, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS duty, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) / (SELECT avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) FROM fr), 6) + 0.0 AS lift FROM fr GROUP BY node"))
def agg23_lift(spark, sf_dir):
    f = frames(spark, sf_dir)
    active = F.when(F.col("value") > 50, 1.0).otherwise(0.0)
    base = f.agg(F.avg(active).alias("base"))
    return f.groupBy("node").agg(F.avg(active).alias("duty")).crossJoin(F.broadcast(base)).select("node", r6("duty").alias("duty"), r6(F.col("duty") / F.col("base")).alias("lift"))


@register(_sql("SELECT source, b, count(*) AS n, round(median(value), 6) + 0.0 AS med FROM (SELECT source, value, ntile(5) OVER (PARTITION BY source ORDER BY us, row_no) AS b FROM fr) GROUP BY source, b"))
def agg24_ntile(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("b", F.ntile(5).over(win.ordered("source", ORDER)))
    return f.groupBy("source", "b").agg(F.count(F.lit(1)).alias("n"), r6(F.median("value")).alias("med"))


@register(_sql("SELECT node AS label, min(us) AS t FROM fr WHERE node <> '' GROUP BY node"))
def agg25_first_of_label(spark, sf_dir):
    return frames(spark, sf_dir).where("node <> ''").groupBy(F.col("node").alias("label")).agg(F.min("us").alias("t"))


@register(_sql("SELECT node, count(DISTINCT level) AS levels, round(avg(CASE WHEN abs(value - level * 5.0) <= 0.5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS on_lattice FROM (SELECT node, value, CAST(rint5 AS BIGINT) AS level FROM (SELECT node, value, floor(value / 5.0 + 0.5) AS rint5 FROM fr)) GROUP BY node"))
def agg26_lattice(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 5.0 + 0.5).cast("bigint"))
    return f.groupBy("node").agg(F.count_distinct("level").alias("levels"), r6(F.avg(F.when(F.abs(F.col("value") - F.col("level") * 5.0) <= 0.5, 1.0).otherwise(0.0))).alias("on_lattice"))


@register(_sql("SELECT source, round(median(value), 6) + 0.0 AS med, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) + 0.0 AS iqr, round(quantile_cont(value, 0.05), 6) + 0.0 AS p5, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, round(max(value) - min(value), 6) + 0.0 AS span FROM fr GROUP BY source"))
def agg27_scale_summary(spark, sf_dir):
    g = frames(spark, sf_dir).groupBy("source").agg(F.percentile("value", F.array(*[F.lit(p) for p in (0.5, 0.25, 0.75, 0.05, 0.95)])).alias("p"), (F.max("value") - F.min("value")).alias("span"))
    return g.select("source", r6(F.col("p")[0]).alias("med"), r6(F.col("p")[2] - F.col("p")[1]).alias("iqr"), r6(F.col("p")[3]).alias("p5"), r6(F.col("p")[4]).alias("p95"), r6("span").alias("span"))


@register(_sql("SELECT g.lo, g.hi, f.node, count(*) AS n, round(median(value), 6) + 0.0 AS med FROM fr f, (VALUES (0::DOUBLE, 20::DOUBLE), (0::DOUBLE, 40::DOUBLE), (10::DOUBLE, 60::DOUBLE)) AS g(lo, hi) WHERE value >= g.lo AND value < g.hi GROUP BY g.lo, g.hi, f.node"))
def agg29_gate_sweep(spark, sf_dir):
    """One aggregate under several gates in one pass: each row goes to the gates that it passes."""
    gates = F.array(*[F.struct(F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi")) for a, b in ((0, 20), (0, 40), (10, 60))])
    f = frames(spark, sf_dir).withColumn("g", F.explode(F.filter(gates, lambda g: (F.col("value") >= g["lo"]) & (F.col("value") < g["hi"]))))
    return f.groupBy("g.lo", "g.hi", "node").agg(F.count(F.lit(1)).alias("n"), r6(F.median("value")).alias("med"))


@register(_sql("SELECT source, round(sqrt(sum((value - bm) * (value - bm)) / (count(*) - count(DISTINCT b))), 6) + 0.0 AS resid_sd FROM (SELECT source, b, value, avg(value) OVER (PARTITION BY source, b) AS bm FROM (SELECT source, value, us // 432000000000 AS b FROM fr)) GROUP BY source HAVING count(*) > count(DISTINCT b)"))
def agg30_block_residual(spark, sf_dir):
    """Spread that is left when each block of five days loses its mean, pooled over blocks."""
    f = frames(spark, sf_dir).withColumn("b", F.floor(F.col("us") / (5 * DAY)))
    f = f.withColumn("d", F.col("value") - F.avg("value").over(Window.partitionBy("source", "b")))
    g = f.groupBy("source").agg(F.sum(F.col("d") * F.col("d")).alias("ss"), F.count(F.lit(1)).alias("n"), F.count_distinct("b").alias("k")).where("n > k")
    return g.select("source", r6(F.sqrt(F.col("ss") / (F.col("n") - F.col("k")))).alias("resid_sd"))


@register(_sql("SELECT node, CAST(floor(value / 10.0) AS BIGINT) AS bucket, count(*) AS n FROM fr GROUP BY 1, 2"))
def agg31_histogram(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("node", F.floor(F.col("value") / 10.0).cast("bigint").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# --- window and sequence functions


@register(_sql("SELECT row_no, source, CAST(c + 4294967296 * sum(CASE WHEN c - p < -2147483648 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY us, row_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS clock FROM (SELECT *, lag(c) OVER (PARTITION BY source ORDER BY us, row_no) AS p FROM (SELECT *, us % 4294967296 AS c FROM fr))"))
def win1_unwrap(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("c", F.col("us") % (1 << 32))
    return win.unwrap_clock(f, "c", "source", ORDER).select("row_no", "source", F.col("clock").cast("bigint").alias("clock"))


@register(_sql("SELECT row_no, source, CASE WHEN count(value) OVER w >= 4 THEN round(stddev_pop(value) OVER w, 6) + 0.0 END AS sd FROM fr WINDOW w AS (PARTITION BY source ORDER BY us, row_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"))
def win3_rolling_std(spark, sf_dir):
    return frames(spark, sf_dir).select("row_no", "source", r6(win.trailing(F.col("value"), "source", ORDER, 8)).alias("sd"))


@register(_sql("SELECT row_no, source, round(avg(value) OVER (PARTITION BY source ORDER BY us, row_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) + 0.0 AS mean FROM fr"))
def win4_rolling_mean(spark, sf_dir):
    return frames(spark, sf_dir).select("row_no", "source", r6(win.trailing(F.col("value"), "source", ORDER, 8, F.avg, 1)).alias("mean"))


@register("WITH x AS (SELECT vec_id, label, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT vec_id, label, j, CASE WHEN count(v) OVER w >= 3 THEN stddev_pop(v) OVER w END AS sd FROM x WINDOW w AS (PARTITION BY label, j ORDER BY vec_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT vec_id, label, round(median(sd), 6) + 0.0 AS motion FROM s GROUP BY vec_id, label HAVING count(sd) > 0")
def win5_motion_metric(spark, sf_dir):
    """Median over a vector's places of the trailing spread of each place."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("j", "v"))
    s = e.withColumn("sd", win.trailing(F.col("v"), ["label", "j"], "vec_id", 5, least=3))
    return s.groupBy("vec_id", "label").agg(F.median("sd").alias("m"), F.count("sd").alias("n")).where("n > 0").select("vec_id", "label", r6("m").alias("motion"))


@register(_sql("SELECT source, run, min(node) AS state, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY source ORDER BY us, row_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, CASE WHEN lag(node) OVER (PARTITION BY source ORDER BY us, row_no) = node THEN 0 ELSE 1 END AS new FROM fr)) GROUP BY source, run"))
def win6_islands(spark, sf_dir):
    return win.islands(frames(spark, sf_dir), "source", ORDER, F.col("node"), {"start_us": F.min("us"), "end_us": F.max("us"), "n": F.count(F.lit(1))}).select("source", "run", "state", "start_us", "end_us", "n")


@register("SELECT o_custkey, min(d) AS first, max(d) AS last, count(*) AS n FROM (SELECT o_custkey, d, d - row_number() OVER (PARTITION BY o_custkey ORDER BY d) AS k FROM (SELECT DISTINCT o_custkey, epoch_us(o_orderdate) // 2592000000000 AS d FROM orders)) GROUP BY o_custkey, k")
def win6_consecutive_bins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate AS timestamp_ntz))") / 2592000000000).alias("d"))
    return win.consecutive(o, "o_custkey", "d")


@register(_sql("SELECT row_no, source, CASE WHEN dt > 0 AND dt < 86400000000 THEN round(atan2(sin(dv), cos(dv)) / (2 * pi() * dt / 3600000000.0), 6) + 0.0 END AS rate FROM (SELECT row_no, source, value - lag(value) OVER (PARTITION BY source ORDER BY us, row_no) AS dv, us - lag(us) OVER (PARTITION BY source ORDER BY us, row_no) AS dt FROM fr)"))
def win7_lag_rate(spark, sf_dir):
    """Wrapped phase step over time to the last frame; null unless it is under a day old."""
    w = win.ordered("source", ORDER)
    f = frames(spark, sf_dir).select("row_no", "source", (F.col("value") - F.lag("value").over(w)).alias("dv"), (F.col("us") - F.lag("us").over(w)).alias("dt"))
    rate = F.atan2(F.sin("dv"), F.cos("dv")) / (2 * F.pi() * F.col("dt") / 3600000000.0)
    return f.select("row_no", "source", F.when((F.col("dt") > 0) & (F.col("dt") < DAY), r6(rate)).alias("rate"))


@register(_sql("SELECT row_no, source, round(value + 2 * pi() * coalesce(sum(turn) OVER (PARTITION BY source ORDER BY us, row_no ROWS UNBOUNDED PRECEDING), 0), 6) + 0.0 AS phase FROM (SELECT *, -floor((value - lag(value) OVER (PARTITION BY source ORDER BY us, row_no)) / (2 * pi()) + 0.5) AS turn FROM fr)"))
def win8_phase_continuity(spark, sf_dir):
    """Whole turns are added so that each frame lies within half a turn of the last one."""
    w = win.ordered("source", ORDER)
    f = frames(spark, sf_dir).withColumn("turn", -F.floor((F.col("value") - F.lag("value").over(w)) / (2 * F.pi()) + 0.5).cast("double"))
    return f.select("row_no", "source", r6(F.col("value") + 2 * F.pi() * F.coalesce(F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).alias("phase"))


_DAILY = "d AS (SELECT node, us // 86400000000 AS bin, median(value) AS v FROM fr GROUP BY 1, 2)"


def _daily(spark, sf_dir):
    return win.time_bins(frames(spark, sf_dir), "node", "us", DAY, {"v": F.median("value")})


@register(_sql("SELECT node, bin, CASE WHEN nb = 5 AND na = 5 AND hi - lo = 9 THEN round(a - b, 6) + 0.0 END AS shift FROM (SELECT node, bin, quantile_cont(v, 0.5) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a, quantile_cont(v, 0.5) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, count(v) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS na, count(v) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS nb, max(bin) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS hi, min(bin) OVER (PARTITION BY node ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lo FROM d)", _DAILY))
def win9_shift(spark, sf_dir):
    return win.shift_scores(_daily(spark, sf_dir), "node", "bin", "v", 5).select("node", "bin", r6("shift").alias("shift"))


@register(_sql("SELECT row_no, node, rank() OVER (PARTITION BY node ORDER BY round(value)) + (count(*) OVER (PARTITION BY node, round(value)) - 1) / 2.0 AS rk FROM fr"))
def win10_rank_ties(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("v", F.round("value"))
    return f.select("row_no", "node", win.rank_ties("v", "node").alias("rk"))


@register(_sql("SELECT row_no, node, row_number() OVER (PARTITION BY node ORDER BY value, row_no) AS rk FROM fr"))
def win11_argsort_rank(spark, sf_dir):
    return frames(spark, sf_dir).select("row_no", "node", F.row_number().over(win.ordered("node", ["value", "row_no"])).cast("bigint").alias("rk"))


@register(_sql("SELECT source, max(n) AS most FROM (SELECT source, count(*) OVER (PARTITION BY source ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND CURRENT ROW) AS n FROM fr) GROUP BY source"))
def win12_range_count(spark, sf_dir):
    return win.densest(frames(spark, sf_dir), "source", "us", 2 * DAY)


@register(_sql("SELECT source, row_no, gap FROM (SELECT source, row_no, us - lag(us) OVER (PARTITION BY source ORDER BY us, row_no) AS gap FROM fr) WHERE gap > 86400000000"))
def win13_gaps(spark, sf_dir):
    w = win.ordered("source", ORDER)
    return frames(spark, sf_dir).withColumn("gap", F.col("us") - F.lag("us").over(w)).where(F.col("gap") > DAY).select("source", "row_no", "gap")


@register(_sql("SELECT row_no, source, row_number() OVER (PARTITION BY source ORDER BY us, row_no) <= greatest(CAST(floor(count(*) OVER (PARTITION BY source) * 0.6) AS BIGINT), 1) AS trains FROM fr"))
def win14_split(spark, sf_dir):
    return win.chronological(frames(spark, sf_dir), "source", ORDER).select("row_no", "source", "trains")


@register(_sql("SELECT node, bin, round(coalesce(v, CASE WHEN bi - ai - 1 <= 3 THEN av + (bv - av) * (bin - ai) / (bi - ai) END), 6) + 0.0 AS filled FROM (SELECT node, bin, v, last_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS ai, last_value(v IGNORE NULLS) OVER b AS av, first_value(CASE WHEN v IS NOT NULL THEN bin END IGNORE NULLS) OVER f AS bi, first_value(v IGNORE NULLS) OVER f AS bv FROM g WINDOW b AS (PARTITION BY node ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY node ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))", "d AS (SELECT node, us // 3600000000 AS bin, median(value) AS v FROM fr GROUP BY 1, 2), e AS (SELECT node, min(bin) AS lo, max(bin) AS hi FROM d GROUP BY node), k AS (SELECT node, unnest(range(lo, hi + 1)) AS bin FROM e), g AS (SELECT k.node, k.bin, d.v FROM k LEFT JOIN d ON k.node = d.node AND k.bin = d.bin)"))
def win18_interp(spark, sf_dir):
    """Hourly bins made dense; gaps of up to three hours are filled by lines."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", HOUR, {"v": F.median("value")})
    g = win.dense(d, "node", "bin").join(d, ["node", "bin"], "left")
    return win.fill_gaps(g, "node", "bin", "v", 3).select("node", "bin", r6("filled").alias("filled"))


@register(_sql("SELECT source, row_no, prev AS from_label, node AS to_label FROM (SELECT source, row_no, node, lag(node) OVER (PARTITION BY source ORDER BY us, row_no) AS prev FROM fr) WHERE prev IS NOT NULL AND prev <> node"))
def win19_transitions(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("from_label", F.lag("node").over(win.ordered("source", ORDER)))
    return f.where("from_label IS NOT NULL AND from_label <> node").select("source", "row_no", "from_label", F.col("node").alias("to_label"))


@register(_sql("SELECT row_no, source, round(value - lag(value) OVER (PARTITION BY source ORDER BY us, row_no), 6) + 0.0 AS diff, round(value - m, 6) + 0.0 AS centred FROM fr JOIN (SELECT source, median(value) AS m FROM fr GROUP BY source) USING (source)"))
def win20_diff_centre(spark, sf_dir):
    w = win.ordered("source", ORDER)
    return frames(spark, sf_dir).select("row_no", "source", r6(F.col("value") - F.lag("value").over(w)).alias("diff"), r6(F.col("value") - F.median("value").over(Window.partitionBy("source"))).alias("centred"))


@register(_sql("SELECT row_no, f.source, abs(value - m) > 6 * mad AS flagged FROM fr f JOIN (SELECT b.source, m, median(abs(value - m)) AS mad FROM b JOIN (SELECT source, median(value) AS m FROM b GROUP BY source) c ON b.source = c.source GROUP BY b.source, m) x ON f.source = x.source", "b AS (SELECT * FROM fr WHERE us < 1704672000000000)"))
def win21_mad_flags(spark, sf_dir):
    """Rows farther than 6 MADs from the median of their source's first week."""
    f = frames(spark, sf_dir)
    base = f.where(F.col("us") < 1704672000000000).withColumn("m", F.median("value").over(Window.partitionBy("source")))
    base = base.groupBy("source").agg(F.first("m").alias("m"), F.median(F.abs(F.col("value") - F.col("m"))).alias("mad"))
    return f.join(base, "source").select("row_no", "source", (F.abs(F.col("value") - F.col("m")) > 6 * F.col("mad")).alias("flagged"))


@register(_sql("SELECT node, bin, round((v - m) / s, 6) + 0.0 AS z FROM (SELECT q.node, q.bin, q.v, x.m, x.s FROM q JOIN x ON q.node = x.node AND q.k = x.k)", "q AS (SELECT node, us // 21600000000 AS bin, avg(value) AS v, least(round(count(*) / 4.0), 5) AS k FROM fr GROUP BY 1, 2), c AS (SELECT node, k, median(v) AS m, count(*) AS n FROM q GROUP BY node, k), x AS (SELECT q.node, q.k, c.m, greatest(1.4826 * median(abs(q.v - c.m)), 1e-9) AS s FROM q JOIN c ON q.node = c.node AND q.k = c.k WHERE c.n >= 10 GROUP BY q.node, q.k, c.m)"))
def win22_count_floor(spark, sf_dir):
    """A bin's deviation in units of the spread of bins with about as many frames."""
    q = win.time_bins(frames(spark, sf_dir), "node", "us", 6 * HOUR, {"v": F.avg("value"), "k": F.least(F.round(F.count(F.lit(1)) / 4.0), F.lit(5.0))})
    c = q.withColumn("m", F.median("v").over(Window.partitionBy("node", "k")))
    x = c.groupBy("node", "k").agg(F.first("m").alias("m"), F.count(F.lit(1)).alias("n"), F.greatest(1.4826 * F.median(F.abs(F.col("v") - F.col("m"))), F.lit(1e-9)).alias("s")).where("n >= 10")
    return q.join(x, ["node", "k"]).select("node", "bin", r6((F.col("v") - F.col("m")) / F.col("s")).alias("z"))


_CELLS = _DAILY + ", o AS (SELECT min(bin) AS lo, max(bin) AS hi FROM d), k AS (SELECT node, unnest(range(lo, hi + 1)) AS bin FROM (SELECT DISTINCT node FROM d), o), g AS (SELECT k.node, k.bin, d.v, lo, hi, d.v - lag(d.v) OVER (PARTITION BY k.node ORDER BY k.bin) AS step FROM k CROSS JOIN o LEFT JOIN d ON k.node = d.node AND k.bin = d.bin)"


@register(_sql("SELECT bin, count(z) AS cells, round(sqrt(avg(z * z)), 6) + 0.0 AS rms FROM (SELECT bin, (a - b) / (s / sqrt(2) * sqrt(0.5)) AS z FROM (SELECT bin, lo, hi, avg(v) OVER x AS a, avg(v) OVER y AS b, count(v) OVER x AS na, count(v) OVER y AS nb, stddev_pop(step) OVER (PARTITION BY node) AS s FROM g WINDOW x AS (PARTITION BY node ORDER BY bin ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), y AS (PARTITION BY node ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE na >= 3 AND nb >= 3 AND s > 0 AND bin >= lo + 4 AND bin <= hi - 4) GROUP BY bin", _CELLS))
def win23_coherent_steps(spark, sf_dir):
    """Root mean square, over series, of the standardised step at each bin."""
    return steps.coherent_steps(_daily(spark, sf_dir), "node", "bin", "v", 4).select("bin", "cells", r6("rms").alias("rms"))


@register()
def win23_peaks(spark, sf_dir):
    """The bins where series step together, no two nearer than six."""
    s = steps.coherent_steps(_daily(spark, sf_dir), "node", "bin", "v", 4).select("bin", "cells", r6("rms").alias("rms"))
    return steps.peaks(s, "bin", "rms", 6)


@register(_sql("SELECT bin, round(motion, 6) + 0.0 AS motion, round(mid + 3 * 1.4826 * mad, 6) + 0.0 AS threshold, motion > mid + 3 * 1.4826 * mad AS moved FROM t, (SELECT any_value(mid) AS mid, median(abs(motion - mid)) AS mad FROM t, (SELECT median(motion) AS mid FROM t)) u", _CELLS + ", m AS (SELECT node, median(abs(step)) AS m FROM g GROUP BY node), t AS (SELECT bin, avg(abs(step) / m) AS motion FROM g JOIN m USING (node) WHERE step IS NOT NULL AND m > 0 GROUP BY bin)"))
def win23_motion_index(spark, sf_dir):
    """How much all series move from bin to bin, beside what is usual, and where that is beyond three deviations."""
    m = steps.motion_index(_daily(spark, sf_dir), "node", "bin", "v")
    return m.select("bin", r6("motion").alias("motion"), r6("threshold").alias("threshold"), "moved")


@register(_sql("SELECT node, round(max(m), 6) + 0.0 AS peak FROM (SELECT node, avg(v) OVER w AS m, count(*) OVER w AS n FROM (SELECT k.node, k.bin, coalesce(d.v, 0.0) AS v FROM k LEFT JOIN d ON k.node = d.node AND k.bin = d.bin) WINDOW w AS (PARTITION BY node ORDER BY bin ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) WHERE n = 6 GROUP BY node", "d AS (SELECT node, us // 3600000000 AS bin, sum(value) AS v FROM fr GROUP BY 1, 2), e AS (SELECT node, min(bin) + 1 AS lo, max(bin) - 1 AS hi FROM d GROUP BY node), k AS (SELECT node, unnest(range(lo, hi + 1)) AS bin FROM e)"))
def win24_peak_rate(spark, sf_dir):
    """Highest mean of six hourly totals; an hour without rows is 0, the partial first and last hours are dropped."""
    d = win.time_bins(frames(spark, sf_dir), "node", "us", HOUR, {"v": F.sum("value")})
    ends = Window.partitionBy("node")
    k = win.dense(d, "node", "bin").withColumn("lo", F.min("bin").over(ends)).withColumn("hi", F.max("bin").over(ends)).where("bin > lo AND bin < hi").select("node", "bin")
    w = win.ordered("node", "bin").rowsBetween(-5, 0)
    g = k.join(d, ["node", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))).select("node", F.avg("v").over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n"))
    return g.where("n = 6").groupBy("node").agg(r6(F.max("m")).alias("peak"))
