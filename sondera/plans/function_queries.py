"""Scalar, date, bit, array, map, JSON and hash functions, sorts, SQL text, folds of evaluation; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.expr import r6, wrap
from ..operators import models
from ..operators import windows as win
from ..session import frames, table
from .catalog import register
from .frame_queries import DAY, FR, ORDER, _sql
from .vector_queries import _D2, _XY, _e, _points


@register("SELECT p_partkey, lower(p_name) AS low, split_part(p_name, ' ', 1) AS first, right(p_name, 4) AS tail, replace(trim(p_name), ' ', '_') AS joined, starts_with(p_brand, 'Brand#1') AS one, contains(p_type, 'STEEL') AS steel, lpad(CAST(p_size AS VARCHAR), 3, '0') AS padded FROM part")
def fn_strings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.lower("p_name").alias("low"), F.substring_index("p_name", " ", 1).alias("first"), F.expr("right(p_name, 4)").alias("tail"), F.replace(F.trim("p_name"), F.lit(" "), F.lit("_")).alias("joined"), F.startswith("p_brand", F.lit("Brand#1")).alias("one"), F.contains("p_type", F.lit("STEEL")).alias("steel"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("padded"))


@register(_sql("SELECT row_no, strftime(make_timestamp(us), '%Y-%m-%d %H:%M') AS utc, CAST(((us - 18000000000) // 3600000000) % 24 AS BIGINT) AS local_hour, us // 60000000 AS minute, CAST((us // 86400000000) % 7 AS BIGINT) AS weekday FROM fr"))
def fn_dates(spark, sf_dir):
    """Instants as text in UTC, the hour at a fixed offset of five hours, and floors of time."""
    f = frames(spark, sf_dir)
    utc = F.date_format(F.expr("timestampadd(MICROSECOND, us, timestamp_ntz'1970-01-01 00:00:00')"), "yyyy-MM-dd HH:mm")
    return f.select("row_no", utc.alias("utc"), (F.floor((F.col("us") - 18000000000) / 3600000000) % 24).cast("bigint").alias("local_hour"), F.floor(F.col("us") / 60000000).cast("bigint").alias("minute"), (F.floor(F.col("us") / DAY) % 7).cast("bigint").alias("weekday"))


@register(_sql("SELECT row_no, round(sqrt(value * value + 9), 6) + 0.0 AS hyp, round(atan2(value, 3), 6) + 0.0 AS angle, round(exp(-value / 50), 6) + 0.0 AS decay, round(log10(1 + value), 6) + 0.0 AS lg, floor(value) + 0.0 AS fl, greatest(10.0, least(60.0, value)) AS clipped, sign(value - 30) + 0.0 AS sg, round(atan2(sin(value), cos(value)), 6) + 0.0 AS wrapped FROM fr"))
def fn_math(spark, sf_dir):
    v = F.col("value")
    return frames(spark, sf_dir).select("row_no", r6(F.hypot(v, F.lit(3.0))).alias("hyp"), r6(F.atan2(v, F.lit(3.0))).alias("angle"), r6(F.exp(-v / 50)).alias("decay"), r6(F.log10(1 + v)).alias("lg"), (F.floor(v).cast("double") + 0.0).alias("fl"), F.greatest(F.lit(10.0), F.least(F.lit(60.0), v)).alias("clipped"), (F.signum(v - 30) + 0.0).alias("sg"), r6(wrap(v)).alias("wrapped"))


@register(_sql("SELECT row_no, row_no & 255 AS low_byte, (row_no >> 8) & 255 AS high_byte, row_no << 4 AS shifted, xor(row_no & 255, (row_no >> 8) & 255) AS checksum, (row_no * 40503) % 65536 AS u16 FROM fr"))
def fn_bits(spark, sf_dir):
    n = F.col("row_no")
    low, high = n.bitwiseAND(F.lit(255).cast("bigint")), F.shiftright(n, 8).bitwiseAND(F.lit(255).cast("bigint"))
    return frames(spark, sf_dir).select("row_no", low.alias("low_byte"), high.alias("high_byte"), F.shiftleft(n, 4).alias("shifted"), low.bitwiseXOR(high).alias("checksum"), F.pmod(n * 40503, F.lit(65536)).alias("u16"))


@register("SELECT vec_id, list_position(v, list_max(v)) AS argmax, len(list_distinct(list_transform(v, lambda x: sign(x)))) AS signs, round(list_sum(v[1:8]), 6) + 0.0 AS head, round(list_max(list_transform(range(1, 64), lambda i: v[i + 1] - v[i])), 6) + 0.0 AS jump FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)")
def fn_arrays(spark, sf_dir):
    v = F.col("v")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.array_position(v, F.array_max(v)).alias("argmax"), F.size(F.array_distinct(F.transform(v, lambda x: F.signum(x) + 0.0))).cast("bigint").alias("signs"), r6(F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda s, x: s + x)).alias("head"), r6(F.array_max(F.zip_with(F.slice(v, 2, 63), F.slice(v, 1, 63), lambda a, b: a - b))).alias("jump"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register(_sql("SELECT source, max(n) FILTER (WHERE node = 'click') AS clicks, count(*) AS kinds, sum(n) AS total FROM (SELECT source, node, count(*) AS n FROM fr GROUP BY source, node) GROUP BY source"))
def fn_maps(spark, sf_dir):
    """A counter for each source as a map from node to count."""
    g = frames(spark, sf_dir).groupBy("source", "node").agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("node", "n"))).alias("m"))  # an entry for each node
    return m.select("source", F.try_element_at("m", F.lit("click")).alias("clicks"), F.size("m").cast("bigint").alias("kinds"), F.aggregate(F.map_values("m"), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@register("SELECT doc_id, sha256(coalesce(text, '')) AS sha, md5(coalesce(text, '')) AS md FROM documents")
def fn_hashes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return d.select("doc_id", F.sha2(raw, 256).alias("sha"), F.md5(raw).alias("md"))


@register(_sql("SELECT row_no, CASE WHEN value < 5 THEN 'QUIET' WHEN value < 50 AND node = 'click' THEN 'NORMAL' WHEN value < 50 THEN 'OTHER' ELSE 'LOUD' END AS verdict FROM fr"))
def fn_conditional(spark, sf_dir):
    v = F.col("value")
    return frames(spark, sf_dir).select("row_no", F.when(v < 5, "QUIET").when((v < 50) & (F.col("node") == "click"), "NORMAL").when(v < 50, "OTHER").otherwise("LOUD").alias("verdict"))


@register(f"WITH {FR} SELECT node, b AS bucket, round(median(value), 6) + 0.0 AS med, count(*) AS n FROM (SELECT node, value, ntile(20) OVER (PARTITION BY node ORDER BY us, row_no) AS b FROM fr) GROUP BY node, b")
def src15_sql_over_files(spark, sf_dir):
    """A series thinned to twenty buckets, written as SQL over files."""
    return spark.sql(
        """SELECT node, b AS bucket, round(median(value), 6) + 0.0D AS med, count(*) AS n
           FROM (SELECT event_type AS node, value, ntile(20) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM {e})
           GROUP BY node, b""",
        e=table(spark, sf_dir, "events"),
    )


@register(_sql("SELECT source, row_no, value FROM fr QUALIFY row_number() OVER (PARTITION BY source ORDER BY us DESC, row_no DESC) <= 3"))
def src21_tail(spark, sf_dir):
    """The last three frames of each source."""
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("us"), F.desc("row_no")))
    return frames(spark, sf_dir).withColumn("k", k).where("k <= 3").select("source", "row_no", "value")


@register(_sql("SELECT source, node, row_number() OVER (ORDER BY n DESC, source, node) AS place FROM (SELECT source, node, count(*) AS n FROM fr GROUP BY source, node) ORDER BY n DESC, source, node LIMIT 25"))
def srt1_multi_key_sort(spark, sf_dir):
    """The 25 largest groups in a sort over several keys: each task keeps its own 25."""
    g = frames(spark, sf_dir).groupBy("source", "node").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source", "node").limit(25)
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source", "node")).cast("bigint")).select("source", "node", "place")


@register(_sql("SELECT source, list_sort(list(value))[count(*) // 2 + 1] AS upper_median, min(value) AS lo, max(value) AS hi FROM fr GROUP BY source"))
def srt6_upper_median(spark, sf_dir):
    """The upper of the middle two: a nearest-rank percentile, by rank in a window, so no group becomes an array."""
    w = Window.partitionBy("source")
    f = frames(spark, sf_dir).select("source", "value", F.row_number().over(w.orderBy("value")).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    return f.groupBy("source").agg(F.max(F.when(F.col("i") == F.floor(F.col("n") / 2) + 1, F.col("value"))).alias("upper_median"), F.min("value").alias("lo"), F.max("value").alias("hi"))


_FOLDS = "s AS (SELECT *, vec_id % 4 AS night FROM p), f AS (SELECT unnest(range(4)) AS fold)"
_FG = "g AS (SELECT fold, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, greatest(var_samp(x), 1.0) AS vx, greatest(var_samp(y), 1e-8) AS vy, covar_samp(x, y) AS cxy FROM s, f WHERE night <> fold GROUP BY fold, label)"


def _d2_of(m: Column) -> Column:
    """Distance of a row (x, y) to a model, and the model's name."""
    return F.struct(models.mahalanobis2(F.col("x") - m["mx"], F.col("y") - m["my"], m["vx"], m["vy"], m["cxy"]).alias("d2"), m["model"].alias("model"))


@register(_e(_XY, _FOLDS, _FG, f"d AS (SELECT p.vec_id, p.night, p.label AS truth, g.label, {_D2} AS d2 FROM s p JOIN g ON g.fold = p.night AND g.n >= 5)", "c AS (SELECT vec_id, night, truth, arg_min(label, d2) AS said FROM d GROUP BY vec_id, night, truth)", body="SELECT night, count(*) AS n, count(*) FILTER (WHERE said = truth) AS correct FROM c GROUP BY night"))
def ml4_leave_one_night_out(spark, sf_dir):
    """Each night against models of all others: a row goes to the folds that it trains, so one aggregation makes the models of all folds."""
    s = _points(spark, sf_dir).withColumn("night", F.col("vec_id") % 4)
    train = s.withColumn("fold", F.explode(F.filter(F.array(*[F.lit(i).cast("bigint") for i in range(4)]), lambda f: f != F.col("night"))))
    g = models.gaussian(train, ["fold", "label"], "x", "y").where(F.col("n") >= models.LEAST_ROWS).withColumnRenamed("label", "model")
    best = models.least_in(s, g, "night", "fold", ["vec_id", "night", "label"], _d2_of, "b")
    return best.groupBy("night").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b.model") == F.col("label")).alias("correct"))


@register(_e(_XY, "s AS (SELECT *, vec_id % 2 AS rx FROM p)", "g AS (SELECT rx, label, count(*) AS n, avg(x) AS mx, avg(y) AS my, greatest(var_samp(x), 1.0) AS vx, greatest(var_samp(y), 1e-8) AS vy, covar_samp(x, y) AS cxy FROM s GROUP BY rx, label)", f"d AS (SELECT p.vec_id, g.rx AS enrolled, p.rx AS tested, p.label AS truth, g.label, {_D2} AS d2 FROM s p JOIN g ON g.n >= 5 AND g.rx <> p.rx)", body="SELECT enrolled, tested, count(*) AS n, count(*) FILTER (WHERE said = truth) AS correct FROM (SELECT vec_id, enrolled, tested, truth, arg_min(label, d2) AS said FROM d GROUP BY vec_id, enrolled, tested, truth) GROUP BY enrolled, tested"))
def ml4_cross_receiver(spark, sf_dir):
    """Models of one receiver on the rows of the other."""
    s = _points(spark, sf_dir).withColumn("rx", F.col("vec_id") % 2)
    g = models.gaussian(s, ["rx", "label"], "x", "y").where(F.col("n") >= models.LEAST_ROWS).withColumnsRenamed({"label": "model", "rx": "enrolled"}).withColumn("tested", 1 - F.col("enrolled"))
    best = models.least_in(s.withColumn("tested", F.col("rx")), g, "rx", "tested", ["vec_id", "rx", "label"], _d2_of, "b").withColumn("enrolled", 1 - F.col("rx"))
    return best.groupBy("enrolled", "tested").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("b.model") == F.col("label")).alias("correct"))


@register(_sql("SELECT source, w AS \"window\", s AS size, round(stddev_samp(value), 6) + 0.0 AS sd FROM (SELECT source, value, s, (row_number() OVER (PARTITION BY source, s ORDER BY us, row_no) - 1) // s AS w FROM fr, (VALUES (4::BIGINT), (16::BIGINT)) AS g(s)) GROUP BY source, w, s HAVING count(*) = s"))
def agg29_window_lengths(spark, sf_dir):
    """One summary at several window lengths in one pass."""
    f = frames(spark, sf_dir).withColumn("size", F.explode(F.array(F.lit(4).cast("bigint"), F.lit(16).cast("bigint"))))
    w = F.floor((F.row_number().over(win.ordered(["source", "size"], ORDER)) - 1) / F.col("size")).cast("bigint")
    g = f.withColumn("window", w).groupBy("source", "window", "size").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd")).where("n = size")
    return g.select("source", "window", "size", r6("sd").alias("sd"))
