"""Joins across receivers, labels, events and time; sorts and set operations; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import r6
from ..operators import joins
from ..operators import windows as win
from ..operators.models import least_of
from ..session import frames, table
from .catalog import register
from .frame_queries import DAY, HOUR, ORDER, _sql

_BINS = "d AS (SELECT node, us // 86400000000 AS bin, source % 2 AS rx, median(value) AS v FROM fr GROUP BY 1, 2, 3)"


def _bins(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("rx", F.col("source") % 2)
    return win.time_bins(f, ["node", "rx"], "us", DAY, {"v": F.median("value")}).select("node", "bin", "rx", "v")


@register(_sql("SELECT rx, bin, node, round(v, 6) + 0.0 AS v FROM d WHERE rx * 1000000 + bin IN (SELECT rx * 1000000 + bin FROM d GROUP BY rx, bin HAVING count(DISTINCT node) = 5)", _BINS))
def jn1_complete(spark, sf_dir):
    """Bins of a receiver in which every beacon is present."""
    return joins.complete(_bins(spark, sf_dir), ["rx", "bin"], "node", 5).select("rx", "bin", "node", r6("v").alias("v"))


@register(_sql("SELECT a.node, a.bin, round(a.v - b.v, 6) + 0.0 AS diff FROM d a JOIN d b ON a.node = b.node AND a.bin = b.bin WHERE a.rx = 0 AND b.rx = 1", _BINS))
def jn2_cross_receiver(spark, sf_dir):
    d = _bins(spark, sf_dir)
    a, b = (d.where(F.col("rx") == i).select("node", "bin", F.col("v").alias(f"v{i}")) for i in (0, 1))
    return a.join(b, ["node", "bin"]).select("node", "bin", r6(F.col("v0") - F.col("v1")).alias("diff"))


@register("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn3_lookup(spark, sf_dir):
    """A dimension of fixed size joins by broadcast when the planner sees that it is small."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("s_suppkey", "s_name", "n_name", "r_name")


@register(_sql("SELECT g.source, g.at, max(t.v) AS label FROM (SELECT source, d * 86400000000 AS at FROM (SELECT DISTINCT source, us // 86400000000 AS d FROM fr)) g ASOF LEFT JOIN (SELECT source, us, max(node) AS v FROM fr GROUP BY source, us) t ON t.source = g.source AND t.us <= g.at GROUP BY 1, 2"))
def jn4_asof_label(spark, sf_dir):
    """The label in force at the start of each day that has frames."""
    f = frames(spark, sf_dir)
    grid = f.select("source", (F.floor(F.col("us") / DAY) * DAY).alias("at")).distinct()
    labels = f.select("source", F.col("us").alias("at"), "node")
    return joins.as_of(grid, labels, ["source"], "at", "node", "label").select("source", "at", "label")


_SPANS = "s AS (SELECT node, w, min(us) AS lo, max(us) AS hi FROM (SELECT node, us, (row_number() OVER (PARTITION BY node ORDER BY us, row_no) - 1) // 64 AS w FROM fr) GROUP BY node, w HAVING count(*) = 64)"


@register(_sql("SELECT s.node, s.w AS \"window\", count(*) AS n, round(median(f.value), 6) + 0.0 AS ref FROM s JOIN fr f ON f.us >= s.lo AND f.us <= s.hi WHERE f.node = 'click' GROUP BY s.node, s.w HAVING count(*) >= 10", _SPANS))
def jn5_range_median(spark, sf_dir):
    """Median of the reference beacon's frames inside the span of each window of any beacon."""
    f = frames(spark, sf_dir)
    spans = win.count_windows(f, "node", ORDER, 64, {"lo": F.min("us"), "hi": F.max("us")})
    ref = f.where("node = 'click'").select("us", "value")
    g = joins.in_range(spans, ref, [], "lo", "hi", "us", DAY).groupBy("node", "window").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("m"))
    return g.where("n >= 10").select("node", "window", "n", r6("m").alias("ref"))


@register(_sql("SELECT w.source, w.lo, w.n, round(coalesce(w.v, k.v), 6) + 0.0 AS reading, k.away_us FROM w LEFT JOIN k ON w.source = k.source", "w AS (SELECT w.source, w.lo, w.hi, count(f.value) AS n, avg(f.value) AS v FROM (SELECT source, min(us) AS lo, max(us) AS hi FROM fr GROUP BY source) w LEFT JOIN fr f ON f.node = 'signup' AND f.us >= w.lo AND f.us <= w.hi GROUP BY 1, 2, 3), k AS (SELECT w.source, f.value AS v, abs(w.lo + w.hi - 2 * f.us) / 2.0 AS away_us FROM w, fr f WHERE w.n = 0 AND f.node = 'signup' AND f.value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY w.source ORDER BY abs(w.lo + w.hi - 2 * f.us), f.us, f.value) = 1)"))
def jn6_interval_membership(spark, sf_dir):
    """Mean of the readings inside each source's span; if there are none (n = 0), the reading nearest to its middle and how far away that is."""
    f = frames(spark, sf_dir)
    spans = f.groupBy("source").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    return _reading_of(spans, f.where("node = 'signup' AND value IS NOT NULL").select("us", "value"))


def _reading_of(spans, readings):
    g = joins.range_sums(spans.select("source", "lo", "hi"), readings, "lo", "hi", "us", "value", 5 * DAY, "n", "total")
    bare = g.where("n = 0").select("source", (F.col("lo") + F.col("hi")).alias("twice"))
    near = joins.nearest_value(bare, readings, "twice", "us", "value", DAY, "near", "away").select("source", "near", (F.col("away") / 2).alias("away_us"))
    j = g.join(near, "source", "left")
    return j.select("source", "lo", F.col("n").cast("bigint").alias("n"), r6(F.coalesce(F.when(F.col("n") > 0, F.col("total") / F.col("n")), "near")).alias("reading"), "away_us")


@register(_sql("SELECT a.row_no, min(abs(a.us - b.us)) AS gap FROM fr a JOIN fr b ON a.source = b.source WHERE a.node = 'click' AND b.node = 'view' GROUP BY a.row_no"))
def jn7_nearest(spark, sf_dir):
    """Time to the nearest frame of another stream of the same source."""
    f = frames(spark, sf_dir)
    left, right = f.where("node = 'click'").select("source", "us", "row_no"), f.where("node = 'view'").select("source", "us")
    return joins.nearest_gap(left, right, ["source"], "us", "gap").where("gap IS NOT NULL").select("row_no", "gap")


@register(_sql("SELECT a.source AS a, b.source AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM s a JOIN s b ON a.source < b.source AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 86400000000", "s AS (SELECT source, min(us) AS lo, max(us) AS hi FROM fr GROUP BY source)"))
def jn8_overlap(spark, sf_dir):
    """Pairs of sources whose spans, first to last row, share more than a day."""
    s = frames(spark, sf_dir).groupBy("source").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    return joins.overlaps(s, "source", "lo", "hi", DAY, DAY).select("a", "b", F.col("overlap").cast("bigint").alias("overlap"))


@register("WITH p AS (SELECT s_suppkey AS k, abs(s_acctbal) AS size, lpad(CAST(s_suppkey AS VARCHAR), (SELECT max(length(CAST(s_suppkey AS VARCHAR))) FROM supplier)::INTEGER, '0') AS id FROM supplier) SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k < b.k AND greatest(a.size, b.size) >= 2 * least(a.size, b.size) AND hamming(a.id, b.id) <= 1")
def jn9_near_miss_ids(spark, sf_dir):
    """Near-miss ids of all suppliers, whichever of the two is far larger: keyed by each way to leave a place out, so near ids meet in an equi join."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("size"))
    return joins.near_miss(s, "s_suppkey", "size", 2)


@register(_sql("SELECT a.rx, a.node, a.bin, round(a.step, 6) + 0.0 AS step, count(b.bin) > 0 AS replicated FROM j a LEFT JOIN j b ON a.node = b.node AND a.rx <> b.rx AND sign(a.step) = sign(b.step) AND abs(a.bin - b.bin) <= 2 AND abs(b.step) >= 10 GROUP BY a.rx, a.node, a.bin, a.step", _BINS + ", j AS (SELECT * FROM (SELECT rx, node, bin, v - lag(v) OVER (PARTITION BY rx, node ORDER BY bin) AS step FROM d) WHERE abs(step) >= 10)"))
def jn10_replicate(spark, sf_dir):
    """Steps that the other receiver sees as well: same beacon and sign, within two bins, large enough."""
    w = Window.partitionBy("rx", "node").orderBy("bin")
    j = _bins(spark, sf_dir).withColumn("step", F.col("v") - F.lag("v").over(w)).where("abs(step) >= 10").select("rx", "node", "bin", "step")
    return joins.replicated(j, "rx", ["node"], "bin", "step", 2, 10.0).select("rx", "node", "bin", r6("step").alias("step"), "replicated")


@register(_sql("SELECT a.node AS a, b.node AS b, round(a.m - b.m, 6) + 0.0 AS diff FROM m a JOIN m b ON a.node < b.node", "m AS (SELECT node, avg(value) AS m FROM fr GROUP BY node)"))
def jn11_pairs(spark, sf_dir):
    m = frames(spark, sf_dir).groupBy("node").agg(F.avg("value").alias("m"))
    return joins.unordered_pairs(m, "node").select("a", "b", r6(F.col("m_a") - F.col("m_b")).alias("diff"))


@register(_sql("SELECT a.rx AS enrolled, b.rx AS tested, a.node, round(b.v - a.v, 6) + 0.0 AS moved FROM e a JOIN e b ON a.node = b.node AND a.rx <> b.rx", "e AS (SELECT source % 3 AS rx, node, median(value) AS v FROM fr GROUP BY 1, 2)"))
def jn12_ordered_pairs(spark, sf_dir):
    """Every ordered pair of sessions for each source."""
    e = frames(spark, sf_dir).groupBy((F.col("source") % 3).alias("rx"), "node").agg(F.median("value").alias("v"))
    a, b = e.select(F.col("rx").alias("enrolled"), "node", F.col("v").alias("a")), e.select(F.col("rx").alias("tested"), "node", F.col("v").alias("b"))
    return a.join(b, "node").where("enrolled <> tested").select("enrolled", "tested", "node", r6(F.col("b") - F.col("a")).alias("moved"))


@register(_sql("SELECT row_no, min(node) AS nearest FROM (SELECT f.row_no, m.node, round(abs(f.value - m.m), 6) AS d, min(round(abs(f.value - m.m), 6)) OVER (PARTITION BY f.row_no) AS best FROM fr f, (SELECT node, median(value) AS m FROM fr GROUP BY node) m) WHERE d = best GROUP BY row_no"))
def jn13_score_argmin(spark, sf_dir):
    """Each row against all models (one for each node, sent to all tasks if few); of equals the least name."""
    f = frames(spark, sf_dir)
    m = f.groupBy("node").agg(F.median("value").alias("m")).select(F.col("node").alias("model"), "m")
    gap = lambda c: F.struct(F.round(F.abs(F.col("value") - c["m"]), 6).alias("d"), c["model"].alias("model"))
    best = least_of(f.select("row_no", "value"), m, ["row_no"], gap, "b")
    return best.select("row_no", F.col("b.model").alias("nearest"))


@register(_sql("SELECT e.row_no, count(*) AS n, round(median(f.value) FILTER (WHERE f.us < e.us), 6) + 0.0 AS before, round(median(f.value) FILTER (WHERE f.us >= e.us), 6) + 0.0 AS after FROM fr e JOIN fr f ON f.node = e.node AND f.us >= e.us - 43200000000 AND f.us < e.us + 43200000000 GROUP BY e.row_no"))
def jn15_event_windows(spark, sf_dir):
    """Medians of a beacon half a day before and after every frame of the stream."""
    f = frames(spark, sf_dir)
    g = joins.sliding_around(f.select("node", "us", "row_no"), f, ["node"], "us", "us", "value", DAY // 2, DAY)
    return g.select("row_no", "n", r6("before").alias("before"), r6("after").alias("after"))


@register(_sql("SELECT DISTINCT source FROM fr WHERE value > 20 AND source NOT IN (SELECT source FROM fr WHERE node = 'purchase' AND value > 60)"))
def jn16_anti(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.where("value > 20").select("source").distinct().join(f.where("node = 'purchase' AND value > 60"), "source", "left_anti")


@register(_sql("SELECT a.node, a.rx, a.bin, round(a.v - b.v, 6) + 0.0 AS change FROM d a JOIN d b ON a.node = b.node AND a.rx = b.rx AND a.bin = b.bin + 3", _BINS))
def jn17_lag_join(spark, sf_dir):
    """x(t) - x(t - 3) of every receiver by bin number, so gaps don't shift the lag."""
    d = _bins(spark, sf_dir)
    old = d.select("node", "rx", (F.col("bin") + 3).alias("bin"), F.col("v").alias("old"))
    return d.join(old, ["node", "rx", "bin"]).select("node", "rx", "bin", r6(F.col("v") - F.col("old")).alias("change"))


@register(_sql("SELECT a.node, round(a.m - b.m, 6) + 0.0 AS gap FROM (SELECT node, median(value) AS m FROM fr WHERE source % 2 = 0 GROUP BY node HAVING count(*) >= 20) a JOIN (SELECT node, median(value) AS m FROM fr WHERE source % 2 = 1 GROUP BY node HAVING count(*) >= 20) b ON a.node = b.node"))
def jn18_receiver_agreement(spark, sf_dir):
    f = frames(spark, sf_dir)
    a, b = (f.where(F.col("source") % 2 == i).groupBy("node").agg(F.median("value").alias(f"m{i}"), F.count(F.lit(1)).alias("n")).where("n >= 20").drop("n") for i in (0, 1))
    return a.join(b, "node").select("node", r6(F.col("m0") - F.col("m1")).alias("gap"))


@register(_sql("SELECT p.source, count(*) AS bins, round(avg(CASE WHEN a.bin IS NOT NULL THEN 1.0 ELSE 0.0 END) / (SELECT count(*) * 1.0 / (SELECT max(us // 3600000000) - min(us // 3600000000) + 1 FROM fr) FROM a), 6) + 0.0 AS lift FROM (SELECT DISTINCT source, us // 3600000000 AS bin FROM fr) p LEFT JOIN a ON p.bin = a.bin GROUP BY p.source", "a AS (SELECT DISTINCT us // 3600000000 AS bin FROM fr WHERE value > 70)"))
def jn19_presence_activity(spark, sf_dir):
    """How much likelier activity is in the hours in which a source is present."""
    f = frames(spark, sf_dir).withColumn("bin", F.floor(F.col("us") / HOUR))
    active = f.where("value > 70").select("bin").distinct().withColumn("on", F.lit(1.0))
    base = active.agg(F.count(F.lit(1)).alias("k")).crossJoin(f.agg((F.max("bin") - F.min("bin") + 1).alias("all"))).select((F.col("k") * 1.0 / F.col("all")).alias("base"))
    p = f.select("source", "bin").distinct().join(active, "bin", "left").groupBy("source").agg(F.count(F.lit(1)).alias("bins"), F.avg(F.coalesce("on", F.lit(0.0))).alias("r"))
    return p.crossJoin(F.broadcast(base)).select("source", "bins", r6(F.col("r") / F.col("base")).alias("lift"))


# --- sorts, limits, sets


@register(_sql("SELECT source, count(*) AS n FROM fr GROUP BY source ORDER BY n DESC, source LIMIT 10"))
def srt2_top_n(spark, sf_dir):
    return frames(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@register("SELECT vec_id, label, unnest(list_slice(list_reverse_sort(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 1, 3)) AS v, unnest(range(1, 4)) AS k FROM embeddings")
def srt3_top_elements(spark, sf_dir):
    """The three largest elements of each vector."""
    e = table(spark, sf_dir, "embeddings")
    top = F.slice(F.sort_array(F.transform("embedding", lambda x: x.cast("double")), asc=False), 1, 3)
    return e.select("vec_id", "label", F.posexplode(top).alias("k", "v")).select("vec_id", "label", "v", (F.col("k") + 1).cast("bigint").alias("k"))


@register(_sql("SELECT row_no, source, i FROM (SELECT row_no, source, row_number() OVER (PARTITION BY source ORDER BY us, row_no) AS i, count(*) OVER (PARTITION BY source) AS n FROM fr) WHERE (i - 1) % greatest(1, n // 10) = 0"))
def srt5_even_subsample(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("i", F.row_number().over(win.ordered("source", ORDER)).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source")))
    return f.where((F.col("i") - 1) % F.greatest(F.lit(1), F.floor(F.col("n") / 10)) == 0).select("row_no", "source", "i")


@register(_sql("SELECT source FROM fr WHERE node = 'click' INTERSECT SELECT source FROM fr WHERE node = 'purchase'"))
def set1_intersect(spark, sf_dir):
    f = frames(spark, sf_dir)
    return f.where("node = 'click'").select("source").intersect(f.where("node = 'purchase'").select("source"))


@register(_sql("SELECT DISTINCT bin FROM (SELECT us // 3600000000 AS bin FROM fr WHERE node = 'click') EXCEPT SELECT us // 3600000000 FROM fr WHERE node = 'purchase'"))
def set2_difference(spark, sf_dir):
    f = frames(spark, sf_dir).select("node", F.floor(F.col("us") / HOUR).alias("bin"))
    return f.where("node = 'click'").select("bin").distinct().join(f.where("node = 'purchase'").select("bin"), "bin", "left_anti")


@register(_sql("SELECT 'early' AS part, count(*) AS n FROM fr WHERE us < 1705276800000000 UNION ALL SELECT 'late', count(*) FROM fr WHERE us >= 1705276800000000"))
def set3_union(spark, sf_dir):
    f, cut = frames(spark, sf_dir), 1705276800000000
    a, b = f.where(F.col("us") < cut).withColumn("part", F.lit("early")), f.where(F.col("us") >= cut).withColumn("part", F.lit("late"))
    return a.unionByName(b).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@register(_sql("SELECT DISTINCT node, source % 10 AS g FROM fr"))
def set4_distinct(spark, sf_dir):
    return frames(spark, sf_dir).select("node", (F.col("source") % 10).alias("g")).distinct()


