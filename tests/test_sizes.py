"""Queries on tables that are larger, or odder, than the driver's small ones."""

import os
import subprocess
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest
from sondera.operators import cluster, joins, kernels, stats
from sondera.plans import catalog
from sondera.sources import capture, frames
from sondera.streaming import streams

from pyspark.sql import functions as F

from .conftest import rows_of, sql_rows


def _same(spark, tmp_path, name, tables):
    """Whether a query gives its SQL's rows over tables that are written for it."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    return rows_of(got, columns) == sql_rows(duck, catalog.ORACLE[name], columns)


def test_equally_strong_taps(spark, tmp_path):
    """Two opposite taps of each of these are equally strong, and no other is as strong."""
    v = np.random.default_rng(5).integers(-3, 4, (60_000, 64))
    p = np.abs(np.fft.ifft(kernels.full_spectrum(np.concatenate([v, v[:, ::-1]], 1)), axis=1)) ** 2
    tied = v[(p >= p.max(1)[:, None] * (1 - 1e-9)).sum(1) == 2]
    assert len(tied) > 6
    rows = [(i, [float(x) / 100 for x in r], i % 3) for i, r in enumerate(tied)]
    assert _same(spark, tmp_path, "dsp6_impulse_response", {"embeddings": spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")})


@pytest.fixture(scope="module")
def far_sources(spark):
    """Events of sources whose numbers differ by 65,536, and so in more than the last two octets."""
    t = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id % 700, 0, id % 60)")
    return spark.range(400).select(F.col("id").alias("event_id"), t.alias("ts"), (F.col("id") % 23 + 65536 * (F.col("id") % 3)).alias("user_id"), F.element_at(F.array(*map(F.lit, ("click", "view", "error"))), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), (F.col("id") % 41 / 2).alias("value"), F.lit("{}").alias("props"))


def test_results_of_many_sources(spark, tmp_path, far_sources):
    more = far_sources.unionByName(far_sources.withColumns({"event_id": F.col("event_id") + 1000, "user_id": F.col("user_id") + 65536}))
    assert _same(spark, tmp_path, "snk3_parquet_results", {"events": more})


def test_allowed_among_many_sources(spark, tmp_path, far_sources):
    assert _same(spark, tmp_path, "src2_allowed_vectors", {"events": far_sources})


def test_overlaps_in_blocks(spark):
    """Pairs of spans of several blocks, each once; a span moves to few rows."""
    rng = np.random.default_rng(2)
    lo = rng.integers(0, 200, 300)
    spans = [(i, int(t), int(t + n)) for i, (t, n) in enumerate(zip(lo, rng.integers(0, 90, 300), strict=True))]
    want = sorted((a, b, o) for a, s, e in spans for b, t, f in spans if a < b and (o := min(e, f) - max(s, t)) > 5)
    got = joins.overlaps(spark.createDataFrame(spans, "k bigint, lo bigint, hi bigint"), "k", "lo", "hi", 10, 5, size=40)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_overlaps_without_ends_or_keys(spark):
    """A null end doesn't bind, a null or equal key makes no pair, as in SQL, also where blocks lie apart."""
    spans = [(i, 100 * i, 100 * i + 150) for i in range(40)] + [(50, None, None), (51, None, None), (52, None, 900), (53, 3000, None), (None, 0, 4000), (None, None, None), (54, 0, 900), (54, 500, 3000)]
    df = spark.createDataFrame(spans, "k bigint, lo bigint, hi bigint")
    df.createOrReplaceTempView("spans")
    want = spark.sql("SELECT a.k AS a, b.k AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) AS overlap FROM spans a JOIN spans b ON a.k < b.k AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 20")
    assert rows_of(joins.overlaps(df, "k", "lo", "hi", 100, 20, size=5)) == rows_of(want)


def test_overlaps_in_a_small_heap(tmp_path):
    """8,386,560 pairs of one block, whose rows together don't fit the heap, in a process of its own."""
    code = """
from pyspark.sql import SparkSession, functions as F
from sondera.operators import joins
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spans = spark.range(4096).select("id", F.col("id").alias("lo"), (F.col("id") + 9999).alias("hi"))
joins.overlaps(spans, "id", "lo", "hi", 100).write.format("noop").mode("overwrite").save()
spark.stop()
print("done")
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": f"--driver-memory 512m --conf spark.checkpoint.dir=file://{tmp_path}/shared pyspark-shell"}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    run = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.stdout.endswith("done\n"), run.stderr[-2000:]


def test_silhouette_of_close_and_far_vectors(spark):
    """Copies, near copies far from the origin, and several slabs and parts."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2500, 8)) * 1e-4 + 100 * rng.normal(size=(2500, 8)).round(1)[rng.integers(0, 40, 2500)]
    x[::7] = x[0]
    c = rng.integers(0, 3, 2500)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    assert np.allclose(cluster.distances(x, x), d, rtol=1e-9, atol=0)
    total = np.stack([d[:, c == k].sum(1) for k in range(3)], 1)
    size = np.bincount(c)
    a = total[np.arange(2500), c] / (size[c] - 1)
    b = np.where(np.arange(3) == c[:, None], np.inf, total / size).min(1)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(c, x, strict=True)], "c int, v array<double>").repartition(3)
    got = cluster.silhouette(df, "v", "c").first()
    assert got.n == 2500 and abs(got.silhouette - np.mean((b - a) / np.maximum(a, b))) < 1e-9


def test_a_capture_of_several_files(spark, tmp_path):
    """A large capture is several files, whose order by name is that of time; places and gaps go on across them."""
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("session"), (F.col("id") * 7919 % n).alias("us"))
    fields = [F.col("us").alias("pc_time_us"), F.lit("x").alias("label"), F.col("us").alias("seq"), F.lit("02:00:00:00:00:01").alias("mac"), *[F.lit(1).alias(c) for c in capture.OLD[4:9]], F.lit("1,2").alias("csi_data")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        capture.write_captures(rows, f"{tmp_path}/c", "session", ["us"], fields)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = capture.read_capture(spark, f"{tmp_path}/c")
    assert back.where("session = 'large'").select("file").distinct().count() > 2
    got = capture.replay(back.select("session", "file", "row_no", "seq", "pc_time_us"), "session").orderBy("session", "place").toPandas()
    for _, g in got.groupby("session"):
        assert g["seq"].is_monotonic_increasing and g["place"].tolist() == list(range(1, len(g) + 1))
        assert np.isnan(g["gap_us"].iloc[0]) and (g["gap_us"].iloc[1:].to_numpy() == np.diff(g["seq"])).all()


def test_ranks_across_buckets(spark):
    """More distinct values than buckets, many ties, a group without a name."""
    rng = np.random.default_rng(4)
    rows = [(None if i % 3 == 0 else i % 3, float(rng.integers(0, 500)) ** 3, int(rng.integers(0, 4))) for i in range(3000)] + [(1, None, 2), (7, 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, x double, y bigint")
    sort = lambda d: sorted((str(r.g), r.x, r.y, r["__r0"], r["__r1"]) for r in d.collect())
    apart = stats._ranked_apart(df, ["g"], ["x", "y"])
    assert sort(apart) == sort(stats._ranked(df, ["g"], ["x", "y"])) and len(sort(apart)) == 3001


def test_figures_of_a_window_without_pandas(monkeypatch):
    """Quantiles of a window equal those of pandas, missing values left out, and building them takes no Series for each window."""
    rng = np.random.default_rng(6)
    values = rng.normal(size=64).round(2)
    values[[3, 8, 9]] = np.nan
    values[16:24] = np.nan
    want = [(pd.Series(v).median(), pd.Series(v).quantile(0.75) - pd.Series(v).quantile(0.25)) for v in values.reshape(8, 8)]
    monkeypatch.setattr(pd, "Series", None)
    s = streams.SourceState(8)
    got = [(w["med"], w["iqr"]) for i, v in enumerate(values.tolist()) if (w := s.step(streams.Frame(i, v))) is not None]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12, equal_nan=True)


def test_modes_of_a_head_of_several_tiles(spark, tmp_path):
    """The head of a file that is read in many parts, damaged lines among them; no window takes a whole file."""
    rng = np.random.default_rng(7)
    values = [(int(a), int(b)) for a, b in zip(rng.integers(0, 4, 3000), rng.integers(1, 12, 3000), strict=True)]
    line = lambda i, a, b: "broken" if i % 7 == 3 else f'{i},x,{i},a2:bb:cc:dd:ee:02,-50,-95,{b},10,128,"1,2",{a},0,9'
    for name, part in (("a", values[:2000]), ("b", values[2000:])):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(capture.CAPTURE.names), *[line(i, a, b) for i, (a, b) in enumerate(part)]]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = capture.read_capture(spark, str(tmp_path))
        assert rows.select("file", "tile").distinct().count() > 20
        for order, groups in ((None, {"a.csv": values[:2000], "b.csv": values[2000:]}), (["part", "row_no"], {"all": values})):
            r = rows.withColumns({"part": F.col("file"), "file": F.lit("all")}) if order else rows
            for first in (10, 900, 1900, 20_000):
                want = []
                for name, v in groups.items():
                    cut = v[:2000], v[2000:]
                    head = [x for part in cut for i, x in enumerate(part) if i % 7 != 3][:first]
                    want.append((name, *[int(np.bincount([x[k] for x in head]).argmax()) for k in (0, 1)]))
                m = capture.modes(r, first, order)
                assert sorted(tuple(x) for x in m.collect()) == want
        spec = [s for s in m._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in s and "windowspecdefinition(" in s]
        assert spec and all("tile#" in s.split("windowspecdefinition(")[1].split("ASC")[0] for s in spec)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _hostile(rng, n):
    """Records of all kinds, cut ones, records inside records, and bytes that look like the beginning of one."""
    out = b""
    for i in range(n):
        v = rng.choice([frames.SYNC - 256, frames.PLAIN, frames.TYPED, frames.PROBE, 1, 0, 2], rng.choice([1, 5, 128, 384]))
        whole = frames.encode_vector(i, bytes(6), i, v, node=None if i % 2 else 7)
        out += (
            whole,
            frames.encode_status(3, i, 1, 1, 1, 0, 0, i, 2, 3, 4, -95 * 256, -50 * 256),
            frames.encode_probe(i, i),
            whole[: -rng.integers(1, 9)],
            frames.encode_vector(i, bytes(6), i, np.frombuffer(frames.encode_vector(i, bytes(6), i, v[:20], node=7), np.int8)),
            rng.choice([frames.SYNC, frames.PLAIN, frames.TYPED, 0, 1], rng.integers(0, 300)).astype(np.uint8).tobytes(),
        )[rng.integers(0, 6)]
    return out


def test_a_stream_in_blocks_is_one_search(spark, monkeypatch):
    """Long streams are decoded by several tasks, to the rows and offsets of one search from the beginning, wherever it enters a block."""
    rng = np.random.default_rng(8)
    raws = {"a": _hostile(rng, 500), "b": _hostile(rng, 60), "c": b"\xc5", None: _hostile(rng, 20)}
    rows = []
    for name, raw in raws.items():
        at = 0
        while at < len(raw):
            n = int(rng.choice([0, 1, 7, 411, 412, 413, 900]))
            rows.append((name, len(rows), bytearray(raw[at : at + n])))
            at += n
    monkeypatch.setattr(frames, "BLOCK", 700)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = frames.decode_chunks(spark.createDataFrame(rows, "stream string, i long, data binary").repartition(3), "stream", "i", "data")
        got = d.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for name, raw in raws.items():
        mine = sorted((r for r in got if r.stream == name), key=lambda r: r.offset)
        want = frames.decode(raw, final=True).rows
        assert [{k: r[k] for k in w} for r, w in zip(mine, want, strict=True)] == want
    assert len({r.task for r in got if r.stream == "a"}) > 1


def test_stops_depend_on_where_a_block_is_entered():
    """A block of one record after another inside a longer one's bytes has several stops; each is that of its own search."""
    inner = frames.encode_vector(1, bytes(6), 1, np.arange(100))
    rng = np.random.default_rng(9)
    several = 0
    for _ in range(60):
        raw = _hostile(rng, 8) + inner
        if len(raw) <= frames.LONGEST:
            continue
        got = frames.stops(raw)
        several += len(got) > 1
        for at in range(frames.LONGEST):
            assert len(raw) - len(frames.decode(raw[at:]).rest) == got[0 if len(got) == 1 else at]
    assert several
