"""Queries that do the whole job, against brute force."""

from collections import defaultdict

import numpy as np
from sondera.operators import cluster, joins, stats

from pyspark.sql import functions as F
from sondera.plans import catalog, relation_queries
from sondera.session import frames
from sondera.streaming import streams

from .conftest import DATA, rows_of

SF = str(DATA / "sf0.001")



def test_near_miss_both_ways_and_long_ids(spark):
    size = {1: 1.0, 2: 5.0, 3: 5.5, 10: 5.0, 12: 90.0, 10000: 1.0, 10001: 9.0, 10002: 8.0, 10012: 2.0, 20001: 30.0}
    want = sorted((str(a), str(b)) for a in size for b in size if a < b and sum(p != q for p, q in zip(f"{a:05}", f"{b:05}", strict=True)) == 1 and max(size[a], size[b]) >= 2 * min(size[a], size[b]))
    got = rows_of(joins.near_miss(spark.createDataFrame(list(size.items()), "id bigint, size double"), "id", "size", 2))
    assert got == want and ("1", "2") in got and ("10001", "20001") in got


def test_windows_around_every_event(spark):
    assert catalog.QUERIES["jn15_event_windows"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_windows_around_events_at_one_time(spark):
    points = [("a", t, float(v)) for t, v in [(0, 5), (3, 1), (3, 9), (4, 2), (9, 7), (10, 3), (23, 4)]]
    events = [("a", t, i) for i, t in enumerate([3, 3, 4, 10, 13, 30])]
    p, e = spark.createDataFrame(points, "k string, t bigint, v double"), spark.createDataFrame(events, "k string, at bigint, i bigint")
    med = lambda x: float(np.median(x)) if x else None
    want = [(i, med([v for _, t, v in points if at - 6 <= t < at]), med([v for _, t, v in points if at <= t < at + 6]), sum(at - 6 <= t < at + 6 for _, t, _ in points)) for _, at, i in events]
    got = joins.sliding_around(e, p, ["k"], "at", "t", "v", 6, 10).select("i", "before", "after", "n").collect()
    assert sorted(tuple(None if x != x else x for x in r) for r in got) == want


def test_overlaps_of_long_spans(spark):
    """Spans of equal start, inside each other, long and apart: each pair once."""
    spans = {1: (0, 100), 2: (0, 100), 3: (5, 12), 4: (30, 95), 5: (94, 200), 6: (99, 99), 7: (150, 151)}
    want = sorted((a, b, o) for a in spans for b in spans if a < b and (o := min(spans[a][1], spans[b][1]) - max(spans[a][0], spans[b][0])) > 3)
    df = spark.createDataFrame([(k, *v) for k, v in spans.items()], "k bigint, lo bigint, hi bigint")
    assert sorted(tuple(r) for r in joins.overlaps(df, "k", "lo", "hi", 10, 3).collect()) == want


def test_overlaps_are_as_long_as_the_sources_run(spark):
    assert catalog.QUERIES["jn8_overlap"](spark, SF).agg({"overlap": "max"}).first()[0] > 2 * 86_400_000_000


def test_short_spans_take_the_nearest_reading(spark):
    day = 86_400_000_000
    at = [(day, 1.0), (2 * day, 2.0), (2 * day, 1.5), (9 * day, 4.0), (9 * day + 10, 5.0)]
    spans = [(1, 0, 2 * day), (2, 2 * day + 1, 2 * day + 3), (3, 5 * day, 6 * day), (4, 9 * day + 3, 9 * day + 7), (5, 40 * day, 41 * day), (6, -9 * day, -8 * day), (7, 9 * day + 4, 9 * day + 7)]
    want = []
    for k, lo, hi in spans:
        inside = [v for t, v in at if lo <= t <= hi]
        t, v = min(sorted(at), key=lambda x: abs(x[0] - (lo + hi) / 2))
        want.append((k, lo, len(inside), round(float(np.mean(inside)), 6) if inside else v, None if inside else abs(t - (lo + hi) / 2)))
    got = relation_queries._reading_of(spark.createDataFrame(spans, "source bigint, lo bigint, hi bigint"), spark.createDataFrame(at, "us bigint, value double"))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_health_sees_gaps_stalls_losses_and_silence(spark, tmp_path):
    """Spans of 100 s, in two files: node a loses 3 and 2 numbers, is silent for a span and goes on; b only moves the watermark."""
    sec = 1_000_000
    a = [(10, 0, 5.0), (20, 1, 0.5), (80, 5, 2.0), (110, 6, 1.0), (310, 9, 7.0), (330, 10, 8.0)]
    rows = [("a", 1 + n % 2, t * sec, i, v, n, (65530 + 3 * i) % 65536) for i, (t, n, v) in enumerate(a)] + [("b", 9, t * sec, 100 + t, 1.0, t, 0) for t in (1, 900)]
    schema = "node string, source bigint, us bigint, row_no bigint, value double, seq bigint, drops int"
    for part in (rows[:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        frames = streams.landing(spark, str(tmp_path / "in"), schema).withColumn("at", F.timestamp_micros("us"))
        got = streams.run_to_end(streams.health(frames, "0 seconds", 100 * sec, 50 * sec, "seq", "drops"), str(tmp_path / "out"), str(tmp_path / "ck"))
    r = {x.start_us // sec: x for x in got.where("node = 'a'").collect()}
    assert sorted(r) == list(range(0, 900, 100))
    assert [r[k].dropped for k in (0, 100, 200, 300)] == [6, 3, None, 6]  # the counter wraps on the way
    assert [(x.n, x.sources, x.longest_gap_us, x.silent_us // sec, x.stalls, x.lost) for x in (r[k] for k in (0, 100, 200, 300))] == [(3, 2, 60 * sec, 20, 1, 3), (1, 1, 30 * sec, 90, 0, 0), (0, 0, None, 190, 0, None), (2, 2, 200 * sec, 70, 1, 2)]
    assert np.allclose([r[k].trend for k in (100, 200, 300, 800)], [np.polyfit(range(n), [x / 100 for x in (3, 1, 0, 2, 0, 0, 0, 0, 0)][:n], 1)[0] for n in (2, 3, 4, 9)])
    assert abs(r[0].low_share - 1 / 3) < 1e-9 and r[0].rate == 0.03 and r[0].spread == 2.25


def test_health_of_events(spark):
    got = catalog.QUERIES["str15_health"](spark, SF)
    assert {"longest_gap_us", "silent_us", "stalls", "lost", "backward", "trend", "rate", "spread"} <= set(got.columns) and got.where("stalls > 0").count()


def test_centroids_of_all_components_and_both_halves(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()
    ids, labels, v = (np.array([r[i] for r in rows], dtype=float if i == 2 else None) for i in range(3))
    want, names = {}, sorted(set(labels))
    for half in (0, 1):
        t = ids % 2 != half
        spread = 1.4826 * np.median(np.abs(v[t] - np.median(v[t], axis=0)), axis=0)
        d = np.array([(((v[~t] - np.median(v[t & (labels == k)], axis=0)) / spread) ** 2).sum(axis=1) for k in names if (t & (labels == k)).any()])
        want |= dict(zip(ids[~t].tolist(), np.array([k for k in names if (t & (labels == k)).any()])[d.round(9).argmin(axis=0)].tolist(), strict=True))
    assert {r[0]: r[1] for r in catalog.QUERIES["ml5_nearest_centroid"](spark, SF).select("vec_id", "predicted").collect()} == want


def test_gaps_are_those_of_all_frames(spark):
    """Every hour that has a frame has that hour's median, and real gaps of up to three hours are filled by lines."""
    hours = defaultdict(list)
    for r in frames(spark, SF).select("node", "us", "value").collect():
        hours[r.node, r.us // 3_600_000_000].append(r.value)
    got = {(r.node, r.bin): r.filled for r in catalog.QUERIES["win18_interp"](spark, SF).collect()}
    assert all(abs(got[k] - np.median(v)) < 1e-6 for k, v in hours.items())
    assert any(v is None for v in got.values()) and any(v is not None and k not in hours for k, v in got.items())


def test_lag_changes_of_every_receiver(spark):
    assert {r.rx for r in catalog.QUERIES["jn17_lag_join"](spark, SF).collect()} == {0, 1}


def test_cocluster_null_is_that_of_shuffled_rows(spark):
    """As shuffling rows does: a and b share a cluster, c is spread over all."""
    rows = [("a", 0)] * 18 + [("a", 1)] * 2 + [("b", 0)] * 9 + [("b", 2)] + [("c", i % 3) for i in range(60)]
    got = {(r.a, r.b): r for r in cluster.cocluster(spark.createDataFrame(rows, "label string, c bigint"), "label", "c").collect()}
    label, c = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    rng = np.random.default_rng(3)
    together = lambda x, k, l: float(np.mean(x[label == k][:, None] == x[label == l]))
    for (k, l), r in got.items():
        null = [together(rng.permutation(c), k, l) for _ in range(2000)]
        assert abs(r.together - together(c, k, l)) < 1e-9 and abs(r.expected - np.mean(null)) < 0.01
        assert abs(r.p - np.mean(np.array(null) >= together(c, k, l) - 1e-12)) < 0.04
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")} and got["a", "b"].p < 0.01 < got["a", "c"].p


def test_resampling_draws_as_often_as_the_reference(spark, monkeypatch):
    """A perfect rank correlation can show p of 1 in 20,001; k-means takes the best of many starts."""
    seen = {}
    monkeypatch.setattr(stats, "permutation_p", lambda *a, **k: seen.update(permutation=a[4]))
    monkeypatch.setattr(stats, "bootstrap_ci", lambda *a, **k: seen.update(bootstrap=k["draws"]))
    for name in ("stat2_permutation", "stat4_bootstrap"):
        catalog.QUERIES[name](spark, SF)
    assert seen["permutation"] == 20_000 and seen["bootstrap"] >= 2000


def test_kmeans_takes_the_best_start(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 2)) * 0.1 + np.array([(i % 8 * 3.0, i % 8 // 4) for i in range(120)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")

    def cost(restarts):
        label = np.array([r.cluster for r in cluster.kmeans(df, "v", 8, restarts=restarts).orderBy("i").collect()])
        return sum(((x[label == k] - x[label == k].mean(axis=0)) ** 2).sum() for k in set(label.tolist()))

    assert cost(5) <= min(cost(1), 4.0)


def test_streams_commit_on_time(spark, tmp_path):
    df = spark.range(50).selectExpr("id AS row_no", "CAST(id AS DOUBLE) AS value")
    df.write.parquet(str(tmp_path / "in"))
    q = streams.run_live(streams.landing(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "ck"), "1 second")
    q.processAllAvailable()
    df.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
