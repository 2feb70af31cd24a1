"""Frames survive damage and chunk borders; captures, covariates and stores read back what was written."""

import gzip

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sondera.operators import joins
from sondera.operators import windows as win
from sondera.operators.quantiles import exact_quantiles
from sondera.sources import capture, frames
from sondera.streaming import streams

from .conftest import rows_of


def _stream(n=20):
    rng = np.random.default_rng(1)
    out, want = b"", []
    for i in range(n):
        if i % 5 == 4:
            out += frames.encode_status(3, i, 1, 1, 1, 0, 0, i, 2, 3, 4, -95 * 256, -50 * 256)
            want.append("status")
        elif i % 5 == 3:
            out += frames.encode_probe(i, i)
            want.append("probe")
        else:
            v = rng.integers(-128, 127, 128)
            out += frames.encode_vector(i, bytes(range(6)), i, v, node=None if i % 2 else 7)
            want.append("vector")
    return out, want


def test_round_trip():
    raw, want = _stream()
    got = frames.decode(raw)
    assert [r["kind"] for r in got.rows] == want and not got.rest and not got.skipped
    assert got.rows[3]["pattern_ok"] and got.rows[4]["noise"] == -95.0 and got.rows[0]["node"] == 7 and got.rows[1].get("node") is None


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_damage_costs_only_the_damaged(data):
    raw, want = _stream(8)
    at = data.draw(st.integers(0, len(raw) - 1))
    bad = bytearray(raw)
    bad[at] ^= data.draw(st.integers(1, 255))
    got = frames.decode(bytes(bad) + b"\x00" * 600)
    assert len(got.rows) >= len(want) - 2


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes_decode(raw):
    got = frames.decode(raw)
    assert len(got.rest) <= len(raw)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 400), max_size=12))
def test_chunks_join(cuts):
    raw, want = _stream(8)
    rest, rows, at = b"", [], 0
    for c in [*cuts, len(raw)]:
        got = frames.decode(rest + raw[at : at + c])
        rest, at = got.rest, at + c
        rows += got.rows
    assert [r["kind"] for r in rows] == want


def test_files_and_chunks_on_spark(spark, tmp_path):
    raw, want = _stream()
    (tmp_path / "a.bin").write_bytes(b"boot text" + raw)
    got = frames.read_frames(spark, str(tmp_path))
    assert got.count() == len(want)
    parts = [("s", i, bytearray(raw[k : k + 97])) for i, k in enumerate(range(0, len(raw), 97))]
    chunks = spark.createDataFrame(parts, "stream string, i int, data binary")
    noise = bytes((frames.SYNC, frames.TYPED, 1, 0, 0, 0, 0, 0, 0))
    both = chunks.union(spark.createDataFrame([("t", 0, bytearray(noise + raw[:40])), ("t", 1, bytearray(raw[40:] + noise))], chunks.schema))
    assert [r["count"] for r in frames.decode_chunks(both, "stream", "i", "data").groupBy("stream").count().collect()] == [len(want)] * 2
    d = frames.decode_chunks(chunks, "stream", "i", "data").orderBy("offset").collect()
    assert [r.kind for r in d] == want and raw[d[1].offset] == frames.SYNC


HEADER = "pc_time_us,label,seq,mac,rssi,noise_floor,channel,esp_timestamp_us,len,csi_data"


def test_captures_of_both_ages(spark, tmp_path):
    vec = ",".join(["1"] * 128)
    (tmp_path / "old.csv").write_text(f'{HEADER}\n1,,1,aa:bb:cc:dd:ee:01,-50,-95,6,10,128,"{vec}"\nbroken\n')
    (tmp_path / "new.csv").write_text(f'{HEADER},node_id,env_id,dropped\n' + "".join(f'{5 + i},x,{i},a2:bb:cc:dd:ee:02,{-50 if i else -5},-95,6,10,128,"{vec}",3,0,9\n' for i in range(4)))
    rows = capture.read_capture(spark, str(tmp_path))
    assert rows.count() == 5 and capture.read_capture(spark, str(tmp_path), keep_bad=True).where("_bad is not null").count() == 1
    ok = capture.plausible(rows, capture.modes(rows))
    assert ok.where("plausible").count() == 4
    v = capture.with_vectors(rows, ["a2:bb:cc:dd:ee:02"]).select("csi").first()[0]
    assert len(v) == 128 and v[0] == 1
    assert capture.time_slice(rows, 0, 2e-6).count() == 3
    assert rows.select(capture.locally_administered(rows.mac).alias("l"), "mac").where("l").count() == 5
    assert rows.where(capture.valid_mac(rows.mac)).count() == 5


def test_hourly_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# source\n2026-01-01 1.5,-,@10=2.5\n\n")
    got = [(str(r.at), r.value) for r in capture.read_hourly(spark, str(tmp_path)).orderBy("at").collect()]
    assert got == [("2026-01-01 00:53:00", 1.5), ("2026-01-01 02:10:00", 2.5)]


def test_prefixed_json_manifest_and_results(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r.txt").write_text('text\nJSON {"tag": "a", "n": 2}\n')
    assert rows_of(capture.read_prefixed_json(spark, str(tmp_path / "in"), "tag string, n int")) == [("2", "a")]
    m = capture.manifest(spark, str(tmp_path / "in"))
    assert capture.to_do(m, m.limit(0)).count() == 1 and capture.to_do(m, m).count() == 0
    empty = spark.createDataFrame([], "a int")
    capture.write_results(empty, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).columns == ["a"]
    u = capture.union_rows([spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "c int, a int")])
    assert u.columns == ["a", "b", "c"] and u.count() == 2


def test_store_upserts(spark, tmp_path):
    s = capture.Store(spark, str(tmp_path / "store"))
    assert s.current("models") is None
    s.upsert("models", spark.createDataFrame([(1, "a"), (2, "b")], "id int, json string"), "id")
    s.upsert("models", spark.createDataFrame([(2, "c"), (3, "d")], "id int, json string"), "id")
    assert rows_of(s.current("models")) == [("1", "a"), ("2", "c"), ("3", "d")]
    s.append("obs", spark.createDataFrame([(1,)], "x int"))
    s.append("obs", spark.createDataFrame([(2,)], "x int"))
    assert s.read("obs").count() == 2


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    rows = [(i, i % 3, "a", i * 1_000_000, float(i * 7 % 11)) for i in range(100)]
    schema = "event_id long, user_id long, event_type string, us long, value double"
    df = spark.createDataFrame(rows, schema).selectExpr("event_id", "cast(timestamp_micros(us) as timestamp_ntz) as ts", "user_id", "event_type", "value")
    land = str(tmp_path / "land")
    df.where("event_id < 50").coalesce(1).write.parquet(land)
    stream = lambda: streams.live_windows(streams.frames_of(streams.landing(spark, land, df.schema)))
    args = str(tmp_path / "out"), str(tmp_path / "check")
    first = streams.run_to_end(stream(), *args).count()
    df.where("event_id >= 50").coalesce(1).write.mode("append").parquet(land)
    got = streams.run_to_end(stream(), *args)
    want = streams.batch_windows(streams.frames_of(df))
    assert 0 < first < got.count() and rows_of(got) == rows_of(want)


def test_windows_on_small_cases(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, None, None, 4.0, None])], "k string, i int, v double")
    assert [r.filled for r in win.fill_gaps(df, "k", "i", "v", 2).orderBy("i").collect()] == [1.0, 2.0, 3.0, 4.0, None]
    assert [r.filled for r in win.fill_gaps(df, "k", "i", "v", 1).orderBy("i").collect()] == [1.0, None, None, 4.0, None]
    wraps = spark.createDataFrame([("a", i, v) for i, v in enumerate([65000, 10, 20])], "k string, i int, c int")
    assert win.wrapped_total(wraps, "c", "k", "i").first().total == 556
    out = spark.createDataFrame([("a", i, v) for i, v in enumerate([10, 11, 5000, 12, 13, 65535])], "k string, i int, c int")
    assert [r.passes for r in win.circular_screen(out, "c", "k", "i").orderBy("i").collect()] == [True, True, False, True, True, True]
    empty = df.limit(0)
    assert win.count_windows(empty, "k", "i", 2, {"n": F.count("*")}).count() == 0


def test_as_of_takes_the_label_in_force(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 9, "z")], "k string, t int, id string")
    right = spark.createDataFrame([("a", 2, "p"), ("a", 5, "q"), ("b", 10, "r")], "k string, t int, v string")
    assert rows_of(joins.as_of(left, right, ["k"], "t", "v", "v"), ["id", "v"]) == [("x", "q"), ("y", "null"), ("z", "null")]
    assert rows_of(joins.as_of(left, right, ["k"], "t", "v", "v", forward=True), ["id", "v"]) == [("x", "q"), ("y", "p"), ("z", "r")]


def test_pairs_need_a_width(spark):
    s = spark.createDataFrame([("a", 0, 10), ("b", 5, 15), ("c", 14, 20)], "k string, lo int, hi int")
    assert rows_of(joins.overlaps(s, "k", "lo", "hi", 4, 2)) == [("a", "b", "5")]
    with pytest.raises(ValueError):
        from sondera.operators.cluster import linkage_of_cells

        linkage_of_cells(spark.range(3000).selectExpr("id as i_x", "1L as n", "1.0 as x"), ["x"], 2)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(np.round(x, 1)) if k else float(x)) for k in (0, 1, None) for x in rng.normal(0, 5, 700)] + [(2, 1.0)] * 500 + [(3, None), (4, 7.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    ps = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.n, r.q) for r in exact_quantiles(df, ["k"], "v", ps, buckets=8).collect()}
    for k in (0, 1, None, 2, 4):
        v = [x for i, x in rows if i == k and x is not None]
        assert got[k][0] == len(v) and np.allclose(got[k][1], np.quantile(v, ps), rtol=0, atol=1e-12)
    assert 3 not in got and exact_quantiles(df.limit(0), ["k"], "v", ps).count() == 0


def test_cache_follows_the_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"a": 1}\n')
    built = []

    def build(s, path):
        built.append(1)
        return capture.read_json(s, path, "a int")

    for want in (1, 1):
        assert capture.cached(spark, str(tmp_path / "in"), str(tmp_path / "cache"), build).count() == want
    (tmp_path / "in/b.json.gz").write_bytes(gzip.compress(b'{"a": 2}\n'))
    assert capture.cached(spark, str(tmp_path / "in"), str(tmp_path / "cache"), build).count() == 2 and len(built) == 2
    (tmp_path / "lib.json").write_text('{"name": "x",\n "template": [1.0, 2.0]}')
    assert capture.read_json(spark, str(tmp_path / "lib.json"), whole=True).first().template == [1.0, 2.0]


def test_streams_correct_and_gate(spark, tmp_path):
    w = spark.createDataFrame([("n", s, t, v) for t, s, v in [(1, "x", 5.0), (2, "ref", 1.0), (3, "x", 5.0), (4, "ref", 1.5), (5, "y", 2.0)]], "node string, source string, us long, med double")
    w.coalesce(1).write.parquet(str(tmp_path / "w"))
    got = streams.run_to_end(streams.live_reference(streams.landing(spark, str(tmp_path / "w"), w.schema), "ref"), str(tmp_path / "o"), str(tmp_path / "c"))
    c = {r.us: r.corrected for r in got.collect()}
    assert c[1] is None and c[2] == 0.0 and c[3] == 4.0 and 0 < c[4] < 0.5 and c[5] < 1.0
    f = spark.range(6).selectExpr("'n' AS node", "timestamp_seconds(id * 100) AS at", "id")
    s = spark.createDataFrame([("n", 150, 1), ("n", 10, 0)], "node string, t int, calibration int").selectExpr("node", "timestamp_seconds(t) AS at", "calibration")
    for df, name in ((f, "f"), (s, "s")):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    gate = streams.calibrated(streams.landing(spark, str(tmp_path / "f"), f.schema), streams.landing(spark, str(tmp_path / "s"), s.schema), valid="200 seconds")
    assert sorted(r.id for r in streams.run_to_end(gate, str(tmp_path / "go"), str(tmp_path / "gc")).collect()) == [2, 3]


def test_prefix_of_lines(spark, tmp_path):
    """Headers, quotes with commas before the vector, short and damaged lines, empty fields, folders that give columns."""
    (tmp_path / "in/session=7").mkdir(parents=True)
    lines = [",".join(capture.CAPTURE.names), '5,lab,1,aa:bb,-50,-90,6,77,128,"[1,2,3]",1,0,9', '6,"a, b",2,aa:bc,-51,-90,6,78,128,"[4,5]",1,0,9', "7,,3,aa:bd,-52,-90,6,79,128", "8,lab,x,aa:be,,-90", "bad", "", "9,lab,4,,-50"]
    (tmp_path / "in/session=7/x.csv").write_text("\n".join(lines))
    got = sorted(capture.read_prefix(spark, str(tmp_path / "in")).collect(), key=lambda r: r.pc_time_us)
    assert [(r.pc_time_us, r.label, r.seq, r.mac, r.rssi, r.len, r.session) for r in got] == [(5, "lab", 1, "aa:bb", -50, 128, 7), (6, "a, b", 2, "aa:bc", -51, 128, 7), (7, None, 3, "aa:bd", -52, 128, 7), (8, "lab", None, "aa:be", None, None, 7)]
    assert got[0].asDict().keys() == {*capture.CAPTURE.names[:9], "session"}
