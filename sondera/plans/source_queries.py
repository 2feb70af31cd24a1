"""Sources and sinks: captures, frame streams and small files are written from the driver tables into the shared folder and read back, each with SQL over the tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import arr_sum, r6
from ..operators import windows as win
from ..session import frames, scratch, table
from ..sources import capture
from ..sources import frames as binary
from .catalog import register
from .frame_queries import HOUR, ORDER, _sql

#: Damaged lines that a capture has among the good ones.
DAMAGED = ["1,broken", "not a number,,,,", ""]
_MAC = "format('02:00:00:00:{:02x}:{:02x}', source // 256 % 256, source % 256)"
#: Sources of an allow-list.
ALLOWED = [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]


def _mac(source: Column) -> Column:
    return F.format_string("02:00:00:00:%02x:%02x", F.floor(source / 256) % 256, source % 256)


def _own_mac(source: Column) -> Column:
    """An id for each source below 2^40: `_mac` repeats itself after 65,536 sources."""
    return F.regexp_replace(F.format_string("02%010x", source), "(..)(?!$)", "$1:")


def _fields(mac=_mac) -> list[Column]:
    """A capture's fields from a frame. A vector is 128 multiples of the row's number, modulo 100."""
    k = F.col("row_no") % 97
    csi = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda j: (k * j % 100).cast("string")), ",")
    fields = {"pc_time_us": "us", "label": F.lit("x"), "seq": "row_no", "mac": mac(F.col("source")), "rssi": (-30 - F.col("source") % 80).cast("short"), "noise_floor": F.lit(-95).cast("short"), "channel": F.when(F.col("row_no") % 50 == 0, 11).otherwise(6).cast("short"), "esp_timestamp_us": F.col("us") % (1 << 32), "len": F.lit(128), "csi_data": csi, "node_id": (F.length("session") % 7).cast("short"), "env_id": F.lit(0), "dropped": (F.col("row_no") % 65536).cast("int")}
    return [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()]


def _captures(spark, sf_dir, old: tuple[str, ...] = (), mac=_mac) -> str:
    """A folder of captures of `events`, one (session) for each node in order of time, some with the old header, and a file of damaged lines."""
    path, fields = scratch(spark, "captures"), _fields(mac)
    rows = frames(spark, sf_dir).select(F.col("node").alias("session"), "source", "us", "row_no")
    is_old = F.col("session").isin(*old) if old else F.lit(False)
    capture.write_captures(rows.where(~is_old), f"{path}/age=new", "session", ORDER, fields)
    if old:
        capture.write_captures(rows.where(is_old), f"{path}/age=old", "session", ORDER, fields[: len(capture.OLD)])
    header = ",".join([*capture.OLD, "node_id", "env_id", "dropped"])
    lines = spark.createDataFrame([("\n".join([header, *DAMAGED]),)], "value string").coalesce(1)
    lines.write.text(f"{path}/age=damaged/session=damaged")
    return path


@register(_sql(f"SELECT node AS session, row_no AS seq, us AS pc_time_us, {_MAC} AS mac, CAST(-30 - source % 80 AS SMALLINT) AS rssi, CAST(row_no % 65536 AS INTEGER) AS dropped FROM fr"))
def src1_capture_scan(spark, sf_dir):
    """All rows of all captures; lines that don't parse are passed over."""
    return capture.read_capture(spark, _captures(spark, sf_dir)).select("session", "seq", "pc_time_us", "mac", "rssi", "dropped")


@register(_sql(f"SELECT row_no AS seq, {_MAC} AS mac, 128 AS size, list_sum(list_transform(range(1, 129), lambda j: row_no % 97 * j % 100)) AS total FROM fr WHERE source IN ({', '.join(map(str, ALLOWED))})"))
def src2_allowed_vectors(spark, sf_dir):
    """Vectors of an allow-list of sources: others aren't parsed."""
    macs = [f"02:00:00:00:{s // 256 % 256:02x}:{s % 256:02x}" for s in ALLOWED]
    v = capture.with_vectors(capture.read_capture(spark, _captures(spark, sf_dir, mac=_own_mac)), macs)
    return v.select("seq", "mac", F.size("csi").alias("size"), arr_sum(F.transform("csi", lambda x: x.cast("bigint"))).cast("bigint").alias("total"))


@register(_sql(f"SELECT node AS session, {_MAC} AS mac, count(*) AS n, round(avg(-30 - source % 80), 6) + 0.0 AS rssi FROM fr GROUP BY 1, 2"))
def src3_prefix_scan(spark, sf_dir):
    """A census from the first fields of each line; the vectors stay unread."""
    rows = capture.read_prefix(spark, _captures(spark, sf_dir))
    return rows.groupBy("session", "mac").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rssi")).alias("rssi"))


@register(_sql("SELECT node AS session, count(*) AS n, count(*) FILTER (WHERE node NOT IN ('click', 'view')) AS with_node, CAST(sum(CASE WHEN node NOT IN ('click', 'view') THEN row_no % 65536 END) AS BIGINT) AS dropped FROM fr GROUP BY node"))
def src4_two_ages(spark, sf_dir):
    """Captures of ten and of thirteen columns side by side; what the old ones don't have is null."""
    rows = capture.read_capture(spark, _captures(spark, sf_dir, ("click", "view")))
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count("node_id").alias("with_node"), F.sum("dropped").alias("dropped"))


def _byte_chunks(spark, sf_dir, encode, size: int = 1000) -> DataFrame:
    """(node, i, data): frames of each node as one recorded stream of bytes in order, cut where `size` bytes are full, whatever lies there.

    Tasks take ranges of a stream, so the last chunk of a range may be shorter; numbers rise along a stream.
    """
    path = scratch(spark, "chunks")
    f = frames(spark, sf_dir).select("node", F.lit(1).alias("frame"), "us", "row_no", "source")
    boot = f.select("node").distinct().select("node", F.lit(0).alias("frame"), *[F.lit(0).cast("bigint").alias(c) for c in ("us", "row_no", "source")])
    by = ["node", "frame", *ORDER]
    src = f.unionByName(boot).repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, buf, i = None, b"", TaskContext.get().partitionId() << 32
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.node != last:
                    if buf:
                        out.append((last, i, buf))
                    last, buf, i = r.node, b"", i + 1
                buf += encode(r) if r.frame else b"boot"
                while len(buf) >= size:
                    out.append((last, i, buf[:size]))
                    buf, i = buf[size:], i + 1
            yield pd.DataFrame(out, columns=["node", "i", "data"])
        if buf:
            yield pd.DataFrame([(last, i, buf)], columns=["node", "i", "data"])

    src.mapInPandas(run, "node string, i bigint, data binary").write.parquet(path)
    return spark.read.parquet(path)


def _ident(source: int) -> bytes:
    return bytes((2, 0, 0, 0, source // 256 % 256, source % 256))


def _values(row_no: int) -> np.ndarray:
    return (row_no % 97 * np.arange(1, 129)) % 100 - 50


_FRAMES = "SELECT node, row_no AS seq, {mac} AS id, us % 4294967296 AS clock_us, CAST(list_sum(list_transform(range(1, 129), lambda j: row_no % 97 * j % 100 - 50)) AS BIGINT) AS total{more} FROM fr"


def _decoded(spark, sf_dir, encode) -> DataFrame:
    return binary.decode_chunks(_byte_chunks(spark, sf_dir, encode), "node", "i", "data")


def _summed(d: DataFrame, *more: str) -> DataFrame:
    return d.where("kind = 'vector'").select(F.col("node").alias("node"), "seq", "id", "clock_us", arr_sum(F.transform("vector", lambda x: x.cast("bigint"))).cast("bigint").alias("total"), *more)


@register(_sql(_FRAMES.format(mac=_MAC, more=", CAST(row_no % 65536 AS INTEGER) AS dropped")))
def src5_frames(spark, sf_dir):
    """Typed records out of streams of bytes that are cut anywhere; after each tenth record come bytes that only look like one, of a type that isn't or with a check that fails, which the search passes."""
    no_type = bytes((binary.SYNC, binary.TYPED, 9)) + b"\x00" * 5 + bytes((binary.SYNC,))
    no_check = bytes((binary.SYNC, binary.TYPED, 1)) + b"\x00" * 7 + b"\x01\x00" + b"\x00" + b"\x55"

    def encode(r):
        good = binary.encode_vector(r.row_no, _ident(r.source), r.us % (1 << 32), _values(r.row_no), node=1, dropped=r.row_no % 65536)
        return good + (b"" if r.row_no % 10 else no_type if r.row_no % 20 else no_check)

    d = _decoded(spark, sf_dir, encode).withColumnRenamed("node", "unit").withColumnRenamed("stream", "node")
    return _summed(d, "dropped")


@register(_sql("SELECT node, row_no AS seq, us % 4294967296 AS clock_us, true AS pattern_ok FROM fr"))
def src6_probe(spark, sf_dir):
    """Records of the throughput probe, each checked against the pattern that its number asks for."""
    d = _decoded(spark, sf_dir, lambda r: binary.encode_probe(r.row_no, r.us % (1 << 32)))
    return d.where("kind = 'probe'").select(F.col("stream").alias("node"), "seq", "clock_us", "pattern_ok")


@register(_sql(_FRAMES.format(mac=_MAC, more="")))
def src7_plain_frames(spark, sf_dir):
    """Records of the older layout, which names no unit."""
    d = _decoded(spark, sf_dir, lambda r: binary.encode_vector(r.row_no, _ident(r.source), r.us % (1 << 32), _values(r.row_no)))
    return _summed(d.drop("node").withColumnRenamed("stream", "node"))


@register(_sql("SELECT node AS session, row_no AS seq, row_number() OVER w AS place, us - lag(us) OVER w AS gap_us FROM fr WINDOW w AS (PARTITION BY node ORDER BY us, row_no)"))
def src9_replay(spark, sf_dir):
    """Rows in their place in each capture, with the gap to the row before; a capture begins without one."""
    rows = capture.read_capture(spark, _captures(spark, sf_dir)).select("session", "file", "row_no", "seq", "pc_time_us")
    return capture.replay(rows, "session").select("session", "seq", "place", "gap_us")


@register(_sql("SELECT node AS session, count(*) AS rows, sum(row_no) AS total FROM fr GROUP BY node"))
def src10_tiles(spark, sf_dir):
    """Sums of each capture from sums of its tiles; half of the tiles were done before, and only the others are asked again."""
    rows = capture.read_capture(spark, _captures(spark, sf_dir))
    tiles = capture.by_tile(rows, ["session"], {"rows": F.count(F.lit(1)), "total": F.sum("seq")})
    done = tiles.where(F.pmod(F.xxhash64("file", "tile"), F.lit(2)) == 0)
    rest = capture.by_tile(capture.without_tiles(rows, done), ["session"], {"rows": F.count(F.lit(1)), "total": F.sum("seq")})
    return done.unionByName(rest).groupBy("session").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))


@register(_sql("SELECT node AS session, row_no AS seq FROM (SELECT *, us - min(us) OVER (PARTITION BY node) AS t FROM fr) WHERE t >= 86400000000 AND t < 864000000000"))
def src11_time_slice(spark, sf_dir):
    """The second to the tenth day of each capture."""
    rows = capture.read_capture(spark, _captures(spark, sf_dir)).withColumn("file", F.col("session"))
    return capture.time_slice(rows, 86_400, 864_000).select("session", "seq")


@register(_sql("SELECT node AS session, min(us) AS first_us, max(us) AS last_us, count(*) AS rows FROM fr GROUP BY node"))
def src12_spans(spark, sf_dir):
    rows = capture.read_capture(spark, _captures(spark, sf_dir)).withColumn("file", F.col("session"))
    return capture.spans(rows).withColumnRenamed("file", "session")


@register(_sql("SELECT node AS session, CAST(length(node) % 7 AS SMALLINT) AS node_id, CAST(channel AS SMALLINT) AS channel FROM (SELECT node, CASE WHEN row_no % 50 = 0 THEN 11 ELSE 6 END AS channel, count(*) AS n FROM fr GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, channel) = 1"))
def src13_modes(spark, sf_dir):
    """Node and channel of each capture, by what its head mostly says."""
    rows = capture.read_capture(spark, _captures(spark, sf_dir)).withColumn("part", F.col("file")).withColumn("file", F.col("session"))
    return capture.modes(rows, order=["part", "row_no"]).withColumnRenamed("file", "session")


@register(_sql("SELECT source, count(*) AS n, max(us) AS last_us, CASE WHEN max(us) > (SELECT median(us) FROM fr) THEN 2 ELSE 1 END AS version FROM fr WHERE us > (SELECT median(us) FROM fr) OR source NOT IN (SELECT source FROM fr WHERE us > (SELECT median(us) FROM fr)) GROUP BY source"))
def src14_store(spark, sf_dir):
    """Models of sources in a store, from the earlier half of time and then the later one: the last version of each counts."""
    f = frames(spark, sf_dir)
    mid = f.agg(F.median("us").alias("mid"))
    halves = f.crossJoin(F.broadcast(mid)).withColumn("late", F.col("us") > F.col("mid"))  # one row
    store = capture.Store(spark, scratch(spark, "store"))
    for version, late in ((1, False), (2, True)):
        store.upsert("models", halves.where(F.col("late") == late).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us")).withColumn("version", F.lit(version)), "source")
    return store.current("models")


_CENSUS = "SELECT node, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM fr GROUP BY node"


def _census(spark, sf_dir) -> DataFrame:
    return frames(spark, sf_dir).groupBy("node").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))


@register(_sql("SELECT node AS session, count(*) AS n FROM fr GROUP BY node"))
def src16_cached(spark, sf_dir):
    """A result that is kept under its files' names, sizes and times: the second call reads what the first one wrote."""
    path, root = _captures(spark, sf_dir), scratch(spark, "cache")
    build = lambda s, p: capture.read_capture(s, p).groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    capture.cached(spark, f"{path}/*/*/*", root, lambda s, p: build(s, path))
    return capture.cached(spark, f"{path}/*/*/*", root, lambda s, p: build(s, path).where("false"))


@register(_sql(_CENSUS))
def src17_gzip_json(spark, sf_dir):
    path = scratch(spark, "json")
    capture.write_results(_census(spark, sf_dir), path, "json")
    return capture.read_json(spark, path, "node string, n bigint, mean double")


@register(_sql("SELECT source, count(*) AS n, max(us) AS last_us FROM fr GROUP BY source"))
def src18_prefixed_json(spark, sf_dir):
    """Records among other lines of a log: those that begin with a prefix."""
    path = scratch(spark, "log")
    g = frames(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"))
    g.select(F.concat(F.lit("source done\nJSON "), F.to_json(F.struct("source", "n", "last_us"))).alias("value")).write.text(path)
    return capture.read_prefixed_json(spark, path, "source bigint, n bigint, last_us bigint")


@register(_sql("SELECT node, make_timestamp(bin * 3600000000 + CASE WHEN bin % 24 = 5 THEN 600000000 ELSE 3180000000 END) AS at, round(v + 1e-9, 3) AS value FROM (SELECT node, us // 3600000000 AS bin, avg(value) AS v FROM fr GROUP BY 1, 2)"))
def src19_hourly(spark, sf_dir):
    """Hourly means as compact lines, a day each, and back: `-` is an hour without one, and the sixth hour names a minute of its own."""
    path = scratch(spark, "hourly")
    h = win.time_bins(frames(spark, sf_dir), "node", "us", HOUR, {"v": F.avg("value")}).select("node", F.floor(F.col("bin") / 24).alias("day"), (F.col("bin") % 24).cast("int").alias("hour"), F.round(F.col("v") + 1e-9, 3).cast("string").alias("v"))  # so that a tie goes up whatever the order of a sum
    slot = lambda i: F.coalesce(F.element_at("m", i), F.lit("-"))
    d = h.groupBy("node", "day").agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("m"))  # 24 entries at most
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.when((i == 5) & F.map_contains_key("m", i), F.concat(F.lit("@10="), slot(i))).otherwise(F.when(F.map_contains_key("m", i), slot(i)).otherwise("-"))), ",")
    d.select("node", F.concat_ws(" ", F.date_format(F.date_from_unix_date(F.col("day").cast("int")), "yyyy-MM-dd"), line).alias("value")).write.partitionBy("node").text(path)
    return capture.read_hourly(spark, path, extra=["node"]).select("node", F.col("at").cast("timestamp_ntz").alias("at"), "value")


@register("SELECT label AS name, 64 AS size, round(list_sum(list_transform(t, lambda x: round(x, 6))), 5) + 0.0 AS total FROM (SELECT label, list(m ORDER BY j) AS t FROM (SELECT label, j, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, j) GROUP BY label)")
def src20_templates(spark, sf_dir):
    """A library of templates, one document over several lines in each file."""
    path = scratch(spark, "templates")
    m = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("j", "x")).groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("m"))
    t = m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda s: F.round(s["m"], 6)).alias("template"))  # an entry for each place
    text = F.regexp_replace(F.to_json(F.struct(F.col("label").alias("name"), "template")), ",", ",\n ")
    t.select(text.alias("value"), F.col("label").alias("part")).repartition("part").write.partitionBy("part").text(path)
    lib = capture.read_json(spark, f"{path}/*", "name bigint, template array<double>", whole=True)
    return lib.select("name", F.size("template").alias("size"), (F.round(arr_sum(F.col("template")), 5) + 0.0).alias("total"))


@register(_sql("SELECT node AS session, count(*) AS n, CAST(sum(row_no) AS BIGINT) AS seq, CAST(sum(us % 4294967296) AS BIGINT) AS clock, CAST(sum(list_sum(list_transform(range(1, 129), lambda j: row_no % 97 * j % 100))) AS BIGINT) AS csi FROM fr GROUP BY node"))
def snk1_captures(spark, sf_dir):
    """Captures written and read back: nothing of a row is lost."""
    rows = capture.with_vectors(capture.read_capture(spark, _captures(spark, sf_dir)))
    return rows.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seq"), F.sum("esp_timestamp_us").alias("clock"), F.sum(arr_sum(F.transform("csi", lambda x: x.cast("bigint"))).cast("bigint")).alias("csi"))


@register(_sql("SELECT node AS name, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, NULL::BIGINT AS last_us FROM fr GROUP BY node UNION ALL SELECT CAST(source AS VARCHAR), count(*), NULL, max(us) FROM fr GROUP BY source"))
def snk2_union_csv(spark, sf_dir):
    """Results with different columns in one table under the union of their headers."""
    path = scratch(spark, "results")
    by_source = frames(spark, sf_dir).groupBy(F.col("source").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("us").alias("last_us"))
    capture.write_results(capture.union_rows([_census(spark, sf_dir).withColumnRenamed("node", "name"), by_source]), path, "csv")
    return spark.read.option("header", True).schema("name string, n bigint, mean double, last_us bigint").csv(path)


@register(_sql("SELECT node AS session, count(*) AS n, count(DISTINCT source) AS sources FROM fr GROUP BY node UNION ALL SELECT 'empty', 0, 0"))
def snk3_parquet_results(spark, sf_dir):
    """A result for each capture, written by itself; one has no rows and still has its schema."""
    path, rows = scratch(spark, "results"), capture.read_capture(spark, _captures(spark, sf_dir, mac=_own_mac)).select("session", "mac")
    capture.write_results(rows, f"{path}/all", partition="session")
    capture.write_results(rows.limit(0).drop("session"), f"{path}/empty")
    empty = spark.read.parquet(f"{path}/empty").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mac").alias("sources")).select(F.lit("empty").alias("session"), "n", "sources")
    return spark.read.parquet(f"{path}/all").groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mac").alias("sources")).unionByName(empty)


@register(_sql("SELECT node AS session, count(*) AS rows, CAST(ceil(count(*) / 500.0) AS BIGINT) AS files FROM fr GROUP BY node"))
def snk5_chunks(spark, sf_dir):
    """Results in files of at most 500 rows, which appear together when all are done."""
    path = scratch(spark, "chunks")
    rows = frames(spark, sf_dir).select(F.col("node").alias("session"), "row_no", "value").repartition("session")
    capture.write_results(rows, path, partition="session", maxRecordsPerFile="500")
    back = spark.read.parquet(path).select("session", F.col("_metadata.file_path").alias("file"))
    return back.groupBy("session").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("file").alias("files"))


@register(_sql("SELECT node AS session FROM fr GROUP BY node HAVING length(node) % 2 = 1"))
def snk7_to_do(spark, sf_dir):
    """Captures that a job still has to see, when those with an even name are done and a damaged one is left out."""
    files = capture.manifest(spark, f"{_captures(spark, sf_dir)}/*/*/*.csv").withColumn("session", F.regexp_extract("path", "session=([^/]+)", 1))
    done = files.where(F.length("session") % 2 == 0).drop("session")
    return capture.to_do(files, done).select("session").distinct()
