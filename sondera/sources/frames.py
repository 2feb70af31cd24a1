"""Binary frame streams: framing, checksums, resynchronisation, and an encoder for fixtures.

A record is two magic bytes, a header of fixed layout, a payload and a byte that is the exclusive or of everything between.
A record that doesn't verify costs one byte, and the search goes on from the next; an unfinished record at the end is left over
for the next chunk. Layouts are data (KINDS), so that another record type is another entry.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

SYNC = 0xC5
#: Wire formats (fixed values): second magic byte → header after the magic, and where the payload's length stands.
PLAIN, TYPED, PROBE = 0x51, 0x52, 0x54
MAX_VECTOR, PREFIX, PROBE_PAYLOAD = 384, 15, 256
_PLAIN = struct.Struct("<I6sbbBIH")  # sequence, id, rssi, noise, channel, clock, length
_TYPED = struct.Struct("<BBHIH")  # type, node, environment, clock, length
_VECTOR = struct.Struct("<I6sbbBH")  # sequence, id, rssi, noise, channel, dropped
_STATUS = struct.Struct("<BBBHHIIIIhh")  # firmware, reset, calibration, crashes, calibration left, uptime, packets, dropped, heap, noise, rssi
_PROBE = struct.Struct("<BBII")  # type, firmware, sequence, clock
#: Bytes that a record has at most, and of a block that tasks decode by itself (a chunk more at most).
LONGEST, BLOCK = max(_PLAIN.size + MAX_VECTOR, _TYPED.size + PREFIX + MAX_VECTOR, _PROBE.size + PROBE_PAYLOAD) + 3, 1 << 18

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("kind", T.StringType()), ("offset", T.LongType()), ("node", T.IntegerType()), ("env", T.IntegerType()), ("seq", T.LongType()), ("id", T.StringType()), ("rssi", T.DoubleType()), ("noise", T.DoubleType()), ("channel", T.IntegerType()), ("clock_us", T.LongType()), ("dropped", T.IntegerType()),
    ("vector", T.ArrayType(T.IntegerType())), ("firmware", T.IntegerType()), ("reset", T.IntegerType()), ("calibration", T.IntegerType()), ("crashes", T.IntegerType()), ("calibration_left_s", T.IntegerType()), ("uptime_s", T.LongType()), ("packets", T.LongType()), ("drops", T.LongType()), ("heap", T.LongType()), ("pattern_ok", T.BooleanType()),
)])


@dataclass
class Decoded:
    rows: list[dict]
    rest: bytes
    skipped: int


def _id(raw: bytes) -> str:
    return raw.hex(":")


def _size(buf: bytes, at: int) -> int | None:
    """Bytes of the record at `at`: 0 if no record can begin there, None if more bytes are needed to tell."""
    if at + 2 > len(buf):
        return None
    kind = buf[at + 1]
    if kind == PROBE:
        return 2 + _PROBE.size + PROBE_PAYLOAD + 1
    head = {PLAIN: _PLAIN, TYPED: _TYPED}.get(kind)
    if head is None:
        return 0
    if at + 2 + head.size > len(buf):
        return None
    n = int.from_bytes(buf[at + head.size : at + 2 + head.size], "little")
    if not 0 < n <= MAX_VECTOR + (PREFIX if kind == TYPED else 0) or kind == TYPED and buf[at + 2] not in (1, 2):
        return 0
    return 2 + head.size + n + 1


def _row(raw: bytes) -> dict | None:
    kind, body = raw[1], raw[2:-1]
    if kind == PLAIN:
        seq, ident, rssi, noise, channel, clock, _ = _PLAIN.unpack_from(body)
        return {"kind": "vector", "seq": seq, "id": _id(ident), "rssi": float(rssi), "noise": float(noise), "channel": channel, "clock_us": clock, "vector": np.frombuffer(body, np.int8, offset=_PLAIN.size)}
    if kind == PROBE:
        typ, fw, seq, clock = _PROBE.unpack_from(body)
        want = (seq + 7 * np.arange(PROBE_PAYLOAD)) & 0xFF
        return {"kind": "probe" if typ == 1 else "probe_status", "firmware": fw, "seq": seq, "clock_us": clock, "pattern_ok": bool((np.frombuffer(body, np.uint8, offset=_PROBE.size) == want).all()) if typ == 1 else None} if typ in (1, 2) else None
    typ, node, env, clock, n = _TYPED.unpack_from(body)
    load = body[_TYPED.size :]
    if typ == 1 and n >= _VECTOR.size:
        seq, ident, rssi, noise, channel, dropped = _VECTOR.unpack_from(load)
        return {"kind": "vector", "node": node, "env": env, "seq": seq, "id": _id(ident), "rssi": float(rssi), "noise": float(noise), "channel": channel, "clock_us": clock, "dropped": dropped, "vector": np.frombuffer(load, np.int8, offset=_VECTOR.size)}
    if typ == 2 and n >= _STATUS.size:
        names = ("firmware", "reset", "calibration", "crashes", "calibration_left_s", "uptime_s", "packets", "drops", "heap", "noise", "rssi")
        row = dict(zip(names, _STATUS.unpack_from(load), strict=True))
        return {"kind": "status", "node": node, "env": env, "clock_us": clock} | row | {"noise": row["noise"] / 256.0, "rssi": row["rssi"] / 256.0}
    return None


def _take(buf: bytes, at: int, final: bool = False) -> tuple[int, dict | None] | None:
    """Where the search goes on from `at`, and the record that is there; None if more bytes are needed to tell."""
    size = _size(buf, at)
    if size is None or size and at + size > len(buf):
        if not final:
            return None
        size = 0
    raw = buf[at : at + size] if size else b""
    row = _row(raw) if size and not int(np.bitwise_xor.reduce(np.frombuffer(raw, np.uint8, offset=2))) else None
    return (at + 1, None) if row is None else (at + size, row)


def decode(buf: bytes, base: int = 0, final: bool = False) -> Decoded:
    """All records of a buffer, and the bytes at its end that may begin another; final: none will come, so those are searched as well."""
    got = _search(buf, base, final)
    for r in got.rows:
        if "vector" in r:
            r["vector"] = r["vector"].tolist()
    return got


def _search(buf: bytes, base: int, final: bool = False) -> Decoded:
    """decode() with vectors as arrays."""
    rows, at, skipped = [], 0, 0
    while True:
        nxt = buf.find(SYNC, at)
        if nxt < 0:
            return Decoded(rows, b"", skipped + len(buf) - at)
        skipped += nxt - at
        got = _take(buf, nxt, final)
        if got is None:
            return Decoded(rows, buf[nxt:], skipped)
        at, row = got
        if row is None:
            skipped += 1
        else:
            rows.append(row | {"offset": base + nxt})


def stops(buf: bytes) -> list[int]:
    """Where the search stops for more bytes at the end of a block, for each of the first LONGEST places where it may begin; one number if all stop there.

    A search from anywhere comes by one of any LONGEST places in a row, so the last of a block will do if all of them lead to one stop.
    """
    back = 4 * LONGEST
    while True:
        first, known = max(len(buf) - back, 0), {}
        for start in range(first, first + LONGEST):
            path, at = [], start
            while at not in known:
                path.append(at)
                nxt = buf.find(SYNC, at)
                got = _take(buf, nxt) if nxt == at else (nxt, None)
                if nxt < 0 or got is None:
                    known[at] = len(buf) if nxt < 0 else at
                    break
                at = got[0]
            known |= dict.fromkeys(path, known[at])
        out = [known[start] for start in range(first, first + LONGEST)]
        if len(set(out)) == 1:
            return out[:1]
        if not first:
            return out
        back *= 4


def carry(rest: bytes, size: int, head: bytes, tail: bytes, stop: list[int]) -> bytes:
    """What no record has taken at the end of a block, from what was left before it, the block's LONGEST first and last bytes and its stops."""
    buf, at = rest + head, 0
    if size <= LONGEST:  # all of it is in its head
        return _search(buf, 0).rest
    while at < len(rest):
        nxt = buf.find(SYNC, at, len(rest))
        at = len(rest) if nxt < 0 else _take(buf, nxt)[0]
    return tail[stop[0 if len(stop) == 1 else at - len(rest)] - size + len(tail) :]


def encode(kind: int, body: bytes) -> bytes:
    return bytes((SYNC, kind)) + body + bytes((int(np.bitwise_xor.reduce(np.frombuffer(body, np.uint8))),))


def encode_vector(seq: int, ident: bytes, clock: int, vector: np.ndarray, node: int | None = None, rssi: int = -50, noise: int = -95, channel: int = 6, dropped: int = 0, env: int = 0) -> bytes:
    raw = np.asarray(vector, dtype=np.int8).tobytes()
    if node is None:
        return encode(PLAIN, _PLAIN.pack(seq, ident, rssi, noise, channel, clock, len(raw)) + raw)
    return encode(TYPED, _TYPED.pack(1, node, env, clock, _VECTOR.size + len(raw)) + _VECTOR.pack(seq, ident, rssi, noise, channel, dropped) + raw)


def encode_status(node: int, clock: int, *values: int, env: int = 0) -> bytes:
    return encode(TYPED, _TYPED.pack(2, node, env, clock, _STATUS.size) + _STATUS.pack(*values))


def encode_probe(seq: int, clock: int, firmware: int = 1) -> bytes:
    return encode(PROBE, _PROBE.pack(1, firmware, seq, clock) + ((seq + 7 * np.arange(PROBE_PAYLOAD)) & 0xFF).astype(np.uint8).tobytes())


def _table(rows: list[dict]) -> pd.DataFrame:
    """Rows under SCHEMA; what a kind of record doesn't have is null."""
    return pd.DataFrame([[r.get(c) for c in SCHEMA.names] for r in rows], columns=SCHEMA.names, dtype=object)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.field("element", pa.int32()))}


def _batch(name: pa.Array, rows: list[dict]) -> pa.RecordBatch:
    """Rows of _search() under SCHEMA behind their stream's name, an array of one."""
    columns = [name.take(pa.array(np.zeros(len(rows), np.int32)))]
    for f in SCHEMA:
        values, kind = [r.get(f.name) for r in rows], _ARROW[f.dataType.simpleString()]
        if f.name == "vector":
            ends = np.cumsum([0, *[0 if v is None else len(v) for v in values]], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.int8), *[v for v in values if v is not None]]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), type=kind, mask=pa.array([v is None for v in values], pa.bool_())))
        else:
            columns.append(pa.array(values, kind))
    return pa.RecordBatch.from_arrays(columns, ["stream", *SCHEMA.names])


def _blocks(chunks: DataFrame, path: str) -> DataFrame:
    """Streams in blocks of some BLOCK bytes, written below path: (stream, place, size, head, tail, stops, data). Places are in a stream's order."""
    src = chunks.where(F.length("data") > 0).repartitionByRange("stream", "__order").sortWithinPartitions("stream", "__order").select("stream", "data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, place, last, parts, size = ["stream", "place", "size", "head", "tail", "stops", "data"], TaskContext.get().partitionId() << 32, None, [], 0

        def block() -> tuple:
            data = b"".join(parts)
            return last, place, size, data[:LONGEST], data[-LONGEST:], stops(data) if size > LONGEST else [], data

        for b in batches:
            out = []
            for name, x in zip(b["stream"], b["data"], strict=True):
                if parts and (name != last or size >= BLOCK):
                    out.append(block())
                    place, parts, size = place + 1, [], 0
                last, size = name, size + len(x)
                parts.append(bytes(x))
            yield pd.DataFrame(out, columns=names)
        if parts:
            yield pd.DataFrame([block()], columns=names)

    kind = chunks.schema["stream"].dataType.simpleString()
    blocks = src.mapInPandas(run, f"stream {kind}, place bigint, size bigint, head binary, tail binary, stops array<int>, data binary")
    blocks.write.option("parquet.block.size", 1 << 24).parquet(path)
    return chunks.sparkSession.read.parquet(path)


def decode_chunks(chunks: DataFrame, stream: str, order: str, data: str) -> DataFrame:
    """(stream, SCHEMA) from chunks of byte streams, the stream's column under the name `stream`.

    Tasks take ranges of (stream, order), so a long stream is in several of them. A record may span chunks and blocks, and where the
    search enters a block depends on all before it: each block says where it stops for each place where it may be entered, and a walk
    over a stream's blocks, without their data, then gives each the bytes that the one before it left. Rows are those of one search over the whole stream.
    """
    spark, path = chunks.sparkSession, scratch(chunks.sparkSession, "blocks")
    blocks = _blocks(chunks.select(F.col(stream).alias("stream"), F.col(order).alias("__order"), F.col(data).alias("data")), f"{path}/blocks")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out, rest, base = [], b"", 0
        for place, size, head, tail, stop in pdf.sort_values("place")[["place", "size", "head", "tail", "stops"]].itertuples(index=False):
            out.append((place, base - len(rest), rest, False))
            rest, base = carry(rest, size, bytes(head), bytes(tail), stop), base + size
        out[-1] = (*out[-1][:3], True)
        return pd.DataFrame(out, columns=["place", "base", "rest", "final"])

    blocks.drop("data").groupBy("stream").applyInPandas(walk, "place bigint, base bigint, rest binary, final boolean").write.parquet(f"{path}/entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (x, rest, base, final) in enumerate(zip(*[b.column(c).to_pylist() for c in ("data", "rest", "base", "final")], strict=True)):
                yield _batch(b.column("stream").slice(i, 1), _search(rest + x, base, final).rows)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMA)
    entered = blocks.select("place", "stream", "data").join(spark.read.parquet(f"{path}/entries"), "place")
    return entered.select("stream", "data", "rest", "base", "final").mapInArrow(run, f"stream {blocks.schema['stream'].dataType.simpleString()}, {fields}")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file, SCHEMA) of recorded byte streams, a task for each file."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                out = _table(decode(bytes(content), final=True).rows)
                out.insert(0, "file", file)
                yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMA)
    return files.mapInPandas(run, f"file string, {fields}")
