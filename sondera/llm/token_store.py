"""Token ids as blocks of a static range asymmetric numeral system (rANS).

One frequency table serves all blocks. It is counted over the whole corpus. A block holds whole documents in ascending
id order and is coded by interleaved lanes: token i goes to lane ``i mod lanes``, all lanes share one stream of
32-bit words. A block decodes without any other one; inside it, checkpoints (lane states and a place in the words)
let the spans between them be decoded side by side. A CRC-32 guards each block.

A store is a folder: ``blocks`` (Parquet; a row is a block with the ids and lengths of its documents) and
``table`` (the frequencies). Spark's commit protocol writes both, so a lost executor leaves no torn block.

Defined cases: a null text is empty and holds the end id alone; strings of special tokens inside a text become these tokens, as in the
library; null document ids come first; rows with one id follow each other in the order of a hash of their text; an empty table gives an empty store; extra columns are ignored; a text
of any length lies in one block, which is then longer than the others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import keep
from .bpe import GROUP, encoder

BITS = 20
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAGIC = b"RANS"
HEAD = struct.Struct("<4sBBHIQQQI")  # magic, version, bits, lanes, steps between checkpoints, tokens, words, checkpoints, crc of the rest
#: Tokens after which a block is closed; lanes of a full block; steps between checkpoints.
BLOCK_TOKENS, LANES, STEPS = 1 << 18, 1024, 128
#: Tokens of a partition of the store, about.
PART_TOKENS = 8_000_000


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to a sum of 2**bits; what occurs keeps at least 1."""
    counts = np.asarray(counts, dtype=np.int64)
    seen = np.flatnonzero(counts)
    if len(seen) > 1 << bits:
        raise ValueError("more symbols than the table has room for")
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(seen):
        return out
    share = counts[seen].astype(np.float64) / counts.sum()
    f = np.maximum(1, np.floor(share * (1 << bits)).astype(np.int64))
    order = np.lexsort((seen, -f))
    rest = (1 << bits) - int(f.sum())
    if rest > 0:
        f[order[0]] += rest
    while rest < 0:
        spare = f[order] - 1
        take = np.minimum(spare, np.maximum(1, (-rest * f[order]) // (1 << bits)))
        take = np.where(np.cumsum(take) <= -rest, take, 0)
        if not take.any():
            take[0] = min(int(spare[0]), -rest)
        f[order] -= take
        rest += int(take.sum())
    out[seen] = f
    return out


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits = bits
        self.freq = np.asarray(freq, dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    def encode(self, tokens: np.ndarray, lanes: int | None = None, every: int = STEPS) -> bytes:
        n = len(tokens)
        lanes = lanes or max(1, min(LANES, 1 << max(0, (n // 64).bit_length() - 1)))
        f = self.freq[tokens]
        if n and not f.all():
            raise ValueError("a token has no frequency")
        c, top, bits = self.start[tokens], f << np.uint64(63 - self.bits), np.uint64(self.bits)
        x = np.full(lanes, LOW, dtype=np.uint64)
        steps = -(-n // lanes)
        out: list[np.ndarray] = []
        marks, written = [], 0
        for s in range(steps - 1, -1, -1):
            a, b = s * lanes, min(n, (s + 1) * lanes)
            y, fs = x[: b - a], f[a:b]
            full = y >= top[a:b]
            if full.any():
                words = y[full]
                out.append(words.astype(np.uint32))
                written += len(words)
                y[full] = words >> WORD
            q = y // fs
            x[: b - a] = (q << bits) + (y - q * fs) + c[a:b]
            if s % every == 0:
                marks.append((written, x.copy()))
        marks.reverse()
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        places = np.array([written - w for w, _ in marks], dtype="<u8")
        states = np.array([m for _, m in marks], dtype="<u8").reshape(-1)
        body = places.tobytes() + states.tobytes() + words.astype("<u4").tobytes()
        return HEAD.pack(MAGIC, 1, self.bits, lanes, every, n, len(words), len(marks), zlib.crc32(body)) + body

    def decode(self, block: bytes) -> np.ndarray:
        """All spans between checkpoints advance together, a step of all their lanes at a time."""
        magic, version, bits, lanes, every, n, n_words, n_marks, crc = HEAD.unpack_from(block)
        body = memoryview(block)[HEAD.size :]
        if magic != MAGIC or version != 1 or bits != self.bits:
            raise ValueError("not a block of this coder")
        if zlib.crc32(body) != crc:
            raise ValueError("a block's checksum differs")
        at = np.frombuffer(body, "<u8", n_marks).astype(np.int64)
        x = np.frombuffer(body, "<u8", n_marks * lanes, 8 * n_marks).astype(np.uint64).reshape(n_marks, lanes)
        words = np.frombuffer(body, "<u4", n_words, 8 * n_marks * (lanes + 1)).astype(np.uint64)
        out = np.empty((n_marks, every, lanes), dtype=np.uint32)
        low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
        steps = -(-n // lanes)
        last = steps - (n_marks - 1) * every  # of the last span
        for s in range(min(every, steps)):
            m = n_marks if s < last else n_marks - 1
            y = x[:m]
            slot = y & low
            sym = self.symbol[slot]
            out[:m, s] = sym
            z = self.freq[sym] * (y >> shift) + slot - self.start[sym]
            if m == n_marks and s == last - 1 and n % lanes:
                z[-1, n % lanes :] = y[-1, n % lanes :]  # these lanes have no token in the last step
            need = z < LOW
            if need.any():
                each = need.sum(axis=1)
                where = np.repeat(at[:m] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(int(each.sum()))
                z[need] = (z[need] << WORD) | words[where]
                at[:m] += each
            x[:m] = z
        return out.reshape(-1, lanes)[:steps].reshape(-1)[:n] if n else np.zeros(0, np.uint32)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie side by side in data, one up to each of `ends` (in items)."""
    offsets = np.concatenate([[0], ends]) * data.itemsize
    kind = pa.binary() if offsets[-1] < 1 << 31 else pa.large_binary()
    out = pa.Array.from_buffers(kind, len(ends), [None, pa.py_buffer(offsets.astype("<i4" if kind == pa.binary() else "<i8")), pa.py_buffer(np.ascontiguousarray(data))])
    return out.cast(pa.binary()) if kind != pa.binary() else out


def _items(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(data, ends) of _binary()."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "<i4", len(column) + 1, 4 * column.offset).astype(np.int64)
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, kind, (at[-1] - at[0]) // size, at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, kind), (at[1:] - at[0]) // size


def token_table(docs: DataFrame, path: str, end_id: int | None = None, drops_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, tie, counts binary) of each row: ids as little-endian integers of 16 bits, where the vocabulary allows, or 32.

    A task adds one row without ids, whose counts say how often each id (32 bits) came (64 bits): pairs, zlib-packed.
    """
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))
    size = encoder(path, drops_space, True).tokenizer.get_vocab_size(with_added_tokens=True)
    kind = "<u4" if size > 1 << 16 else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, drops_space, True)
        total, id_kind = np.zeros(size, dtype=np.int64), None
        for b in batches:
            id_kind = b.schema.field(0).type
            for i in range(0, b.num_rows, GROUP):
                part = b.slice(i, GROUP)
                ids, ends = enc.flat([t or "" for t in part.column(1).to_pylist()])
                if end_id is not None:
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                total += np.bincount(ids, minlength=size)
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "ids": _binary(ids.astype(kind), ends), "tie": part.column(2), "counts": pa.nulls(len(ends), pa.binary())})
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_pydict({id_col: pa.nulls(1, id_kind), "ids": pa.nulls(1, pa.binary()), "tie": pa.nulls(1, pa.int64()), "counts": pa.array([zlib.compress(seen.astype("<u4").tobytes() + total[seen].astype("<i8").tobytes(), 1)], pa.binary())})

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids binary, tie bigint, counts binary")


def write_store(tokens: DataFrame, path: str, vocab_size: int, id_col: str = "doc_id") -> None:
    """Write a token_table() as a store. vocab_size bounds what is counted and sent around: one number for each id."""
    spark, kind = tokens.sparkSession, "<u4" if vocab_size > 1 << 16 else "<u2"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab_size, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                raw = zlib.decompress(x)
                ids = np.frombuffer(raw, "<u4", len(raw) // 12)
                total[ids] += np.frombuffer(raw, "<i8", len(ids), 4 * len(ids))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int32()), "n": pa.array(total[ids], pa.int64())})

    counts = np.zeros(vocab_size, dtype=np.int64)
    for r in tokens.where("counts is not null").select("counts").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most vocab_size rows
        counts[r.id] = r.n
    freq = frequencies(counts)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    parts = max(spark.sparkContext.defaultParallelism, int(counts.sum()) // PART_TOKENS + 1)
    id_type = tokens.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(freq), TaskContext.get().partitionId()
        names: list[pa.Array] = []
        raw: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        size = done = number = 0

        def close() -> pa.RecordBatch:
            nonlocal names, raw, lens, size, done, number
            tokens = np.concatenate(raw)
            ids = pa.concat_arrays(names)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([number], pa.int32()), "before": pa.array([done], pa.int64()), "tokens": pa.array([len(tokens)], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "lens": pa.array([np.concatenate(lens)], pa.list_(pa.int64())), "payload": pa.array([coder.encode(tokens)], pa.binary())})
            names, raw, lens, size, done, number = [], [], [], 0, done + len(tokens), number + 1
            return out

        for b in batches:
            data, ends = _items(b.column(1), kind)
            at, row = 0, 0
            while row < len(ends):
                # up to the document that fills the block
                to = min(int(np.searchsorted(ends, at + BLOCK_TOKENS - size)) + 1, len(ends))
                raw.append(data[at : ends[to - 1]].copy())
                names.append(b.column(0).slice(row, to - row))
                lens.append(np.diff(ends[row:to], prepend=at))
                size += int(ends[to - 1]) - at
                at, row = int(ends[to - 1]), to
                if size >= BLOCK_TOKENS:
                    yield close()
        if names:
            yield close()

    (tokens.where("ids is not null").select(id_col, "ids", "tie").repartitionByRange(parts, id_col, "tie").sortWithinPartitions(id_col, "tie").select(id_col, "ids")
        .mapInArrow(blocks, f"part int, block int, before bigint, tokens bigint, ids array<{id_type}>, lens array<bigint>, payload binary")
        .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))


def _coder(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/table").collect()  # as many rows as the vocabulary has ids in use
    freq = np.zeros(max((r.id for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        freq[r.id] = r.freq
    return freq


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id", digests: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids array<int>) of each document; digests: ids_crc32 instead of ids. start counts all tokens before it."""
    freq = _coder(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.max(F.col("before") + F.col("tokens")).alias("tokens"))  # a row for each partition of the store
    total = 0
    firsts: dict[int, int] = {}
    for r in parts.orderBy("part").collect():
        firsts[r.part], total = total, total + r.tokens
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            for k in range(b.num_rows):
                part, before = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                lens = np.asarray(b.column(3)[k].values, dtype=np.int64)
                tokens = coder.decode(b.column(4)[k].as_buffer())
                ends = np.cumsum(lens)
                starts = ends - lens
                cols = {id_col: b.column(2)[k].values, "start": pa.array(starts + (firsts[part] + before), pa.int64()), "n_tokens": pa.array(lens, pa.int64())}
                if digests:
                    raw = memoryview(tokens.astype("<u4").tobytes())
                    cols["ids_crc32"] = pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return blocks.select("part", "before", "ids", "lens", "payload").mapInArrow(run, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, " + ("ids_crc32 bigint" if digests else "ids array<int>"))


def store_texts(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, drops_space: bool = True) -> None:
    """Encode all texts and write them as a store; the ids are kept once, so that texts are encoded once."""
    size = encoder(tokenizer, drops_space, True).tokenizer.get_vocab_size(with_added_tokens=True)
    write_store(keep(token_table(docs, tokenizer, end_id, drops_space), "tokens", texts=True), path, size)
