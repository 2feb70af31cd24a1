"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level one and reads a space and the text; B is a piece model that adds the space itself. The ends of both tokens,
as byte offsets, cut a text into elementary intervals (union1d); searchsorted gives the owners of each in A and in B, and each interval
is one overlap: one link. Where both end, a group closes. All texts of a block are laid end to end, so this is a few array operations for
thousands of texts. A text is cut at single spaces and its pieces are looked up (bpe.PieceEncoder), for both tokenizers alike.

Corpus counts of id pairs are Spark aggregations over what each block has added up. A block, a megabyte of text or one longer text, asks
for the counts of its own pairs by a join, and what comes back for it is at most as large as its links. So nothing is broadcast
or collected, and no link moves by itself.

Defined cases: texts that are null, empty, or whose bytes one of the tokenizers doesn't give back (U+2581 inside) have no tokens: zeros and an empty
digest; strings of special tokens are plain text; repeated rows and ids are rows of their own and count again; an empty table gives an
empty result; only the id and text columns are read; a text of any length is one row of one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .base import keep

#: Texts and bytes of a block; the text that fills it is its last.
BLOCK_TEXTS, BLOCK_BYTES = 4096, 1 << 20
_SPACE = "▁"


class _Whole:
    """A model that encodes a text at once, as the parent's tokenizer does."""

    def __init__(self, model):
        self.model = model

    def encode(self, text: str, add_special_tokens: bool = False) -> SimpleNamespace:
        return SimpleNamespace(ids=self.model.encode(text.removeprefix(" "), num_threads=1))


class SentencePieces(bpe.PieceEncoder):
    """Ids of a sentencepiece model for texts that begin with the space which the model adds by itself.

    No piece of the model has a space but at its front (checked), so the cuts at single spaces hold for it as well.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokenizer, self.drops_space = _Whole(self.model), False
        self.table, self.long = bpe.PieceTable(bpe.MEMO_PIECES), {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece goes on after a space; texts can't be cut at spaces")
        self.begins = np.array([p.startswith(_SPACE) for p in pieces])
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]

    def _plain(self, text: str) -> bytes | None:
        return None if _SPACE in text else text.encode()  # its space would join one in the text

    def _new(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """As in the parent. A piece of a word and its space begins with the only token that has a space, so many go through the model as one line."""
        simple = [p for p in new if p[:1] == " " and len(p) > 1 and p.count(" ") == 1]
        plain = set(simple)
        done, ids, sizes = [], [], []
        parts = [simple[i : i + bpe.LINE_PIECES] for i in range(0, len(simple), bpe.LINE_PIECES)]
        for ps, got in zip(parts, self.model.encode(["".join(x)[1:] for x in parts], num_threads=1) if parts else [], strict=True):
            got = np.array(got, dtype=np.uint32)
            at = np.flatnonzero(self.begins[got])
            if len(at) != len(ps) or at[0]:
                raise RuntimeError("ids of joined pieces don't part as the pieces do")
            done += ps
            ids.append(got)
            sizes.append(np.diff(np.append(at, len(got))))
        rest = [p for p in new if p not in plain]
        for p, got in zip(rest, self.model.encode([p.removeprefix(" ") for p in rest], num_threads=1) if rest else [], strict=True):
            done.append(p)
            ids.append(np.array(got, dtype=np.uint32))
            sizes.append(np.array([len(got)]))
        return done, np.concatenate(ids), np.concatenate(sizes)


@dataclass
class Tokenizers:
    """Both encoders of a process, the bytes of their tokens, and their ids as they stand in a line of groups."""

    path_a: str
    path_b: str

    def __post_init__(self) -> None:
        self.a, self.b = bpe.encoder(self.path_a), SentencePieces(self.path_b)
        self.bytes = (bpe.ByteDecoder(self.path_a).table, self.b.bytes_of)
        self.lengths = tuple(np.array([len(x) for x in t], dtype=np.int64) for t in self.bytes)
        self.said = [f"{i}{end}" for t, ends in zip(self.bytes, (",|", ",;"), strict=True) for i in range(len(t)) for end in ends]


_BOTH: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _BOTH:
        _BOTH[path_a, path_b] = Tokenizers(path_a, path_b)
    return _BOTH[path_a, path_b]


@dataclass
class Block:
    """Alignment of some texts, laid end to end. Counts are by text; a, b: ids; group_a, group_b: the group of each; of: the text of each link; link_a, link_b: places in a and b."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _union1d(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """np.union1d of two sorted arrays, which a stable sort merges; the library hashes them."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both


def align(texts: list[str], t: Tokenizers) -> Block:
    spaced = [" " + x if x else "" for x in texts]
    raw = [x.encode() for x in spaced]
    ids, size, good = [], [], np.ones(len(texts), dtype=bool)
    for enc, table in zip((t.a, t.b), t.bytes, strict=True):
        flat, ends = enc.flat(spaced)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
        listed = flat.tolist()
        good &= np.array([b"".join(map(table.__getitem__, listed[i:j])) == r for i, j, r in zip(begins.tolist(), ends.tolist(), raw, strict=True)], dtype=bool)
        ids.append(flat.astype(np.int64))
        size.append((ends - begins).astype(np.int64))
    a, b = (x[np.repeat(good, n)] for x, n in zip(ids, size, strict=True))
    n_a, n_b = (np.where(good, n, 0) for n in size)
    text_ends = np.cumsum(np.where(good, [len(r) for r in raw], 0)).astype(np.int64)
    end_a, end_b = np.cumsum(t.lengths[0][a]), np.cumsum(t.lengths[1][b])
    ends = _union1d(end_a, end_b)
    at_a, at_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
    shared = np.zeros(len(ends), dtype=np.int64)
    shared[at_a] += 1
    shared[at_b] += 1
    shared = shared == 2
    group = np.cumsum(shared) - shared  # groups closed before each interval
    of = np.searchsorted(text_ends, ends)
    return Block(n_a, n_b, np.bincount(of[shared], minlength=len(texts)), a, b, group[at_a], group[at_b], ends, of, np.searchsorted(end_a, ends), np.searchsorted(end_b, ends))


def lines(k: Block, t: Tokenizers) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each text: the ids of its groups."""
    last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
    codes = np.empty(len(k.a) + len(k.b), dtype=np.int64)
    codes[np.arange(len(k.a)) + np.searchsorted(k.group_b, k.group_a, "left")] = 2 * k.a + last(k.group_a)
    codes[np.arange(len(k.b)) + np.searchsorted(k.group_a, k.group_b, "right")] = 2 * (len(t.bytes[0]) + k.b) + last(k.group_b)
    stops = np.cumsum(k.n_a + k.n_b).tolist()
    listed = codes.tolist()
    return ["".join(map(t.said.__getitem__, listed[i:j]))[:-1] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(ids, texts) of rows (id, text) in a row, cut into blocks."""
    for b in batches:
        text = b.column(1)
        total = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
        i = 0
        while i < b.num_rows:
            full = int(np.searchsorted(total, (total[i - 1] if i else 0) + BLOCK_BYTES)) + 1
            j = min(b.num_rows, i + BLOCK_TEXTS, full)
            yield b.column(0).slice(i, j - i), [x or "" for x in text.slice(i, j - i).to_pylist()]
            i = j


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups array<struct<start, end, a, b>>) of each text: byte offsets in a space and the text, and the ids of both sides, in order."""
    src = _source(docs, id_col, text_col)
    kind = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, groups array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        for ids, texts in blocks(batches):
            k = align(texts, t)
            n = int(k.n_groups.sum())
            cut = [np.searchsorted(g, np.arange(n + 1)) for g in (k.group_a, k.group_b)]
            end = np.cumsum(t.lengths[0][k.a])[cut[0][1:] - 1] if n else np.zeros(0, np.int64)
            begin = np.concatenate([[0], end[:-1]]) if n else end
            first = np.cumsum(k.n_groups) - k.n_groups
            shift = np.repeat(begin[np.minimum(first, n - 1)] if n else np.zeros(len(first), np.int64), k.n_groups)
            lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(x, pa.int32())) for c, x in zip(cut, (k.a, k.b), strict=True)]
            parts = pa.StructArray.from_arrays([pa.array(begin - shift, pa.int64()), pa.array(end - shift, pa.int64()), *lists], ["start", "end", "a", "b"])
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.append(first, n), pa.int32()), parts)], names=["doc_id", "groups"])

    return src.mapInArrow(run, kind)


def group_products(found: DataFrame) -> DataFrame:
    """(doc_id, place, a, b) of groups(): each pair of an A and a B id of one group."""
    one = found.select("doc_id", F.posexplode("groups").alias("place", "g"))
    return one.select("doc_id", "place", F.explode("g.a").alias("a"), F.col("g.b").alias("b")).select("doc_id", "place", "a", F.explode("b").alias("b"))


def _linked(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row of each text (place >= 0) and one of each block (place -1), with the distinct id pairs of its links and how often each comes."""
    src = _source(docs, id_col, text_col)
    t = tokenizers(path_a, path_b)
    across = len(t.bytes[1])
    small = len(t.bytes[0]) * across < 1 << 31
    pair = pa.int32() if small else pa.int64()
    kind = f"block bigint, place int, doc_id {src.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<{'int' if small else 'bigint'}>, times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for ids, texts in blocks(batches):
            k, m = align(texts, t), len(texts)
            key, times = np.unique(k.of * (len(t.bytes[0]) * across) + k.a[k.link_a] * across + k.b[k.link_b], return_counts=True)
            of, pairs = np.divmod(key, len(t.bytes[0]) * across)
            own, where = np.unique(pairs, return_inverse=True)
            cuts = np.concatenate([np.searchsorted(of, np.arange(m + 1)), [len(pairs) + len(own)]])
            sha = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in lines(k, t)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m + 1, number), pa.int64()), pa.array(np.append(np.arange(m), -1), pa.int32()), pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
                    *[pa.array(np.append(x, 0), pa.int64()) for x in (k.n_a, k.n_b, k.n_groups, np.bincount(k.of, minlength=m))], pa.array([*sha, ""], pa.string()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.append(pairs, own), pair)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.append(times, np.bincount(where, times, len(own)).astype(np.int64)), pa.int32())),
                ],
                names=["block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )
            number += 1

    return src.mapInArrow(run, kind)


def _best(counts: DataFrame, across: int) -> DataFrame:
    """(pair, count, best) of (pair, count): best where no pair of the same B id has a higher count."""
    b = F.pmod(F.col("pair"), F.lit(across))
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return counts.withColumn("b", b).join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, count, best) of each id pair that is linked anywhere in the corpus."""
    across = len(tokenizers(path_a, path_b).bytes[1])
    used = _linked(docs, path_a, path_b, id_col, text_col).where("place < 0").select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counts = used.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    return _best(counts, across).select(F.floor(F.col("pair") / across).cast("int").alias("a"), F.pmod("pair", F.lit(across)).cast("int").alias("b"), "count", "best")


def digests(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text: its tokens, groups and links, how many links are their B id's most frequent ones, the sum of their counts, and the digest of its groups."""
    across = len(tokenizers(path_a, path_b).bytes[1])
    linked = keep(_linked(docs, path_a, path_b, id_col, text_col), "linked")
    used = linked.where("place < 0").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("block", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    counts = keep(used.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    asked = used.select(F.col("block").alias("at"), "pair").join(_best(counts, across), "pair")
    texts = linked.where("place >= 0")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in names[1:-1]) + ", groups_sha256 string"

    def run(own: pa.Table, all_: pa.Table) -> pa.Table:
        own, all_ = own.combine_chunks(), all_.sort_by("pair")
        pair, count, best = (all_.column(c).to_numpy() for c in ("pair", "count", "best"))
        lists, times = (own.column(c).combine_chunks() for c in ("pairs", "times"))
        ends = np.cumsum(np.concatenate([[0], pc.list_value_length(lists).to_numpy()])).astype(np.int64)
        at, n = np.searchsorted(pair, lists.flatten().to_numpy()), times.flatten().to_numpy().astype(np.int64)
        sums = [np.diff(np.concatenate([[0], np.cumsum(n * x[at] if len(at) else n)])[ends]) for x in (best.astype(np.int64), count)]
        cols = [own.column(c) for c in names[:5]] + [pa.array(x, pa.int64()) for x in sums] + [own.column("groups_sha256")]
        return pa.Table.from_arrays(cols, names=names)

    return texts.groupBy("block").cogroup(asked.groupBy("at")).applyInArrow(run, kind)
