"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

A text is cut at single spaces between two non-space characters; no pre-token of a byte-level (or a
white-space dropping) tokenizer crosses such a cut, so the ids of the pieces, joined, are the ids of the text.
Pieces repeat (natural text is Zipfian), so each Python worker remembers the ids of a bounded number of them and
hands only unseen ones to the library, in batches. Cutting, looking up and joining are array operations over the UTF-8 bytes of a
batch: a piece of up to 23 bytes is its own key in a table of three 64-bit numbers (its bytes and its length, so keys are exact).

Defined cases: null text is an empty text (no ids, no bytes); an empty table gives an empty result; repeated rows
give repeated rows; strings of special tokens inside a text are ordinary text; extra columns are ignored
(only the id and text columns are read). A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Pieces that a worker remembers at most: the first ones, among them the frequent ones; and the bytes of longer ones that it remembers.
MEMO_PIECES, MEMO_BYTES = 1 << 19, 256
#: Bytes of a piece that is its own key.
KEY_BYTES = 23
#: Stands between pieces in a line where white space is dropped; a pre-token of its own with one id.
MARK = "\x00"
#: Pieces that are joined to one line.
LINE_PIECES = 256
#: Texts that go through the library together.
GROUP = 512

#: White space beyond ASCII (Unicode White_Space); a text that has some is encoded whole.
_WIDE_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters that are one pre-token together, and stay letters in lower case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Classes of bytes: white space to the library; and with the controls that only Python takes for it, which makes fewer cuts.
_DROPPED = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_NO_CUT = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
#: A mark right after a letter begins a pre-token, so a piece may begin there; letters of two bytes are 0xC3 and one of these.
_IS_MARK = np.isin(np.arange(256), list(b".,!?;:"))
_IS_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_SECOND = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
_KEEP_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


class PieceTable:
    """Ids of pieces by their keys: open addressing, for whole arrays of keys at once."""

    def __init__(self, room: int):
        self.room, self.n = room, 0
        self.shift = np.uint64(64 - max(4, (2 * room - 1).bit_length()))
        slots = 1 << (64 - int(self.shift))
        self.keys = np.zeros((3, slots), dtype=np.uint64)
        self.entry = np.full(slots, -1, dtype=np.int32)
        self.start, self.ids = np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype=np.uint32)

    def _first(self, k: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (k[0] ^ k[1] * np.uint64(0x9E3779B97F4A7C15) ^ k[2] * np.uint64(0xD1342543DE82EF95)) * np.uint64(0xBF58476D1CE4E5B9)
            return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> self.shift).astype(np.int64)

    def find(self, k: np.ndarray) -> np.ndarray:
        """Entries of keys (3, n); -1 for unknown ones."""
        slot = self._first(k)
        out = self.entry[slot].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & ((self.keys[0][slot] != k[0]) | (self.keys[1][slot] != k[1]) | (self.keys[2][slot] != k[2])))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) % len(self.entry)
            out[todo] = self.entry[slot]
            more = (out[todo] >= 0) & (self.keys[:, slot] != k[:, todo]).any(0)
            todo, slot = todo[more], slot[more]
        return out

    def put(self, k: np.ndarray, entries: np.ndarray) -> None:
        """Enter distinct unknown keys."""
        slot, todo = self._first(k), np.arange(len(entries))
        while len(todo):
            free = self.entry[slot] < 0
            at = todo[free]
            self.entry[slot[free]] = entries[at]  # of several the last one stays
            won = at[self.entry[slot[free]] == entries[at]]
            self.keys[:, slot[free][self.entry[slot[free]] == entries[at]]] = k[:, won]
            rest = np.ones(len(entries), dtype=bool)
            rest[won] = False
            keep = rest[todo]
            todo, slot = todo[keep], (slot[keep] + 1) % len(self.entry)

    def append(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries for new ids, so many each; those from `room` on last until forget()."""
        n = len(size)
        if self.n + n + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(n, len(self.start)) + 1, dtype=np.int64)])
        first = int(self.start[self.n])
        self.start[self.n + 1 : self.n + n + 1] = first + np.cumsum(size)
        last = int(self.start[self.n + n])
        if last > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(last - len(self.ids), len(self.ids)), dtype=np.uint32)])
        self.ids[first:last] = ids
        self.n += n
        return np.arange(self.n - n, self.n)

    def forget(self) -> None:
        self.n = min(self.n, self.room)

    def join(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the entries in a row, where each one's end)."""
        size = self.start[entry + 1] - self.start[entry]
        ends = np.cumsum(size)
        at = np.repeat(self.start[entry] - (ends - size), size)
        at += np.arange(len(at))
        return self.ids[at], ends


class PieceEncoder:
    """Encodes texts to ids through a tokenizers file. drops_space: the tokenizer loses white space between words.

    specials: strings of special tokens inside a text become these tokens, as the library has it by itself; a text that has such a
    string is encoded whole. Without, they are ordinary text.
    """

    def __init__(self, path: str, drops_space: bool = False, specials: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.drops_space = drops_space
        self.table = PieceTable(MEMO_PIECES)
        self.long: dict[bytes, int] = {}
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if specials else []
        self.special = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else None
        begin = os.path.commonprefix(added)
        self.mark_of_special = begin if begin.lower() == begin.upper() else ""
        if drops_space:
            upper, lower = self.tokenizer.encode_batch(["AZ ÀÞ", "az àþ"], add_special_tokens=False)
            self.lowers = upper.ids == lower.ids
            suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
            self.closes = None
            if suffix:  # a piece of letters is one pre-token, and its last id closes it
                vocab = self.tokenizer.get_vocab(with_added_tokens=True)
                self.closes = np.zeros(max(vocab.values()) + 1, dtype=bool)
                self.closes[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
            (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        else:
            self.lengths = ByteDecoder(path).lengths

    def _plain(self, text: str) -> bytes | None:
        """The bytes that are cut into pieces; None for a text that has to be encoded whole."""
        if self.special is not None and self.mark_of_special in text and self.special(text):
            return None
        if text.isascii():
            return (text.lower() if self.drops_space and self.lowers else text).encode()
        if _WIDE_WHITE.search(text):
            return None
        if self.drops_space and self.lowers:
            try:
                text.encode("latin-1")  # lower case is plain there, so it may come first
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.encode()

    def _cut(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of pieces in the bytes of texts, which lie from begins to ends with a line feed between them and around all."""
        if self.drops_space:
            white = _DROPPED[raw]
            after = np.zeros(len(raw), dtype=bool)  # right after a letter
            after[1:] = _IS_LETTER[raw[:-1]]
            after[2:] |= _SECOND[raw[1:-1]] & (raw[:-2] == 0xC3)
            cut = _IS_MARK[raw] & after
            start = ~white
            start[1:] &= white[:-1] | cut[1:]
            end = ~white
            end[:-1] &= white[1:] | cut[1:]
            return np.flatnonzero(start), np.flatnonzero(end) + 1
        white = _NO_CUT[raw]
        cut = raw == 32
        cut[1:-1] &= ~white[:-2] & ~white[2:]
        cut[[0, -1]] = False
        cut[begins[ends > begins]] = True
        starts = np.flatnonzero(cut)
        of = np.searchsorted(begins, starts, side="right") - 1
        # of texts that begin at one place only the last can have bytes
        stops = ends[of]
        stops[:-1] = np.minimum(stops[:-1], starts[1:])
        return starts, stops

    def _new(self, new: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(pieces in another order, their ids in a row, how many each has). Most are joined to lines, as the library takes long texts at less cost; the ids that close a word, a mark between the pieces or their bytes part the ids again."""
        kinds: dict[str, list[str]] = {}
        if self.drops_space:
            plain = _LETTERS.fullmatch if self.closes is not None else lambda p: None
            for p in new:
                kinds.setdefault(" " if plain(p) else "alone" if MARK in p else f" {MARK} ", []).append(p)
        else:
            for p in new:
                kinds.setdefault("" if p[0] == " " and len(p) > 1 and not p[1].isspace() and not p[-1].isspace() else "alone", []).append(p)
        alone = kinds.pop("alone", [])
        done, ids, sizes = [], [], []
        for gap, joins in kinds.items():
            for i in range(0, len(joins), LINE_PIECES * 64):
                parts = [joins[j : j + LINE_PIECES] for j in range(i, min(len(joins), i + LINE_PIECES * 64), LINE_PIECES)]
                for ps, e in zip(parts, self.tokenizer.encode_batch_fast([gap.join(x) for x in parts], add_special_tokens=False), strict=True):
                    got = np.array(e.ids, dtype=np.uint32)
                    if gap == " ":
                        ends = np.flatnonzero(self.closes[got]) + 1
                    elif gap:
                        marks = np.flatnonzero(got == self.mark)
                        got, ends = np.delete(got, marks), np.append(marks - np.arange(len(marks)), len(got) - len(marks))
                    else:
                        ends = np.searchsorted(np.cumsum(self.lengths[got]), np.cumsum([len(p.encode()) for p in ps])) + 1
                    if len(ends) != len(ps) or ends[-1] != len(got):
                        raise RuntimeError("ids of joined pieces don't part as the pieces do")
                    done += ps
                    ids.append(got)
                    sizes.append(np.diff(ends, prepend=0))
        for i in range(0, len(alone), 4096):
            part = alone[i : i + 4096]
            got = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            done += part
            ids += got
            sizes.append(np.array([len(x) for x in got]))
        return done, np.concatenate(ids), np.concatenate(sizes)

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts in a row, as unsigned 32-bit integers, and where each one's end."""
        plain = [self._plain(t) for t in texts]
        size = np.fromiter((len(p) if p is not None else 0 for p in plain), dtype=np.int64, count=len(plain))
        raw = b"\n" + b"\n".join([p or b"" for p in plain]) + b"\n"
        begins = 1 + np.concatenate([[0], np.cumsum(size[:-1] + 1)]) if len(size) else np.zeros(0, np.int64)
        starts, stops = self._cut(np.frombuffer(raw, np.uint8), begins, begins + size)
        entry = self._entries(raw, starts, stops)
        ids, ends = self.table.join(entry)
        upto = np.searchsorted(starts, begins + size)  # pieces of texts up to each one
        ends = np.concatenate([[0], ends])[upto]
        self.table.forget()
        if any(p is None for p in plain):
            parts = np.split(ids, ends[:-1])
            for i, p in enumerate(plain):
                if p is None:
                    parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return ids, ends

    def _entries(self, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The table's entry of each piece of raw; unseen ones go through the library."""
        size = stops - starts
        entry = np.full(len(starts), -1, dtype=np.int64)
        short = np.flatnonzero(size <= KEY_BYTES)
        eight = np.ndarray(len(raw) + 17, dtype="<u8", buffer=raw + bytes(24), strides=(1,))  # the eight bytes from each place on
        a, n = starts[short], size[short]
        keys = np.stack([eight[a + 8 * i] & _KEEP_BYTES[np.clip(n - 8 * i, 0, 8)] for i in range(3)])
        keys[2] |= n.astype(np.uint64) << np.uint64(56)
        entry[short] = self.table.find(keys)
        for i in np.flatnonzero(size > KEY_BYTES).tolist():
            entry[i] = self.long.get(raw[starts[i] : stops[i]], -1)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            pieces = [raw[x:y] for x, y in zip(starts[miss].tolist(), stops[miss].tolist(), strict=True)]
            first = {p: i for i, p in reversed(list(enumerate(pieces)))}
            done, ids, sizes = self._new([p.decode() for p in first])
            done = [p.encode() for p in done]
            numbers = self.table.append(ids, sizes)
            number = dict(zip(done, numbers.tolist(), strict=True))
            entry[miss] = [number[p] for p in pieces]
            kept = done[: max(0, self.table.room - int(numbers[0]))]
            self.long.update((p, number[p]) for p in kept if KEY_BYTES < len(p) <= MEMO_BYTES)
            which = miss[[first[p] for p in kept if len(p) <= KEY_BYTES]] if kept else miss[:0]
            self.table.put(keys[:, np.searchsorted(short, which)], entry[which])
        return entry

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers."""
        ids, ends = self.flat(texts)
        return np.split(ids, ends[:-1]) if texts else []


_ENCODERS: dict[tuple[str, bool, bool], PieceEncoder] = {}


def encoder(path: str, drops_space: bool = False, specials: bool = False) -> PieceEncoder:
    """This process's encoder; a reused Python worker keeps what it remembers."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    if (path, drops_space, specials) not in _ENCODERS:
        _ENCODERS[path, drops_space, specials] = PieceEncoder(path, drops_space, specials)
    return _ENCODERS[path, drops_space, specials]


def byte_alphabet() -> dict[str, int]:
    """Character that stands for a byte in a byte-level vocabulary → the byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteDecoder:
    """ids → bytes → text. Bytes of one character may lie in several tokens: bytes are joined before they are decoded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        alphabet = byte_alphabet()
        vocab = t.get_vocab(with_added_tokens=True)
        self.table: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.table], dtype=np.int64)

    def bytes(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def text(self, ids: list[int]) -> str:
        return self.bytes(ids).decode("utf-8", errors="replace")

    def stream(self, parts: Iterator[list[int]]) -> Iterator[str]:
        """Decode id lists as they come; a character that a cut splits is held back until its last byte is there."""
        decode = codecs.getincrementaldecoder("utf-8")(errors="replace").decode
        for ids in parts:
            yield decode(self.bytes(ids))
        yield decode(b"", True)

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """Characters [start, end) that each token touches; tokens that share a split character share it here too."""
        if not len(ids):
            return [], []
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.lengths[np.asarray(ids)])
        start = end - self.lengths[np.asarray(ids)]
        return char[start].tolist(), (char[end - 1] + 1).tolist()


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """(id_col, ids array<int>[, starts array<int>, ends array<int>]) of every row; starts and ends count characters."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path), ByteDecoder(path) if offsets else None
        for b in batches:
            for i in range(0, b.num_rows, GROUP):
                part = b.slice(i, GROUP)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = enc.encode(texts)
                cols = {id_col: part.column(0), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))}
                if dec:
                    spans = [dec.offsets(t, x) for t, x in zip(texts, ids, strict=True)]
                    cols |= {"starts": pa.array([s for s, _ in spans], pa.list_(pa.int32())), "ends": pa.array([e for _, e in spans], pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict(cols)

    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else ""))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, raw binary, text string) from id lists; null ids give empty bytes, bytes that are no UTF-8 show as U+FFFD."""
    src = df.select(F.col(id_col), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = ByteDecoder(path)
        for b in batches:
            raw = [dec.bytes(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "raw": pa.array(raw, pa.binary()), "text": pa.array([x.decode("utf-8", errors="replace") for x in raw], pa.string())})

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, raw binary, text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode the ids, in one pass: digests of both, one row for each row of df."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path), ByteDecoder(path)
        said = [str(i) for i in range(len(dec.table))]
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            for i in range(0, b.num_rows, GROUP):
                for ids in enc.encode([t or "" for t in b.column(1).slice(i, GROUP).to_pylist()]):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(" ".join(map(said.__getitem__, ids.tolist())).encode()).hexdigest())
                    raw_sha.append(hashlib.sha256(dec.bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_pydict({id_col: b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(raw_sha, pa.string())})

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_checked(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids array<int>, same): the ids of each row, and whether decoding them gives its text."""
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path), ByteDecoder(path)
        for b in batches:
            for i in range(0, b.num_rows, GROUP):
                part = b.slice(i, GROUP)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = enc.encode(texts)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))), "same": pa.array([dec.bytes(x) == t.encode() for t, x in zip(texts, ids, strict=True)], pa.bool_())})

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids array<int>, same boolean")


def ranks_of(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def agrees(path: str, ranks_path: str) -> bool:
    """Whether the vocabulary of a tokenizers file has the bytes and ids of a tiktoken file."""
    table, ranks = ByteDecoder(path).table, ranks_of(ranks_path)
    return all(table[i] == token for token, i in ranks.items())
