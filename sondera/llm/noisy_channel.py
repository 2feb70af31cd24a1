"""Words behind obfuscated spellings: Viterbi decoding of character lattices under a character language model.

The language model counts the n-grams of letters, up to ORDER, of all words of a corpus, with a mark where a word begins or ends. Counts
lie in a table of SLOTS places by the n-gram's hash, so the table has one size for any corpus and any script; probabilities are
interpolated from short contexts to long ones.

A chunk between white space becomes a lattice: a leetspeak character may be one of its letters or stand for itself, a mark between
letters may part words or be nothing, and a letter that comes three times, or one of three that come twice, may be meant once or twice. Single characters with one space between
them are one chunk, where the spaces are such marks. Viterbi keeps the best way to each context of ORDER - 1 letters, so it is exact. A chunk of plain letters without
such repeats has one way only and is taken as it is.

Defined cases: null and empty texts have no words; characters that are neither letters nor in the tables part words; chunks of any length are
decoded whole, in time proportional to their length; without any counts all letters are equally likely.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER, SLOTS = 4, 1 << 20
#: Weight of the shorter context, in counts; probability of a letter without any counts.
WEIGHT, FLAT = 4.0, 1 / 64
#: Letters that a character may stand for (fixed values).
LEET = {"0": "o", "1": "il", "!": "i", "|": "il", "2": "z", "3": "e", "€": "e", "4": "a", "@": "a", "5": "s", "$": "s", "6": "g", "7": "t", "+": "t", "8": "b", "9": "g", "(": "c", "£": "l"}
#: Marks that may be nothing between letters.
MARKS = " ._-~*'`"
#: Log-probabilities of the channel: a letter is written as another character; a mark is set between letters; a letter is written twice, or three times and more.
SWAP, SET, TWICE, OFTEN = -1.5, -3.0, -2.5, -1.0
#: Chunks whose words a process remembers, the first ones; characters that are counted at once.
MEMO, CHARS = 300_000, 1 << 19

_A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
_PLAIN = re.compile(r"[^\W\d_]+")
#: Repetitions that may be no spelling: a letter three times, or three letters twice.
_AGAIN = re.compile(r"(.)\1(?:\1|.*?(.)\2.*?(.)\3)")
#: Marks that can only part words where they begin or end a chunk.
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in LEET) + "¡¿«»“”„’‘…–—•"
_ODD = re.compile("[" + re.escape("".join(LEET)) + re.escape(MARKS) + "]")
_ONE = r"(?:[^\W\d_]|[" + re.escape("".join(LEET)) + "])"
_SPACED = re.compile(rf"(?<!\S){_ONE}(?: {_ONE}(?!\S)){{2,}}")


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    """The slots of all n-grams, by order, in codes of letters with 0 between words. Only the first and the last place of an n-gram can be 0."""
    out, h = [], np.zeros(len(codes), dtype=np.uint64)
    letter = codes != 0
    inner = np.ones(len(codes), dtype=bool)  # all places but the first and the last are letters
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):
            n = len(codes) - k + 1
            if n < 1:
                break
            h = h[:n] * np.uint64(_A) + codes[k - 1 :].astype(np.uint64) + np.uint64(1)
            if k > 2:
                inner = inner[:n] & letter[k - 2 : k - 2 + n]
            ok = inner[:n] & (letter[k - 1 :] | (letter[k - 2 : k - 2 + n] if k > 1 else np.append(False, letter[:-1])))
            x = h[ok]
            out.append(((x ^ (x >> np.uint64(29))) * np.uint64(_B) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64))
    return out


def _slot(gram: str) -> int:
    h = 0
    for c in gram:
        h = (h * _A + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return ((h ^ (h >> 29)) * _B & 0xFFFFFFFFFFFFFFFF) >> (64 - SLOTS.bit_length() + 1)


def codes_of(text: str) -> np.ndarray:
    """Code points of the letters of a text in lower case, 0 for all else, and around it."""
    points = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le", "replace"), dtype="<u4")
    return np.where(_LETTER[np.minimum(points, (1 << 16) - 1)] & (points < 1 << 16), points, 0)


def count_ngrams(text: Column, df: DataFrame) -> DataFrame:
    """(slot, n) of all texts. A task adds up what it has read in one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, dtype=np.int64)

        def add(parts: list[str]) -> None:
            for x in slots_of(codes_of("\n".join(parts))):
                total[:] += np.bincount(x, minlength=SLOTS)

        held, size = [], 0
        for b in batches:
            for t in b.column(0):
                t, at = t.as_py() or "", 0
                while at < len(t):
                    end = min(len(t), at + CHARS)
                    while end < len(t) and t[end].isalpha():  # between words
                        end += 1
                    held.append(t[at:end])
                    size += end - at
                    at = end
                    if size >= CHARS:
                        add(held)
                        held, size = [], 0
        add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    return df.select(text.cast("string").alias("text")).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))


def train(df: DataFrame, text_col: str = "text") -> Decoder:
    """The decoder of a corpus; SLOTS rows at most come to the driver."""
    t = count_ngrams(F.col(text_col), df).toArrow()
    counts = np.zeros(SLOTS, dtype=np.float32)
    counts[t.column("slot").to_numpy()] = t.column("n").to_numpy()
    return Decoder(zlib.compress(counts.tobytes(), 1))


def chunks_of(text: str) -> set[str]:
    """The different chunks of a text, in lower case."""
    low = text.lower()
    return {*low.split(), *(m.group() for m in _SPACED.finditer(low))}


def remember(memo: dict, chunk: str, what: tuple) -> None:
    if len(memo) < MEMO and len(chunk) <= 256:
        memo[chunk] = what


@dataclass
class Decoder:
    packed: bytes
    counts: np.ndarray | None = None
    known: dict = field(default_factory=dict)
    memo: dict = field(default_factory=dict)

    def __reduce__(self):
        return Decoder, (self.packed,)

    def _n(self, gram: str) -> float:
        if self.counts is None:
            self.counts = np.frombuffer(zlib.decompress(self.packed), dtype=np.float32)
        return float(self.counts[_slot(gram)])

    def log_p(self, context: str, letter: str) -> float:
        """Of a letter, or of \\0 for the end, after up to ORDER - 1 letters, of which the first may be \\0 for the beginning."""
        key = context + letter
        if key not in self.known:
            if len(self.known) > MEMO:
                self.known.clear()
            p = FLAT
            for k in range(1, len(context) + 1):
                seen = self._n(context[-k:])
                p = (self._n(context[-k:] + letter) + WEIGHT * p) / (max(seen, self._n(context[-k:] + letter)) + WEIGHT)
            self.known[key] = math.log(p)
        return self.known[key]

    def readings(self, char: str, times: int, inside: bool, again: bool) -> list[tuple[str, float]]:
        """What a run of one character may mean, with log-probabilities; \\0 parts words. inside: it stands between two others. again: the chunk has repetitions that may be no spelling."""
        if char.isalpha():
            out = [(char * times, 0.0)]
            if times == 2 and again:
                out.append((char, TWICE))
            elif times > 2:
                out += [(char, OFTEN), (char * 2, OFTEN)]
            return out
        out = [("\0", 0.0)]
        for x in LEET.get(char, ""):
            out += [(x * n, SWAP * times + ((TWICE if times == 2 else OFTEN) if n < times else 0)) for n in sorted({1, min(2, times), times})]
        if char in MARKS and inside and times == 1:
            out.append(("", SET))
        return out

    def decode(self, chunk: str) -> tuple[str, ...]:
        """The likeliest words of a chunk in lower case."""
        runs = [(c, len(list(g))) for c, g in groupby(chunk)]
        again = bool(_AGAIN.search(chunk))
        best: dict[str, float] = {"\0": 0.0}
        back: list[dict[str, tuple[str, str]]] = []
        for i, (char, times) in enumerate([*runs, ("\n", 1)]):
            after: dict[str, float] = {}
            from_: dict[str, tuple[str, str]] = {}
            for meant, cost in self.readings(char, times, 0 < i < len(runs) - 1, again):
                for context, score in best.items():
                    now, total = context, score + cost
                    for x in meant:
                        if x != "\0":
                            total += self.log_p(now, x)
                            now = (now + x)[-(ORDER - 1) :]
                        elif now != "\0":
                            total += self.log_p(now, x)
                            now = "\0"
                    if total > after.get(now, -math.inf):
                        after[now], from_[now] = total, (context, meant)
            best = after
            back.append(from_)
        at, out = "\0", []
        for from_ in reversed(back):
            at, meant = from_[at]
            out.append(meant)
        return tuple(w for w in "".join(reversed(out)).split("\0") if w)

    def read(self, chunk: str) -> tuple[str, ...]:
        """The words of a chunk in lower case."""
        core = chunk.strip(_EDGES)
        if core.isalpha():
            return self.decode(core) if _AGAIN.search(core) else (core,)
        if not _PLAIN.search(core):
            return ()
        if _ODD.search(core) or _AGAIN.search(core):
            return self.decode(core)
        return tuple(_PLAIN.findall(core))

    def words(self, text: str) -> set[str]:
        """The different words of a text, restored."""
        out: set[str] = set()
        known = self.memo.get
        for chunk in chunks_of(text):
            words = known(chunk)
            if words is None:
                words = self.read(chunk)
                remember(self.memo, chunk, words)
            out.update(words)
        return out
