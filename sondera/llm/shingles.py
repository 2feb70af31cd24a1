"""Five-word shingles of whole texts as 64-bit hashes, made for many texts at once."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import xxhash

from .textstats import WORD

WIDTH = 5
#: Odd multipliers of a shingle's words, from the golden ratio's bits by splitmix64.
GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 20)) * np.uint64(GOLDEN & _MASK)) | np.uint64(1)


def words_of(text: str | None) -> list[str]:
    """The words that shingles are made of: runs without ASCII white space, in lower case."""
    return WORD.findall((text or "").lower())


def digest(words: list[str]) -> bytes:
    """128 bits that stand for the sequence of words."""
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()


def hashed(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, one text after the other, and the number of words of each."""
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(n.sum())), n


def shingles(words: list[list[str]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of every shingle of each text, in order. A text of fewer words is one shingle; one without words has none."""
    return of_hashes(*hashed(words), width)


def of_hashes(h: np.ndarray, n: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of words that are hashed already."""
    c = seeds(width)
    with np.errstate(over="ignore"):
        s = np.zeros(len(h), dtype=np.uint64)
        for k in range(width):
            s[: len(h) - k] += h[k:] * c[k]
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(h) else np.zeros(0, np.int64)
    whole = place <= n[owner] - width
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        with np.errstate(over="ignore"):
            for i in short:
                a = first[i]
                s[a] = np.sum(h[a : a + n[i]] * c[: n[i]], dtype=np.uint64) + np.uint64(n[i])
                whole[a] = True
    return owner[whole], mix(s[whole])


def weighted(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count) of each distinct shingle of a text."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    return o[at], x[at], np.diff(np.concatenate([at, [len(o)]]))


def numbered(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, element): the k-th time a text has a shingle is an element of its own, so sets of elements compare as weighted shingles do."""
    o, x, c = weighted(owner, h)
    k = np.arange(int(c.sum())) - np.repeat(np.concatenate([[0], np.cumsum(c)[:-1]]), c) if len(c) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        return np.repeat(o, c), mix(np.repeat(x, c) + k.astype(np.uint64) * np.uint64(GOLDEN & _MASK))
