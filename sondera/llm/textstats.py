"""Counts and shares of a whole text that quality rules and the quality classifier read."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Names of features(), in its order.
FEATURES = [
    "log_words", "mean_word", "word_spread", "symbol_share", "marked_share", "upper_share", "digit_share", "bang_share", "punct_share", "dup_line_share", "repeat_share", "distinct_share", "top_word_share",
    "short_share", "long_share", "line_words", "stop_share", "entropy", "caps_word_share", "pipe_share", "ends_share", "non_ascii_share", "sentence_words", "bullet_share",
]


def repeated(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of `width` words which the text has twice or more, its first place included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = list(zip(*(words[i : i + n] for i in range(width)), strict=True))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    twice = np.fromiter((count[g] > 1 for g in grams), dtype=np.int64, count=n)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(text: str) -> tuple[list[str], int, int, int, int, int]:
    """Words; and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A line counts as repeated if it has a word and an earlier line is equal."""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    return words, len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup, repeated(words)


#: Frequent short words of the four languages that the corpus has (fixed values).
STOP_WORDS = frozenset("the of and to in is that it for on was with as be by at this have from or le la les de des et en un une du que qui dans pour est par sur au der die das und den von zu mit sich ist nicht ein eine dem el los las y que en un por con no se del al lo para como".split())


def features(text: str, counts: tuple[list[str], int, int, int, int, int] | None = None) -> list[float]:
    """FEATURES of a text; those of an empty text are all 0."""
    words, n, chars, symbols, dup, repeat = counts or base_counts(text)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=n)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    low = points[points < 128]
    hist = np.bincount(low, minlength=128)
    upper, digits = int(hist[65:91].sum()), int(hist[48:58].sum())
    punct = int(hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum())
    share = hist[hist > 0] / max(1, len(low))
    letters = max(1, int(hist[65:91].sum() + hist[97:123].sum()) + size - len(low))
    caps = sum(1 for w in words if len(w) > 1 and w.isupper())
    marked = sum(c for w, c in count.items() if _SYMBOLS.search(w))
    stops = sum(count[w] for w in STOP_WORDS if w in count)
    stops_all = int(hist[46] + hist[33] + hist[63])
    return [
        math.log1p(n), float(lens.mean()), float(lens.std()), symbols / size, marked / n, upper / letters, digits / size, int(hist[33]) / n, punct / size, dup / max(1, len(lines)), repeat / n, len(count) / n, max(count.values()) / n,
        float((lens <= 2).mean()), float((lens >= 12).mean()), n / max(1, len(lines)), stops / n, float(-(share * np.log(share)).sum()), caps / n, count.get("|", 0) / n, sum(1 for x in lines if x.rstrip()[-1:] in ".!?") / max(1, len(lines)),
        (size - len(low)) / size, n / (1 + stops_all), sum(1 for x in lines if x.lstrip()[:1] in "-*•|") / max(1, len(lines)),
    ]
