"""Spelling variant grouping: near words of the corpus vocabulary by a self-join of its trie with active-node sets.

Words are maximal runs of letters (RUN), A-Z in lower case. Two words are near if one inserted, deleted or replaced code point
turns one into the other. The vocabulary is dealt by prefix: of words of c and c + 1 letters, those with the same first half meet in
one trie, which finds the differences in the other half, and those with the same last half meet in a second one, which finds those in the
first half. What is outside a trie's window of places is its key. Where the words of a key hold more than MAX_CHARS letters in the
window, the window is halved and its words are dealt anew by longer keys, down to windows of one place, whose keys leave one letter open (two in words of c + 1).
So a hot prefix splits, and no task gets more than a bounded trie, however the vocabulary is distributed.

In a trie an active pair is two nodes whose prefixes are one edit apart. Pairs arise below each node at the leftmost place where two
words can differ (two of its children; or a child and a grandchild, for one letter more), walk down along children of the same
letter, and are emitted where both ends are words. The leftmost difference belongs to one window alone, so a pair comes once. Levels of all
tries of a batch are arrays, and a step down is a search in a sorted array of children.

Defined cases: null and empty texts have no words; a null id counts as an empty string where the id is part of a digest; repeated rows count
again; an empty table gives an empty result; letters outside RUN part words; a text of any length is read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import keep

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A word has so many letters and occurrences at least.
MIN_CHARS, MIN_COUNT = 5, 3
#: The form of a word is so many times as frequent at least.
TIMES = 2
#: Letters in the windows of one key, beyond which its window is halved.
MAX_CHARS = 200_000
#: Different words that a task counts before it hands them on; letters of a text that are read at once; cells of the matrices of a batch of tries.
MAX_COUNTED, TEXT_CHARS, CELLS = 400_000, 1 << 20, 1 << 22
#: One of so many runs of a document loses a letter.
DROP_ONE_IN = 97
_LOWER = {c: c + 32 for c in range(65, 91)}


def _runs(text: str) -> Iterator[Counter]:
    """How often a text has each run; a long one in parts that end between runs."""
    at, n = 0, len(text)
    while n - at > TEXT_CHARS:
        end = at + TEXT_CHARS
        while end < n and RUN.match(text, end):
            end = RUN.match(text, end).end()
        yield Counter(RUN.findall(text, at, end))
        at = end
    yield Counter(RUN.findall(text, at, n))


def worn(word: str, prefix: int, one_in: int) -> str:
    """The word, or one of `one_in` words by the digest of document and word without one of its letters. prefix: crc32 of what stands before the word."""
    h = zlib.crc32(word.encode(), prefix)
    if h % one_in:
        return word
    h %= len(word)
    return word[:h] + word[h + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int = DROP_ONE_IN, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the corpus. Each task adds up what it has read before words move. drop_one_in 0: no run loses a letter."""
    src = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                prefix = zlib.crc32(f"{doc_id}:".encode())
                for part in _runs(text.as_py()):
                    for word, n in part.items():
                        word = word.lower() if word.isascii() else word.translate(_LOWER)
                        if drop_one_in:
                            word = worn(word, prefix, drop_one_in)
                        if len(word) >= min_chars:
                            total[word] = total.get(word, 0) + n
                if len(total) > MAX_COUNTED:
                    yield out()
                    total.clear()
        yield out()

    counted = src.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _dealt(words: DataFrame, windows: Column) -> DataFrame:
    """One row for each of a word's windows (lo, hi), with the key: the places of a word of c letters are [lo, hi), one more for one of c + 1."""
    df = words.withColumn("w", F.explode(windows)).select("word", "n", "c", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    end = F.col("hi") + F.length("word") - F.col("c")
    cut = lambda a, b: F.substring("word", a + 1, F.greatest(b - a, F.lit(0)))
    key = F.concat_ws("\t", "c", "lo", "hi", cut(F.lit(0), F.col("lo")), cut(end, F.length("word")))
    return df.select("word", "n", "c", "lo", "hi", key.alias("key"), cut(F.col("lo"), end).alias("part"))


def _halves(lo: Column, hi: Column) -> Column:
    mid = F.ceil((lo + hi) / 2).cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("lo"), b.cast("int").alias("hi"))
    return F.array(pair(lo, mid), pair(mid, hi))


def deal(words: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows of words by the key of each trie that they belong to."""
    size = F.length("word")
    of = words.withColumn("c", F.explode(F.filter(F.array(size, size - 1), lambda c: c >= min_chars)))
    rows, done = keep(_dealt(of, _halves(F.lit(0), F.col("c") + 1)), "dealt"), []
    while True:
        hot = keep(rows.where(F.col("hi") - F.col("lo") > 1).groupBy("key").agg(F.sum(F.length("part")).alias("m")).where(F.col("m") > max_chars).select(F.col("key").alias("hot")), "hot")
        if hot.isEmpty():
            done.append(rows)
            break
        at = rows.key == hot.hot
        done.append(rows.join(hot, at, "left_anti"))
        rows = keep(_dealt(rows.join(hot, at, "left_semi"), _halves(F.col("lo"), F.col("hi"))), "dealt")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def trie_pairs(group: np.ndarray, parts: list[str], room: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one group whose parts are one edit apart, a the shorter of two lengths. Rows come by (group, part), parts differ within a group.

    room: places of the group's window; a letter more belongs to a place before its end. short: the part is of a word of c letters.
    """
    m = len(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=m)
    width = max(1, int(size.max(initial=0)))
    letters = np.array(parts, dtype=f"<U{width}").view("<u4").reshape(m, width)
    differ = letters[1:] != letters[:-1]
    same = np.concatenate([[-1], np.where(group[1:] == group[:-1], differ.argmax(1), -1)])  # letters shared with the row before
    # nodes by depth: parent, letter, the row that ends there, the first row below
    parents, labels, rows_, starts, depths, base = [], [], [], [], [], 0
    above = np.zeros(m, dtype=np.int64)
    for d in range(width + 1):
        at = np.flatnonzero(size >= d)
        new = same[at] < d
        first = at[new]
        starts.append(first)
        parents.append(above[first] if d else np.full(len(first), -1))
        labels.append(letters[first, d - 1].astype(np.int64) if d else np.zeros(len(first), np.int64))
        rows_.append(np.where(size[first] == d, first, -1))
        depths.append(np.full(len(first), d))
        here = np.zeros(m, dtype=np.int64)
        here[at] = base + np.cumsum(new) - 1
        above, base = here, base + len(first)
    parent, label, row, start, depth = map(np.concatenate, (parents, labels, rows_, starts, depths))
    begin, end = np.searchsorted(parent, np.arange(len(parent)), "left"), np.searchsorted(parent, np.arange(len(parent)), "right")
    child_key = (parent + 1) << 21 | label  # rises with the node

    def child(node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        key = (node + 1) << 21 | letter
        i = np.minimum(np.searchsorted(child_key, key), len(child_key) - 1)
        return np.where(child_key[i] == key, i, -1)

    def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the range, member) of all members of ranges."""
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]

    found_a, found_b = [], []

    def emit(u: np.ndarray, v: np.ndarray, one_longer: bool) -> None:
        a, b = row[u], row[v]
        ok = (a >= 0) & (b >= 0)
        a, b = a[ok], b[ok]
        ok = short[a] & (short[b] != one_longer)
        found_a.append(a[ok])
        found_b.append(b[ok])

    def down(u: np.ndarray, v: np.ndarray, one_longer: bool) -> None:
        while len(u):
            emit(u, v, one_longer)
            fewer = end[u] - begin[u] <= end[v] - begin[v]
            x, y = np.where(fewer, u, v), np.where(fewer, v, u)
            which, kid = spread(begin[x], end[x])
            other = child(y[which], label[kid])
            hit = other >= 0
            which, kid, other = which[hit], kid[hit], other[hit]
            u, v = np.where(fewer[which], kid, other), np.where(fewer[which], other, kid)

    nodes = np.arange(len(parent))
    kids = nodes[parent >= 0]
    # one letter for another: two children of a node
    which, sibling = spread(kids + 1, end[parent[kids]])
    down(kids[which], sibling, False)
    # one letter more: a node against its child, whose next letter is the node's next one and another than the child's own
    at_end = kids[depth[parent[kids]] < room[start[kids]]]
    emit(parent[at_end], at_end, True)
    which, grand = spread(begin[kids], end[kids])
    v = kids[which]
    ok = label[grand] != label[v]
    u = child(parent[v[ok]], label[grand[ok]])
    down(u[u >= 0], grand[ok][u >= 0], True)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(found_a), cat(found_b)


def near_pairs(words: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, a_n, b, b_n): each pair of near words once. words: (word, n), distinct words."""
    rows = deal(words, max_chars, min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(t: pa.Table) -> pa.RecordBatch:
            key = t.column("key").combine_chunks().dictionary_encode().indices.to_numpy()
            cols = {k: t.column(k).to_numpy() for k in ("c", "lo", "hi", "size")}
            a, b = trie_pairs(key, t.column("part").to_pylist(), cols["hi"] - cols["lo"], cols["size"] == cols["c"])
            word, n = t.column("word").combine_chunks(), t.column("n").combine_chunks()
            a, b = pa.array(a), pa.array(b)
            return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["a", "a_n", "b", "b_n"])

        held: list[pa.Table] = []
        cells = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            cells += b.num_rows * (pc.max(b.column("size")).as_py() + 1)
            if cells < CELLS:
                continue
            t = pa.concat_tables(held)
            keys = t.column("key")
            whole = pc.index(keys, keys[-1]).as_py()  # the last key may go on in the next batch
            if whole:
                yield found(t.slice(0, whole))
            held, cells = [t.slice(whole)], 0
        if held:
            yield found(pa.concat_tables(held))

    dealt = rows.select("key", "part", "word", "n", "c", "lo", "hi", F.length("word").alias("size")).repartition("key").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, "a string, a_n bigint, b string, b_n bigint")


def forms(words: DataFrame, max_chars: int = MAX_CHARS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n, n_near, form, form_n): the number of near words, and the most frequent of them (of several the least) if it is TIMES as frequent."""
    pairs = near_pairs(words, max_chars, min_chars)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("m"), F.col("b").alias("b"))).alias("best"))
    out = words.join(best, words.word == best.a, "left")
    form_n = F.when(-F.col("best.m") >= TIMES * F.col("n"), -F.col("best.m"))
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(form_n.isNotNull(), F.col("best.b")).alias("form"), form_n.alias("form_n"))


def roots(table: DataFrame) -> DataFrame:
    """(word, root) of the words of a written table (word, form) that have a form: the end of the chain of forms. A chain doubles what it has seen in each round, and a form is TIMES as frequent, so rounds are few."""
    now = keep(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = keep(now.join(ahead, now.root == ahead["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_one_in: int = DROP_ONE_IN) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the corpus."""
    words = keep(count_words(docs, id_col, text_col, drop_one_in), "words")
    table = keep(forms(words), "forms")
    end = roots(table).withColumnRenamed("word", "at")
    return table.join(end, table.word == end["at"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
