"""Near words: the trie join against all pairs, words, forms and roots against plain loops, SQL, edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from sondera.llm import spelling

from ..conftest import DATA
from .helpers import docs


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def slow(rows, one_in=97):
    """(word, form, root, n, n_near, form_n) by loops over all pairs."""
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min((-n[v], v) for v in others[w])[1] if others[w] else None for w in n}
    form = {w: v if v and n[v] >= 2 * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(others[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("letters,n,max_chars", [("ab", 150, 3), ("ab", 150, 200), ("abcà", 400, 30), ("abcdefgh", 300, 200_000)])
def test_all_pairs(letters, n, max_chars, spark):
    """Whatever the size at which windows are halved, each pair comes once."""
    r = random.Random(n)
    words = sorted({"".join(r.choice(letters) for _ in range(r.randrange(5, 12))) for _ in range(n)})
    got = [tuple(sorted((x.a, x.b))) for x in spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n bigint"), max_chars).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in itertools.combinations(words, 2) if near(*p)}


def test_hot_prefix_splits(spark):
    """Words that share all but two places: no key keeps more letters than it may, and no pair is lost."""
    words = ["prefix" + a + b + "suffix" for a in "abcdefghijklm" for b in "abcdefghijklmnop"]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    keys = Counter((x.key, x.lo, x.hi) for x in spelling.deal(df, 60).collect())
    assert all(k * (hi - lo) <= 60 or hi - lo == 1 for (_, lo, hi), k in keys.items()) and max(keys.values()) <= 13 * 16
    assert spelling.near_pairs(df, 60).count() == len(words) * (12 + 15) // 2


def _rows():
    r = random.Random(3)
    words = ["".join(r.choice("abé") for _ in range(r.randrange(4, 9))) for _ in range(120)]
    rows = [(i, " ".join(r.choice(words)[: r.randrange(4, 9)] for _ in range(60)) + ("×x œuvre Naïve-NAÏVE don't" if i % 3 else "")) for i in range(40)]
    return rows + [(90, None), (91, ""), (92, "... 123 中文"), (None, "abaab abaab abaab"), (5, "abaab"), (5, "abaab"), (93, "abbab " * 300_000), (94, "a" * 3000 + " " + "a" * 2999), (94, "a" * 3000 + " " + "a" * 2999), (94, "a" * 3000 + " " + "a" * 2999)]


@pytest.mark.parametrize("one_in", [97, 5])
def test_variants(one_in, spark, monkeypatch):
    monkeypatch.setattr(spelling, "TEXT_CHARS", 1000)
    rows = _rows()
    got = spelling.variants(docs(spark, rows, extra=True), drop_one_in=one_in).collect()
    assert {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == slow(rows, one_in) and len(got) == len({x.word for x in got})
    assert any(x.form and x.root != x.form for x in got) or one_in != 5


def test_no_words(spark):
    assert spelling.variants(docs(spark, [])).collect() == []
    assert spelling.variants(docs(spark, [(1, None), (2, "a b c")])).collect() == []


def test_long_texts_are_cut_between_runs():
    text = "abc" * 400_000 + " d" * 10
    assert sum(spelling._runs(text), Counter()) == Counter(["abc" * 400_000] + ["d"] * 10)


def test_query_against_loops(spark):
    d = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).limit(60)
    got = spelling.variants(d).collect()
    assert {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in got} == slow([(r.doc_id, r.text) for r in d.collect()])
