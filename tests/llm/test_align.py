"""Alignment of two tokenizers against a plain loop over all pairs of tokens; encoders against their libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sondera.llm import align, bpe
from tokenizers import Tokenizer

from ..conftest import DATA
from .helpers import docs, text

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=B)
BYTES = Tokenizer.from_file(A)
BYTES.encode_special_tokens = True
ALPHABET = bpe.byte_alphabet()


def tokens(t):
    """[(id, start, end)] of both sides; none where bytes don't come back."""
    if not t:
        return [], []
    want, out = (" " + t).encode(), []
    a = BYTES.encode(" " + t, add_special_tokens=False)
    parts = [[(i, bytes(ALPHABET[c] for c in s)) for i, s in zip(a.ids, a.tokens, strict=True)]]
    ids = MODEL.encode(t)
    parts.append([(i, bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i) else MODEL.id_to_piece(i).replace("▁", " ").encode()) for i in ids])
    for side in parts:
        if b"".join(x for _, x in side) != want:
            return [], []
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def slow_groups(a, b):
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    return [([i for i, _, e in a if lo < e <= hi], [i for i, _, e in b if lo < e <= hi]) for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True)] if cuts else []


def slow_links(a, b):
    return [(i, j) for i, s, e in a for j, u, v in b if max(s, u) < min(e, v)]


def slow(texts):
    both = [tokens(t) for t in texts]
    links = [slow_links(*x) for x in both]
    count = Counter(p for x in links for p in x)
    top = Counter()
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    out = []
    for (a, b), x in zip(both, links, strict=True):
        g = slow_groups(a, b)
        line = ";".join(",".join(map(str, i)) + "|" + ",".join(map(str, j)) for i, j in g)
        out.append((len(a), len(b), len(g), len(x), sum(count[p] == top[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(line.encode()).hexdigest() if g else ""))
    return out


HARD = ["", None, " ", "  ", "a", " a", "a  b", "a \n b\t c", "▁x a", "a ▁", "x　y z \u0085 q", "<|endoftext|> </s> <s> <unk> <0x41>", "\U0001f642\U0001f642 naïve 中文字", "a\x00b", "é ﬁ", "the " * 40, "\n\n", "don't  stop...   now", "0123456789 " * 9, "\r\n x\x1c y"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" aé\n\t▁b.,'1　中\U0001f642\x1csT"), max_size=24))
def test_pieces_as_the_library_has_them(t):
    got = align.tokenizers(A, B).b.encode([t and " " + t, "", t and " " + t])
    assert got[0].tolist() == got[2].tolist() == MODEL.encode(t) and not len(got[1])


def test_block_against_loops():
    r = random.Random(5)
    texts = [x or "" for x in HARD] + [text(60, i) for i in range(5)] + ["".join(r.choice("ab éz.\n") for _ in range(40)) for _ in range(60)]
    t = align.tokenizers(A, B)
    k = align.align(texts, t)
    said = align.lines(k, t)
    for i, x in enumerate(texts):
        a, b = tokens(x)
        assert said[i] == ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in slow_groups(a, b))
        mine = k.of == i
        assert sorted(zip(k.a[k.link_a[mine]].tolist(), k.b[k.link_b[mine]].tolist(), strict=True)) == sorted(slow_links(a, b))


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_digests(spark, monkeypatch):
    """Nulls, ties, repeated rows and ids, clashing columns, several blocks."""
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "a tie"), (3, "again a tie"), (3, "again a tie"), (70, text(3000, 1))] + [(100 + i, text(50, i)) for i in range(20)]
    df = docs(spark, rows, extra=True)
    for c in ("block", "place", "pairs", "pair", "count"):
        df = df.withColumn(c, df.lang)
    got = align.digests(df.repartition(3), A, B).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    want = sorted(((r[0], *x) for r, x in zip(rows, slow([t for _, t in rows]), strict=True)), key=key)
    assert sorted(((r.doc_id, *(r[c] for c in NAMES)) for r in got), key=key) == want


def test_blocks_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(align, "BLOCK_BYTES", 10)
    monkeypatch.setattr(align, "BLOCK_TEXTS", 3)
    b = pa.RecordBatch.from_pydict({"i": list(range(9)), "t": ["aaaa", None, "bbbbb", "c", "c", "c", "c", "d" * 50, ""]})
    assert [i.to_pylist() for i, _ in align.blocks(iter([b]))] == [[0, 1, 2], [3, 4, 5], [6, 7], [8]]


def test_groups_and_products(spark):
    rows = [(1, "hello worlds, naïve"), (2, None), (3, "▁"), (4, text(30, 2))]
    found = align.groups(docs(spark, rows), A, B)
    got = {r.doc_id: r.groups for r in found.collect()}
    for i, t in rows:
        assert [(list(g.a), list(g.b)) for g in got[i]] == slow_groups(*tokens(t))
        raw = (" " + (t or "")).encode()
        assert not got[i] or b"".join(raw[g.start : g.end] for g in got[i]) == raw
    pairs = Counter((r.doc_id, r.a, r.b) for r in align.group_products(found).collect())
    assert pairs == Counter((i, a, b) for i, t in rows for x, y in slow_groups(*tokens(t)) for a in x for b in y)


def test_counts(spark):
    texts = [text(80, i) for i in range(4)]
    count = Counter(p for t in texts for p in slow_links(*tokens(t)))
    got = align.pair_counts(docs(spark, list(enumerate(texts))), A, B).collect()
    assert {(r.a, r.b): r["count"] for r in got} == count
    assert all(r.best == (r["count"] == max(n for (_, j), n in count.items() if j == r.b)) for r in got)


def test_empty(spark):
    assert align.digests(docs(spark, []), A, B).collect() == []


def test_query_against_loops(spark):
    d = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).where("length(text) < 1500").limit(40)
    rows = d.collect()
    want = dict(zip([r.doc_id for r in rows], slow([r.text for r in rows]), strict=True))
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in align.digests(d, A, B).collect()} == want
