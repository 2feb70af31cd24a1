"""Encoding against the libraries themselves, exact round trips of the store and of decoding, and damaged blocks."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from sondera.llm import bpe, token_store
from tokenizers import Tokenizer

from ..conftest import rows_of
from .helpers import docs, text

BYTES, WORDS = public.path("byte_bpe_50k.json"), public.path("word_bpe_49k.json")
ODD = ["", " ", "a", "a  b", "\n a", " a b ", "<|endoftext|> x", "don't we'll I'd", "\x1c\x1d a\x85b", "é́ ŝ ﬁ Σας ΟΔΟΣ İ", "漢字 🙂👍🏽", "\x00 \x00a", "1 23 4,5.", "!!! ?!. a,b", "ÀÉ Öß", "a b c", "x" * 500]


@pytest.fixture(scope="module")
def ranks():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.ranks_of(public.path("byte_bpe_50k.tiktoken")), special_tokens={})


def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60) | st.text(alphabet="ab é.,!'s\n\t 12Σİ\x00<|>", max_size=60), max_size=6))
def test_pieces_don_t_change_ids(texts):
    for path, drops in ((BYTES, False), (WORDS, True)):
        want = [e.ids for e in plain(path).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in bpe.encoder(path, drops).encode(texts)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "a", " b ", ".", "é", "x,", "  ", "\n", "İ"]) | st.text(max_size=5), max_size=8).map("".join), max_size=5))
def test_special_strings_as_in_the_library(texts):
    """The library as it comes, without a switch."""
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encoder(WORDS, True, True).encode(texts)] == want


def test_special_strings_in_a_store(spark, tmp_path):
    rows = [(1, "a <|endoftext|> b"), (2, "<|startoftext|>"), (3, None), (4, "plain. text"), (5, "x<|endoftext|>" * 300)]
    path = f"file://{tmp_path}/store"
    token_store.store_texts(docs(spark, rows), path, WORDS, end_id=1)
    lib = Tokenizer.from_file(WORDS)
    assert {r.doc_id: r.ids for r in token_store.read_store(spark, path).collect()} == {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert 49407 in lib.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_as_the_ranks_say(ranks):
    texts = [*ODD, text(300, 1)]
    got = bpe.encoder(BYTES).encode(texts)
    assert [x.tolist() for x in got] == [ranks.encode_ordinary(t) for t in texts]
    dec = bpe.ByteDecoder(BYTES)
    assert [dec.text(x) for x in got] == texts and bpe.agrees(BYTES, public.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("room", [1, 3, 1000])
def test_full_memo(monkeypatch, room):
    monkeypatch.setattr(bpe, "MEMO_PIECES", room)
    for path, drops in ((WORDS, True), (BYTES, False)):
        e = bpe.PieceEncoder(path, drops)
        for texts in (ODD, ODD[::-1], ODD):
            assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in plain(path).encode_batch(texts, add_special_tokens=False)]
        assert e.table.n <= room


def test_keys_are_exact():
    """Pieces that differ in their last zero bytes alone, or in length, are apart; more of them than one slot."""
    pieces = ["a", "a\x00", "a\x00\x00", "\x00", "b" * 23, "b" * 24, "b" * 22, "é" * 11, "é" * 12]
    texts = [" ".join(pieces), *pieces, " ".join(f"w{i}" for i in range(5000)), " ".join(f"W{i}" for i in range(5000))]
    for path, drops in ((WORDS, True), (BYTES, False)):
        e = bpe.PieceEncoder(path, drops)
        for _ in range(2):
            assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in plain(path).encode_batch(texts, add_special_tokens=False)]


def test_split_characters_and_offsets():
    dec, t = bpe.ByteDecoder(BYTES), "a 🙂漢 é"
    ids = bpe.encoder(BYTES).encode([t])[0].tolist()
    assert "".join(dec.stream(iter([[i] for i in ids]))) == t
    start, end = dec.offsets(t, ids)
    raw = t.encode()
    at = 0
    for i, s, e in zip(ids, start, end, strict=True):
        piece = raw[at : at + len(dec.table[i])]
        assert t[s:e].encode().find(piece) >= 0 or len(t[s:e].encode()) > len(piece)
        at += len(piece)
    assert start[0] == 0 and end[-1] == len(t)
    assert dec.text([ids[1]]).startswith((" ", "�"))


def test_operators(spark, ranks):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, text(30_000, 2)), (91, text(30_000, 2)), (None, "a b")]
    df = docs(spark, rows, extra=True)
    want = sorted((str(i) if i is not None else "null", str(len(k := ranks.encode_ordinary(t or ""))), hashlib.sha256(" ".join(map(str, k)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert rows_of(bpe.round_trip(df, BYTES), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == want
    enc = bpe.encode(df, BYTES)
    back = {r.doc_id: r.text for r in bpe.decode(enc, BYTES).collect()}
    assert back == {i: t or "" for i, t in rows}
    checked = bpe.encode_checked(df, BYTES)
    assert all(r.same and r.n_tokens == len(r.ids) for r in checked.collect())
    for f in (bpe.round_trip, bpe.encode, bpe.encode_checked):
        assert f(df.limit(0), BYTES).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.sampled_from([1, 2, 8, 64]), st.sampled_from([1, 3, 256]))
def test_blocks_round_trip(tokens, lanes, every):
    t = np.array(tokens, dtype=np.uint16)
    c = token_store.Coder(token_store.frequencies(np.bincount(t, minlength=41)))
    assert (c.decode(c.encode(t, lanes, every)) == t).all()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=300))
def test_frequencies(counts):
    f = token_store.frequencies(np.array(counts))
    assert (f.sum() == 1 << token_store.BITS or not sum(counts)) and all((a > 0) == (b > 0) for a, b in zip(f, counts, strict=True))


def test_damaged_block():
    c = token_store.Coder(token_store.frequencies(np.array([5, 3, 1])))
    b = bytearray(c.encode(np.array([0, 1, 2] * 500)))
    b[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        c.decode(bytes(b))
    with pytest.raises(ValueError, match="not a block"):
        c.decode(b"xxxx" + bytes(b[4:]))
    with pytest.raises(ValueError, match="no frequency"):
        token_store.Coder(np.array([1 << 20, 0])).encode(np.array([1]))


def test_skewed_ids_take_few_bits():
    t = np.random.default_rng(0).choice(4, 200_000, p=[0.97, 0.01, 0.01, 0.01])
    c = token_store.Coder(token_store.frequencies(np.bincount(t)))
    assert len(c.encode(t, lanes=32, every=1 << 20)) * 8 / len(t) < 0.26  # entropy 0.24 bits


def test_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 300)
    rows = [(i * 7 % 101, text(i % 60, i)) for i in range(101)] + [(500, None), (501, text(20_000, 9)), (502, ""), (502, "twice"), (None, "no id")]
    df = docs(spark, rows, extra=True).repartition(5)
    path = f"file://{tmp_path}/store"
    token_store.store_texts(df, path, WORDS, end_id=1)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda r: r.start)
    enc = plain(WORDS)
    want = sorted((i if i is not None else -1, [*enc.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in got) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and got[0].start == 0 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))
    d = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.read_store(spark, path, digests=True).collect()}
    assert d == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert spark.read.parquet(f"{path}/blocks").count() > 5


def test_empty_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.store_texts(docs(spark, [(1, "a")]).limit(0), path, WORDS, end_id=1)
    assert token_store.read_store(spark, path).count() == 0
