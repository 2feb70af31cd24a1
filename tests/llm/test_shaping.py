"""Chat formatting, mixing and sharding: reversible, within budgets, and moving no more than they must."""

import hashlib
import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sondera.llm import chat, mixing, queries, sharding

from ..conftest import DATA, rows_of, sql_rows
from .helpers import docs, text


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("mine")).withColumn("valid", F.lit(0))


HARD = ["", None, "a\\", "\\", "<|end|>\n", "<|turn|>user<|text|>x", "<\\|end|>", "\\<|", "<<||", r"\### Assistant: </turn> ok", "é🙂\n", "<|", "\\\\<|text|>"]


def test_conversations_come_back(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(HARD)] + [(2, 0, None, "a"), (2, None, "assistant", "first"), (2, 0, "<|end|>\n", "b"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (None, 1, "user", "q"), (4, 0, "user", text(20_000, 1)), (4, 1, "assistant", text(20_000, 2))]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(_turns(spark, rows))).collect()}
    by = defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    assert set(got) == set(by)
    for c, want in by.items():
        want.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [(r, t) for _, r, t in want]
        assert got[c].loss_text == "".join(t for _, r, t in want if r == "assistant")


def test_order_of_turns(spark):
    cases = {"su": True, "u": True, "ua": True, "suaua": True, "a": False, "s": False, "uu": False, "aua": False, "usu": False, "x": False, "uxa": False}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(i, k, names[c], "t") for i, codes in enumerate(cases) for k, c in enumerate(codes)]
    got = {r.conv_id: r.valid for r in chat.format_conversations(_turns(spark, rows)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_long_conversations_span_blocks(spark):
    n = 3 * chat.BLOCK_TURNS + 5
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(n)]
    t = _turns(spark, rows)
    blocks = chat.format_blocks(t)
    assert blocks.count() == 4 and chat.verdicts(blocks).first().n_turns == n and chat.verdicts(blocks).first().valid
    assert not chat.verdicts(chat.format_blocks(t.where("turn <> 300"))).first().valid
    r = chat.read_back(chat.format_conversations(t)).first()
    assert r.valid and [x.text for x in r.turns] == [str(i) for i in range(n)]
    assert not chat.format_conversations(t.where("turn <> 300")).first().valid
    assert chat.format_conversations(t.limit(0)).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="\\<|enda>\n/t ", max_size=30), min_size=1, max_size=5))
def test_any_text_comes_back(spark, texts):
    r = chat.read_back(chat.format_conversations(_turns(spark, [(1, i, "assistant", t) for i, t in enumerate(texts)]))).first()
    assert [t.text for t in r.turns] == texts and r.loss_text == "".join(texts)


def test_another_template(spark):
    t = chat.Template(before="[(to)", middle="[(says)", after="[(.)", escape="~", trained=("bot",), states={"s": {"bot": "s"}}, accepting=("s",))
    r = chat.read_back(chat.format_conversations(_turns(spark, [(1, 0, "bot", "[(.)~"), (1, 1, "bot", "b")]), t), t).first()
    assert r.valid and [x.text for x in r.turns] == ["[(.)~", "b"] and r.formatted.startswith("[(to)bot[(says)[~(.)~~[(.)")
    with pytest.raises(ValueError):
        chat.Template(before="##a")
    with pytest.raises(ValueError):
        chat.Template(states={"s": {"user": "nowhere"}})


@pytest.mark.parametrize("name", ["op4_mixing", "op6_chat", "op3_embedding_dedup", "op1_near_dedup", "op13_spelling_variants"])
def test_sql_says_the_same(name, spark, duck):
    df = queries.QUERIES[name](spark, str(DATA / "sf0.001"))
    columns = sorted(df.columns)
    assert rows_of(df, columns) == sql_rows(duck, queries.ORACLE[name], columns)


def _sources(spark, sizes, extra=False):
    rows = [(1000 * s + i, text(5 + (i * 7) % 40, 1000 * s + i), "en", f"s{s}" if s else None) for s, n in enumerate(sizes) for i in range(n)]
    return docs(spark, [*rows, (99_000, None, "en", "s1"), (99_001, "", "en", "none")], extra)


def test_repetition_limit(spark):
    df = _sources(spark, [200, 40, 15, 4])
    b = {r.source: r for r in mixing.budgets(df.select("source", mixing.token_count(F.col("text")).alias("n_tokens")).fillna("", ["source"]), max_repeats=3.0).collect()}
    live = [r for r in b.values() if r.tokens]
    assert abs(sum(r.weight for r in live) - 1) < 1e-9
    assert max(r.budget / r.tokens for r in live) == pytest.approx(3, abs=1e-3) and min(r.budget / r.tokens for r in live) == pytest.approx(1)
    got = mixing.schedule(df, max_repeats=3.0).collect()
    per = Counter((r.source, r.doc_id) for r in got)
    assert len(per) == df.count() and max(per.values()) == 3 and min(per.values()) == 1
    for s in {r.source for r in got}:
        own = sorted((r for r in got if r.source == s), key=lambda r: (r.place, r.n_tokens))
        place = 0
        for r in own:
            assert r.place == place and 0 <= r.mix_at < 1
            place += r.n_tokens
        assert place >= b[s].budget and (not b[s].tokens or place - own[-1].n_tokens < b[s].budget)
        blocks = [(r.epoch, r.block) for r in own if r.n_tokens]
        assert len([1 for a, c in zip(blocks, blocks[1:], strict=False) if a != c]) == len(set(blocks)) - 1 if blocks else True  # a block is read in one go


def test_apply_reads_what_the_schedule_says(spark):
    df = _sources(spark, [120, 30, 9], extra=True)
    want = Counter(r.doc_id for r in mixing.schedule(df, max_repeats=2.5).collect())
    out = mixing.apply(df, max_repeats=2.5)
    assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == want
    assert {r.kept for r in out.collect()} == {"mine"}


def test_entropy_target(spark):
    df = _sources(spark, [0, 300, 30, 3]).where("source is not null").select("source", mixing.token_count(F.col("text")).alias("n_tokens"))
    for share in (0.6, 0.9):
        w = [r.weight for r in mixing.budgets(df, entropy=share).collect() if r.tokens]
        assert -sum(x * math.log(x) for x in w) == pytest.approx(share * math.log(len(w)), abs=1e-6)
    total = mixing.budgets(df, entropy=0.9, total_tokens=5000).collect()
    assert abs(sum(r.budget for r in total) - 5000) <= 3
    with pytest.raises(ValueError):
        mixing.budgets(df)


def test_mixing_of_little(spark):
    one = docs(spark, [(1, "a b c"), (1, "a b c"), (2, "d")])
    assert Counter(r.doc_id for r in mixing.schedule(one, max_repeats=4.0).collect()) == {1: 2, 2: 1}
    assert mixing.schedule(one.limit(0), max_repeats=2.0).count() == 0 and mixing.apply(one.limit(0), max_repeats=2.0).count() == 0
    nothing = docs(spark, [(1, None), (2, "")])
    assert sorted(r.doc_id for r in mixing.apply(nothing, max_repeats=2.0).collect()) == [1, 2]


def spark_hash(key, shard):
    """Spark's xxhash64 of (long, int): the hash of one column seeds the next; null columns leave it."""
    h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return xxhash.xxh64_intdigest(struct.pack("<i", shard), h)


def best_shard(key, weights):
    def score(i):
        return -weights[i] / math.log(((spark_hash(key, i) >> 11) + 0.5) * 2.0**-53)

    return max((i for i, w in enumerate(weights) if w > 0), key=score)


def test_shards_by_brute_force(spark):
    rows = [(i, text(i % 9, i)) for i in range(600)] + [(None, "a"), (7, None), (7, "b"), (7, "b"), (8, "é" * 50_000)]
    weights = [1.0, 2.0, 0.5, 0.0, 1.0]
    got = sharding.assign(docs(spark, rows, extra=True), weights, grown_by=3.0).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.text_crc32, r["size"]) for r in got) == Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    for r in got:
        assert r.law == "key" and r.shard == best_shard(r.doc_id, weights) and r.grown_shard == best_shard(r.doc_id, [*weights, 3.0])
        assert r.grown_shard in (r.shard, 5)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    n = Counter(r.shard for r in got)
    assert 3 not in n and n[1] > n[0] > n[2]
    assert sharding.assign(docs(spark, rows).limit(0), weights).count() == 0


def test_weights_hold(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    n = Counter(r.shard for r in sharding.assign(ids, [1.0, 2.0, 5.0]).collect())
    assert all(abs(n[i] / 40_000 - w / 8) < 0.01 for i, w in enumerate([1, 2, 5]))


def test_digests_of_the_query(spark):
    got = {r.conv_id: r for r in queries.op6_chat(spark, str(DATA / "sf0.001")).collect()}
    t = r"\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(t.encode()).hexdigest() and got[-7].loss_chars == len(t)


def test_a_conversation_of_the_added_id(spark, duck, tmp_path):
    """It takes in the two added turns, in order of turn, as the SQL has it."""
    rows = [(-7, 0, "system", "own"), (-7, 5, "user", None), (3, 1, "user", "a"), (3, 1, "user", "a"), (4, None, None, "b")]
    path = f"{tmp_path}/conversations.parquet"
    _turns(spark, rows).write.parquet(path)
    df = queries.op6_chat(spark, str(tmp_path))
    columns = sorted(df.columns)
    got = rows_of(df, columns)
    assert {r.conv_id: r.n_turns for r in df.collect()} == {-7: 4, 3: 2, 4: 1}
    duck.sql(f"CREATE OR REPLACE TEMP VIEW own_turns AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert got == sql_rows(duck, queries.ORACLE["op6_chat"].replace("FROM conversations", "FROM own_turns"), columns)


def test_slots_of_equal_rows(spark, monkeypatch):
    """A third of all rows are one row: its run is cut, and slots stay without gaps."""
    monkeypatch.setattr(sharding, "RUN_ROWS", 20)
    rows = [(7, "same")] * 400 + [(i, text(3, i)) for i in range(800)]
    got = sharding.assign(docs(spark, rows).repartition(5), [1.0] * 4).collect()
    assert len(got) == 1200 and len({r.shard for r in got if r.doc_id == 7}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
