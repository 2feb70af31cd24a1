"""The registered query of each training-data operator, with production parameters, over whole tables; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, embedding_dedup, gam, license_scan, mixing, near_dedup, oracles, quality_rules, sharding, spelling, token_store, toxicity
from .base import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = oracles.ORACLE

#: Where the public tokenizers lie; a caller can set another function from a file's name to its path.
TOKENIZER_PATH: Callable[[str], str] | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_PATH:
        return TOKENIZER_PATH(name)
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


@query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "store")
    token_store.store_texts(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1, drops_space=True)
    return token_store.read_store(spark, path, digests=True)


#: Shards of the registered query, of equal weight; a 25th joins for grown_shard.
SHARDS = 24


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown_by=1.0)


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(table(spark, sf_dir, "embeddings"))


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",").alias("licenses"), F.round(F.array_max(F.col("matches.containment")), 6).alias("containment"), F.array_min(F.col("matches.start")).alias("first_word"))


#: How often the mix repeats a source at most.
MAX_REPEATS = 2.0


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more of id -7; if the table has that id already, its turns and the added two are one conversation, in order of turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(hard).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("conv_id", "t.*")
    back = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"), F.col("valid").alias("valid_order"),
    )


@query
def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
