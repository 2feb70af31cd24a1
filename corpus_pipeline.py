"""Pipeline over `documents`: quality rules, quality classifier, near-duplicates, mix of sources, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and but for the last returns
the columns of documents. run() writes each stage's rows into the folder that all executors share and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sondera.llm import bpe, gam, mixing, near_dedup, quality_rules
from sondera.llm.base import keep, table
from sondera.llm.queries import MAX_REPEATS, tokenizer_path


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie over a certified cutoff go."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model takes for label 0 go."""
    return gam.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.documents_kept(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix of sources reads it, once at least."""
    return mixing.apply(docs, max_repeats=MAX_REPEATS)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, same): token ids of each text, and whether they decode to it. Written here, as only then batches of texts are bounded."""
    return keep(bpe.encode_checked(docs, tokenizer_path("byte_bpe_50k.json")), "ids", texts=True)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: A certified cutoff, a boosted model and a signature are beyond SQL; tests/llm checks the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
