"""Operators marked native run no Python; near-duplicates and scans shuffle no more than said."""

import re

import pytest
from sondera.llm import chat, mixing, queries, sharding
from sondera.session import table

from ..conftest import DATA
from ..test_plans import columns_read, plan

SF = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", ["op4_mixing", "op6_chat", "op7_sharding"])
def test_native(name, spark):
    assert not re.search("Python|Pandas|Arrow", plan(queries.QUERIES[name](spark, SF)))


def test_pipeline_mix_is_native(spark):
    assert not re.search("Python|Pandas|Arrow", plan(mixing.apply(table(spark, SF, "documents"), max_repeats=2.0)))


@pytest.mark.parametrize("name", ["op5_license_scan", "op10_byte_bpe"])
def test_scans_do_not_shuffle(name, spark):
    p = plan(queries.QUERIES[name](spark, SF))
    assert "Exchange" not in p and columns_read(p) == {"doc_id", "text"}


def test_verdicts_and_shards_gather_no_texts(spark):
    d = table(spark, SF, "documents")
    assert not re.search(r"collect_list\(.*text", plan(sharding.assign(d, [1.0, 1.0])))
    p = plan(chat.verdicts(chat.format_blocks(table(spark, SF, "conversations"))))
    assert p.count("collect_list") and "segments" not in p
