"""Plans stay what they were meant to be: narrow scans, pushed filters, no more exchanges than needed, no Python where SQL will do."""

import re

import pytest
from pyspark.sql import functions as F
from sondera.plans import catalog
from sondera.session import frames

from .conftest import DATA

SF = str(DATA / "sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange\b", text))


def columns_read(text):
    return {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<(.*?)>(?:\s|$)", text) for c in re.split(r",(?![^<]*>)", s)}


def test_flagship_reads_four_columns_and_shuffles_once(spark):
    p = plan(catalog.QUERIES["agg10_count_window"](spark, SF))
    assert columns_read(p) == {"event_id", "ts", "user_id", "value"} and exchanges(p) == 1


@pytest.mark.parametrize("name,most", [("agg2_median", 1), ("agg11_time_bin", 1), ("agg12_multiscale", 1), ("win3_rolling_std", 1), ("win6_islands", 1), ("win10_rank_ties", 2), ("jn4_asof_label", 3), ("agg21_wrap_counter", 1), ("agg30_block_residual", 3), ("flt3_circular_median9", 1)])
def test_few_exchanges(name, most, spark):
    assert exchanges(plan(catalog.QUERIES[name](spark, SF))) <= most


#: Queries that are SQL in both engines; those of kernels, walks, streams and files are compared by their rows alone.
#: jn15_event_windows slides sorted windows along the points of a bucket of time, as each of its frames is an event.
NATIVE = sorted(n for n in catalog.ORACLE if n != "jn15_event_windows" and catalog.QUERIES[n].__module__.rpartition(".")[2] in ("frame_queries", "function_queries", "relation_queries", "vector_queries"))


@pytest.mark.parametrize("name", NATIVE)
def test_what_sql_says_needs_no_python(name, spark):
    assert not re.search("Python|Pandas|Arrow", plan(catalog.QUERIES[name](spark, SF)))


def test_filters_reach_the_scan(spark):
    p = plan(frames(spark, SF).where((F.col("node") == "click") & (F.col("value") > 5)).select("value"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,click\).*GreaterThan\(value,5.0\)", p) and columns_read(p) == {"event_type", "value"}


def test_no_cartesian_products(spark):
    for name in NATIVE:
        assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, SF)), name


def test_rows_do_not_move_to_meet_models(spark):
    """Scores against a table of models: the rows are neither shuffled nor multiplied."""
    p = plan(catalog.QUERIES["ml1_mahalanobis"](spark, SF))
    assert exchanges(p) <= 4 and "array_min" in p and not re.search("Generate|SortMergeJoin", p)


def test_walks_sort_and_carry_state(spark):
    """One exchange by key, a sort that spills, and batches: no group is in memory."""
    p = plan(catalog.QUERIES["win15_ema"](spark, SF))
    assert exchanges(p) == 1 and "Sort" in p and "MapInArrow" in p and "FlatMapGroups" not in p
