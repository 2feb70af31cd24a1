"""Each registered query with SQL gives the rows that DuckDB gives."""

import pytest
from sondera.plans import catalog

from .conftest import DATA, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(name, spark, duck):
    df = catalog.QUERIES[name](spark, str(DATA / "sf0.001"))
    columns = sorted(df.columns)
    assert rows_of(df, columns) == sql_rows(duck, catalog.ORACLE[name], columns)


#: What depends on more data than the smallest tables have: look-alikes in streams, ties of rounding, long runs.
LARGER = sorted(n for n in catalog.ORACLE if n.startswith(("src5", "src6", "src7", "src19", "snk", "dsp11", "stat3", "ml14", "win23")))


@pytest.mark.parametrize("name", LARGER)
def test_same_rows_of_more(name, spark, duck_more):
    df = catalog.QUERIES[name](spark, str(DATA / "sf0.01"))
    columns = sorted(df.columns)
    assert rows_of(df, columns) == sql_rows(duck_more, catalog.ORACLE[name], columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(name, spark):
    df = catalog.QUERIES[name](spark, str(DATA / "sf0.001"))
    assert df.collect() and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
