import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers

from sondera.session import session  # noqa: E402

DATA = Path(os.environ.get("SONDERA_TESTDATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def _views(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{sf}/{t}.parquet')")
    return c


@pytest.fixture(scope="session")
def duck():
    return _views("sf0.001")


@pytest.fixture(scope="session")
def duck_more():
    return _views("sf0.01")


def cell(v):
    """A value as it is compared: equal numbers are equal whatever their type."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(float(v)) if type(v).__name__ == "Decimal" else str(v)


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())


def sql_rows(duck, sql, columns):
    r = duck.sql(sql)
    assert sorted(r.columns) == sorted(columns)
    at = [list(r.columns).index(c) for c in columns]
    return sorted(tuple(cell(x[i]) for i in at) for x in r.fetchall())
