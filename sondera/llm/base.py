"""Shared helpers of the training-data operators: tables in the folder all executors share, and Arrow batches of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import clear, scratch, table

__all__ = ["clear", "keep", "scratch", "table"]


#: Rows with whole texts that go to Python in one batch, at most.
TEXT_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keep(df: DataFrame, label: str, texts: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    texts: whole texts go to Python on the way. They may be long, and a batch is in memory several times, so batches have TEXT_ROWS
    rows at most while this is written; the session's own setting is as before afterwards.
    """
    path, conf = scratch(df.sparkSession, label), df.sparkSession.conf
    own = conf.get(_BATCH, None)
    if texts and not 0 < int(own or "10000") <= TEXT_ROWS:
        conf.set(_BATCH, str(TEXT_ROWS))
    try:
        df.write.parquet(path)
    finally:
        if texts:
            conf.set(_BATCH, own) if own is not None else conf.unset(_BATCH)
    return df.sparkSession.read.schema(df.schema).parquet(path)
