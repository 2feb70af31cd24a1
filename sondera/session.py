"""Session defaults that the engine's queries rely on, and table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "sondera", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (b.master(master) if master else b).getOrCreate()


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. A local session may do without and gets a folder of its own; on a cluster that would lose rows, so it is an error there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="sondera-"))
        folder = _OWN[0]
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_ROOTS: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; leftovers are only scratch
        pass


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; everything below our root there goes when the driver ends."""
    base = shared_folder(spark)
    if base not in _ROOTS:
        _ROOTS[base] = f"{base}/sondera-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _ROOTS[base])
    return f"{_ROOTS[base]}/{label}-{uuid.uuid4().hex[:12]}"


def clear(spark: SparkSession) -> None:
    """Delete what scratch() paths of this session hold. Call it when no result that reads from there is needed any more; at exit it happens by itself."""
    if root := _ROOTS.pop(shared_folder(spark), None):
        _remove(spark, root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` in the role of frames: source, node, time in microseconds, value; (us, row_no) is their order."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    return e.select(F.col("user_id").alias("source"), F.col("event_type").alias("node"), us.alias("us"), F.col("event_id").alias("row_no"), "value", "props")
