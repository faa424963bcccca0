"""Session defaults and the shared work folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
# Recorders are those of the running thread: jobs in other threads note their own tables.
_RECORDERS: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sherdloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


# Runtime settings every job relies on.  Joins on an object or part may meet one key
# that holds a large share of the rows; adaptive execution splits it, also where
# that costs a further shuffle.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# Files hold the tables of a job many times smaller than a join's hash table does: repeated keys
# and small numbers pack into a few bytes a row.  A table is taken for this many times its files
# when a join chooses its side to broadcast; what a shuffle measured is taken as it is.  For the same
# reason a task takes few shuffled bytes: they unpack to ten times as many, which it must not spill.
# Shuffles are cut finely and small cuts are put together again.
TABLE_SETTINGS = {
    "spark.sql.sources.fileCompressionFactor": "32",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def tune_tables(spark: SparkSession) -> SparkSession:
    """``tune`` and the table sizes, for queries whose intermediate tables grow with the input."""
    for key, value in TABLE_SETTINGS.items():
        spark.conf.set(key, value)
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Apply the skew settings to a session that may have been built elsewhere."""
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder for written intermediates: ``spark.checkpoint.dir`` when it is set.

    Only a local-mode session without that setting gets a temporary folder; on a
    cluster a machine-local folder would lose data with its executor, so a missing
    setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        _FALLBACK[app] = tempfile.mkdtemp(prefix="sherdloom-")
    return _FALLBACK[app]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts lineage for iterative jobs and pins values that depend on the physical
    partitioning (``monotonically_increasing_id``), so a lost executor re-reads
    the same rows instead of recomputing different ones.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    for paths in _RECORDERS.get():
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables that are materialized inside the block."""
    paths: list[str] = []
    token = _RECORDERS.set((*_RECORDERS.get(), paths))
    try:
        yield paths
    finally:
        _RECORDERS.reset(token)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete materialized tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
