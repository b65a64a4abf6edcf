"""Shared scratch space: written tables that cut lineage and survive lost executors.

Everything goes below ``spark.checkpoint.dir``, the folder that all executors share. It cannot be set in a running
session, so where it is absent an error says so; tests set it as they build theirs.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows (of ids and hashes) are broadcast up to this many, counted first; beyond, the join shuffles.
BROADCAST_IDS = 1_000_000
_SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder, as a URI or path."""
    root = spark.conf.get(_SETTING, None)
    if not root:
        raise RuntimeError(f"{_SETTING} must name a folder that the driver and all executors share; set it when the session is built")
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root; nothing is created yet."""
    return f"{shared_root(spark)}/versewise/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a reader of it.

    The lineage ends at the table: a lost executor costs a re-read, never a recomputation of the chain before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, path: str) -> DataFrame:
    """As ``cut``, at a path of the caller's, who may drop it; packed more closely."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing will read again, and let Spark clear the shuffle files of plans that are gone."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


def small(rows: DataFrame) -> DataFrame:
    """``rows``, marked for a broadcast if there are few enough. They should be a written table: they are counted."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


#: Rows and bytes of a batch of whole texts that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python, so that a worker's memory does not depend on the texts' lengths."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


_kept: list = []


def kept_by_worker(owner, make: Callable):
    """What ``make()`` gave for an equal ``owner``. A Python worker keeps one such thing from task to task, the last.

    Encoders with their dictionaries or word caches are far larger than a task's data, and a session runs operators one after
    another in the same workers: what one has left behind goes before the next makes its own.
    """
    if not _kept or _kept[0] != owner:
        _kept.clear()
        gc.collect()
        _kept[:] = owner, make()
    return _kept[1]
