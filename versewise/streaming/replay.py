"""Rows that arrive in steps, taken by a stream that starts again at every step, from files to a sink and back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share; set it when the session is built")
    return f"{root.rstrip('/')}/versewise/{name}-{uuid.uuid4().hex}"


def take_new(spark: SparkSession, folder: str, schema, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """One run of a stream over all files below ``folder/in`` that its checkpoint has not seen, with what its watermark then closes."""
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    start(stream).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def replay(rows: DataFrame, step: str, folder: str, start: Callable[[DataFrame], DataStreamWriter]) -> None:
    """For each value of ``step``, in order: its rows are added as files, and the stream takes them in a run of its own.

    All files of a step are one batch, whatever their number, so what is late depends on the steps alone: a run begins with the
    watermark of the runs before it. Steps are dates or the like: the driver sees one row each.
    """
    spark = rows.sparkSession
    steps = [r[0] for r in rows.select(step).distinct().orderBy(step).collect()]
    schema = rows.drop(step).schema
    for value in steps:
        rows.where(F.col(step) == value).drop(step).write.mode("append").parquet(f"{folder}/in")
        take_new(spark, folder, schema, start)


def to_files(frame: DataFrame, folder: str, mode: str = "append") -> DataStreamWriter:
    """A sink of Parquet files with a log of whole batches: a batch that is repeated after a failure counts once."""
    return frame.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out")


def replayed(rows: DataFrame, step: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build`` of the stream of ``rows``, step by step, has put into its sink."""
    spark = rows.sparkSession
    folder = shared_folder(spark, name)
    schema = build(rows.drop(step)).schema
    replay(rows, step, folder, lambda s: to_files(build(s), folder))
    return spark.read.schema(schema).parquet(f"{folder}/out")
