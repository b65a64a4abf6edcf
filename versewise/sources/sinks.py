"""Sinks (A14-A19): TTML, reports, section texts, trajectories, frozen thresholds, daily observations."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewise.functions.text import stamp, xml_escape


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise(F.lit(""))


def _spans(row_text: Column, words: Column) -> Column:
    """Word spans of a line, with what stands between words kept: ``words(text, begin_us, end_us, tail)``."""
    one = lambda w: F.concat(F.lit("<span"), _attribute("begin", stamp(w["begin_us"])), _attribute("end", stamp(w["end_us"])), F.lit(">"), xml_escape(w["text"]), F.lit("</span>"), xml_escape(F.coalesce(w["tail"], F.lit(""))))
    return F.when(F.size(words) > 0, F.array_join(F.transform(words, one), "")).otherwise(row_text)


def ttml_documents(rows: DataFrame, key: str = "recording_id") -> DataFrame:
    """``(recording_id, ttml)`` from lines, in the order of ``line_id``.

    Lines carry ``begin_us, end_us, text`` and may carry ``words`` (spans; null for a steady line), ``background``
    (text of backing vocals) and ``second_voice``. Null times leave their attribute out. A recording's lines are
    combined into one document, so a group is one song.
    """
    body = xml_escape(F.col("text"))
    if "words" in rows.columns:
        body = _spans(body, F.col("words"))
    if "background" in rows.columns:
        body = F.concat(body, F.when(F.col("background").isNotNull(), F.concat(F.lit('<span ttm:role="x-bg">('), xml_escape(F.col("background")), F.lit(")</span>"))).otherwise(F.lit("")))
    agent = F.when(F.col("second_voice"), F.lit(' ttm:agent="v2"')).otherwise(F.lit("")) if "second_voice" in rows.columns else F.lit("")
    line = F.concat(F.lit("<p"), _attribute("begin", stamp(F.col("begin_us"))), _attribute("end", stamp(F.col("end_us"))), agent, F.lit(">"), body, F.lit("</p>"))
    parts = rows.select(key, "line_id", line.alias("p")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_id", "p"))).alias("ps"))
    return parts.select(key, F.concat(F.lit("<tt><body><div>"), F.array_join(F.transform("ps", lambda x: x["p"]), ""), F.lit("</div></body></tt>")).alias("ttml"))


def write_documents(documents: DataFrame, path: str, text: str, key: str = "recording_id") -> None:
    """One text file a recording, named by it: ``<recording>.txt``, so that a folder of any number is listed at once.

    Tasks write whole files under private names and rename them, so retries agree, and the driver handles no file. Recordings
    whose names are not plain have a folder ``recording_id=<escaped>`` of their own. Several rows of a recording are one
    file, a line each, in the order of their texts.
    """
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    where, base = fs.FileSystem.from_uri(uri)
    if where.get_file_info(base).type != fs.FileType.NotFound:
        where.delete_dir(base)
    where.create_dir(base, recursive=True)
    folder = F.concat(F.lit(f"{key}="), F.coalesce(F.replace(F.url_encode(F.col(key).cast("string")), F.lit("+"), F.lit("%20")), F.lit("__HIVE_DEFAULT_PARTITION__")))
    plain = F.col(key).cast("string").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")
    whole = documents.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(text)), "\n").alias("body"))
    files = whole.select(F.when(plain, F.lit("")).otherwise(folder).alias("folder"), F.when(plain, F.concat(F.col(key).cast("string"), F.lit(".txt"))).otherwise("part.txt").alias("name"), "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for folder, name, body in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{top}/{folder}" if folder else top
                if folder:
                    store.create_dir(at, recursive=True)
                own = f"{at}/_{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(f"{body}\n".encode())
                store.move(own, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    files.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def report_rows(rows: DataFrame, columns: Sequence[str], key: str = "recording_id", order: str = "line") -> DataFrame:
    """A recording's lines as one nested row, in order."""
    rest = [c for c in columns if c != order]
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias("lines"))


def write_report(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Reports as JSON lines."""
    report_rows(rows, columns).write.mode("overwrite").json(path)


def section_text(sections: DataFrame, key: str = "recording_id") -> DataFrame:
    """Section annotations as lyrics text, in order of their start."""
    return sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_us", "text"))).alias("s")).select(key, F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("lyrics"))


def write_trajectories(rows: DataFrame, path: str) -> None:
    """Trajectories as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def frozen_record(rows: DataFrame, thresholds: DataFrame, order: Sequence[str]) -> DataFrame:
    """Thresholds with a digest of the rows that they were fitted on.

    The digest sums the rows' hashes, so it needs no order and combines before the shuffle.
    """
    digest = rows.select(F.sha2(F.to_json(F.struct(*order)), 256).alias("h")).agg(F.sha2(F.concat_ws(",", *[F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(5)], F.count("*").cast("string")), 256).alias("fitted_on"))
    return thresholds.crossJoin(digest)


def write_frozen(record: DataFrame, path: str) -> None:
    """The record as JSON lines."""
    record.write.mode("overwrite").json(path)


def read_frozen(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A frozen record: ``schema`` of its thresholds, with ``fitted_on``."""
    return spark.read.schema(f"{schema}, fitted_on string").json(path)


def frozen_violations(rows: DataFrame, record: DataFrame, order: Sequence[str]) -> DataFrame:
    """``(recording_id, row, rule_id)``: one row if the record was fitted on other rows than these, or is empty."""
    found = record.agg(F.min("fitted_on").alias("a"), F.max("fitted_on").alias("b"))
    now = frozen_record(rows, record.sparkSession.range(1).select(F.lit(1).alias("_one")), order)
    differ = ~F.coalesce((F.col("a") == F.col("fitted_on")) & (F.col("b") == F.col("fitted_on")), F.lit(False))
    return now.crossJoin(found).where(differ).select(F.lit("frozen").alias("recording_id"), F.coalesce("a", F.lit("none")).alias("row"), F.lit("fitted_on_other_rows").alias("rule_id"))


def require_fitted(rows: DataFrame, record: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows, if the record was fitted on them; else none, and ``frozen_violations`` says so."""
    bad = frozen_violations(rows, record, order).select("rule_id")  # a row at most
    return rows.crossJoin(bad.agg(F.count("*").alias("_bad"))).where("_bad = 0").drop("_bad")


def replace_days(path: str, day: str = "day", at: str = "observed_at") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch's days replace those stored below ``path``, other days stay.

    A day that has several observations in the batch keeps the last. Days are partitions, and only those of the batch are
    written over, so a batch that comes again leaves the same table. Batches must come in the order of their observations.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != day]
        last = batch.groupBy(day).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("v")).select(day, "v.*")
        last.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)

    return apply


def upsert_daily(stored: DataFrame, observed: DataFrame, day: str = "day", at: str = "observed_at") -> DataFrame:
    """The last observation of each day; days that were not observed stay as they are.

    Of equal times the greatest of the other columns counts, so observing the same again changes nothing.
    """
    rest = [c for c in stored.columns if c not in (day, at)]
    rows = stored.unionByName(observed)
    return rows.groupBy(day).agg(F.max(F.struct(at, *rest)).alias("v")).select(day, "v.*").select(*stored.columns)
