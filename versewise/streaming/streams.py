"""Streaming forms of the batch rules (J1-J5): the same columns, with watermarks where state must end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hopping_counts(events: DataFrame, ts: str, by: str, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in hopping windows; rows later than the watermark are not counted."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(by, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n", "total")


def tumbling_levels(samples: DataFrame, ts: str, key: str, value: str, size: str = "20 milliseconds", late: str = "1 second") -> DataFrame:
    """RMS level of tumbling frames in dB."""
    level = 20 * F.log10(F.sqrt(F.avg(F.col(value) * F.col(value)) + 1e-12))
    return samples.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(level.alias("level_db")).select(key, F.col("w.start").alias("begin"), "level_db")


def session_runs(events: DataFrame, ts: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Activity runs that a gap closes."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def daily_upsert(path: str, day: str = "day", at: str = "observed_at", values: tuple[str, ...] = ("count",)) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the last observation of each day below ``path``.

    Each batch writes one version folder, named by its batch, from the version before and the batch; a batch that is
    repeated writes the same version again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(day, at, *values)
        if number > 0:
            rows = spark.read.parquet(f"{path}/version={number - 1}").select(day, at, *values).unionByName(rows)
        last = rows.groupBy(day).agg(F.max_by(F.struct(at, *values), F.struct(at, *values)).alias("v")).select(day, "v.*")
        last.write.mode("overwrite").parquet(f"{path}/version={number}")

    return apply


def exact_repeats_dropped(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Exact repeats within the watermark come through once."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def live_focus(events: DataFrame, key: str, ts: str, text: str, hold_seconds: int, late: str = "10 seconds") -> DataFrame:
    """``(key, at, text, state)``: the last onset of each recording, and its expiry in event time.

    An onset that is older than the one in focus as its step began is left out; of equal times the greatest text is in focus.
    Nothing depends on the order of a step's rows, which come in batches of any size. A focus expires ``hold_seconds`` after
    its onset unless a later onset replaced it.
    """
    rank = lambda at, value: (at, value is None, value or "")

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = first = state.get if state.exists else None
        frame = lambda out: pd.DataFrame(out, columns=["key", "at", "text", "state"])
        if state.hasTimedOut:
            state.remove()
            yield frame([(name[0], pd.Timestamp(held[0], unit="us"), held[1], "expired")])
            return
        for rows in batches:
            out = []
            for at, value in rows[[ts, text]].itertuples(index=False):
                us = at.value // 1000
                if first is None or us >= first[0]:
                    held = (us, value) if held is None else max(held, (us, value), key=lambda x: rank(*x))
                    out.append((name[0], at, value, "focused"))
            yield frame(out)
        state.update(held)
        wake = held[0] // 1000 + hold_seconds * 1000
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)[key]
    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"key {kind}, at timestamp, text string, state string", "us long, text string", "append", GroupStateTimeout.EventTimeTimeout)


def split_late(path: str, ts: str, late_seconds: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows behind the greatest time seen less the delay go to ``late``, others to ``ok``.

    The greatest time is taken over the rows stored so far, so nothing is dropped and batches may be repeated.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = f"{path}/marks"
        try:
            seen = spark.read.parquet(marks).where(F.col("batch") < number).agg(F.max("top").alias("top")).first().top
        except Exception as missing:  # the first batch has no marks yet
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            seen = None
        behind = F.lit(False) if seen is None else F.col(ts) < F.lit(seen) - F.expr(f"interval {late_seconds} seconds")
        batch.where(~behind).write.mode("overwrite").parquet(f"{path}/ok/batch={number}")
        batch.where(behind).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(ts).alias("top")).withColumn("batch", F.lit(number)).write.mode("append").parquet(marks)

    return apply
