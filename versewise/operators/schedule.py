"""Schedules of timed lines: ends, focus, departures, analysis windows and sampling on a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def implicit_ends(rows: DataFrame, key: str, begin: str, end: str, duration, ties: tuple = (), to: str = "until") -> DataFrame:
    """The explicit end, else the next onset, else the end of the audio."""
    w = Window.partitionBy(key).orderBy(begin, *ties)
    return rows.withColumn(to, F.coalesce(end, F.lead(begin).over(w), duration))


def focus_schedule(rows: DataFrame, key: str, begin: str, lead_us: int, ties: tuple = (), to: str = "focus_at") -> DataFrame:
    """Focus moves ahead of an onset by the lead, or half the interval from the last onset if less; never back."""
    w = Window.partitionBy(key).orderBy(begin, *ties)
    step = F.col(begin) - F.coalesce(F.lag(begin).over(w), F.lit(0))
    at = F.col(begin) - F.least(F.lit(lead_us), F.floor(step / 2)).cast("bigint")
    return rows.withColumn("_at", at).withColumn(to, F.max("_at").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_at")


def departures(events: DataFrame, key: str, t: str, order: str, stop, to: str = "departs_at") -> DataFrame:
    """When the next event of any kind comes, clipped to the end."""
    return events.withColumn(to, F.least(F.coalesce(F.lead(t).over(Window.partitionBy(key).orderBy(t, order)), stop), stop))


def compress_to_deadline(rows: DataFrame, key, idx: str, begin: str, end: str, deadline: str) -> DataFrame:
    """Word intervals that run past a deadline share what is left equally; earlier ones stay.

    The suffix begins at the first word that ends after the deadline, or before it as far as needed for the
    shared part to begin before the deadline. Whole microseconds.
    """
    k = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*k)
    late = F.min(F.when(F.col(end) > F.col(deadline), F.col(idx))).over(w)
    room = F.max(F.when(F.col(begin) < F.col(deadline), F.col(idx))).over(w)
    rows = rows.withColumn("_s", F.least(late, F.coalesce(room, late)))
    suffix = F.col(idx) >= F.col("_s")
    rows = rows.withColumns({"_n": F.sum(F.when(suffix, 1).otherwise(0)).over(w), "_from": F.min(F.when(suffix, F.col(begin))).over(w)})
    part = lambda i: F.col("_from") + F.expr(f"(({deadline} - _from) * ({i})) div _n")
    return rows.withColumns({"new_begin": F.when(suffix, part(f"{idx} - _s")).otherwise(F.col(begin)), "new_end": F.when(suffix, part(f"{idx} - _s + 1")).otherwise(F.col(end))}).drop("_s", "_n", "_from")


def analysis_windows(spans: DataFrame, key: str, duration: str, size: int, stride: int) -> DataFrame:
    """Overlapping windows with the part each owns: half of every overlap goes to either side."""
    n = F.greatest(F.lit(0), F.ceil((F.col(duration) - size) / stride)).cast("bigint")
    rows = spans.select(key, duration, F.posexplode(F.sequence(F.lit(0), n)).alias("window", "i"))
    rows = rows.select(key, "window", (F.col("i") * stride).cast("bigint").alias("begin"), F.least(F.col(duration), F.col("i") * stride + size).cast("bigint").alias("end"))
    w = Window.partitionBy(key).orderBy("window")
    keep_begin = F.coalesce(F.floor((F.lag("end").over(w) + F.col("begin")) / 2), F.col("begin"))
    keep_end = F.coalesce(F.floor((F.col("end") + F.lead("begin").over(w)) / 2), F.col("end"))
    return rows.select(key, "window", "begin", "end", keep_begin.cast("bigint").alias("keep_begin"), keep_end.cast("bigint").alias("keep_end"))


def owned_frames(windows: DataFrame, frames: DataFrame, key: str, t: str) -> DataFrame:
    """Frames of overlapping windows, each kept by its one owner."""
    return frames.join(windows.select(key, "window", "keep_begin", "keep_end"), [key, "window"]).where(F.col(t).between(F.col("keep_begin"), F.col("keep_end") - 1))


def ownership_faults(owned: DataFrame, key: str, idx: str) -> DataFrame:
    """Keys whose owned frames have a gap or a duplicate."""
    return owned.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(idx).alias("d"), (F.max(idx) - F.min(idx) + 1).alias("span")).where("n <> d or d <> span")


def sample_grid(entries: DataFrame, spans: DataFrame, key: str, step: int, begin: str, values: list[str], end: str | None = None, ties: tuple = ()) -> DataFrame:
    """What is in focus at every step of each key's span: the last entry at or before, null past its end.

    Entries alone are shuffled and sorted, after a row of their key with its spans: each row then gives the steps up to the next.
    An entry without a time is at no step.
    """
    span = "array<struct<begin:long,end:long>>"
    held = F.struct(F.col(begin).alias("entry_t"), *values)
    rows = entries.where(F.col(begin).isNotNull()).select(key, F.col(begin).alias("_at"), held.alias("_v"), F.lit(None).cast(span).alias("_spans"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)])
    heads = spans.groupBy(key).agg(F.collect_list(F.struct("begin", "end")).cast(span).alias("_spans"))
    heads = heads.select(key, *["_spans" if c.name == "_spans" else F.lit(None).cast(c.dataType).alias(c.name) for c in rows.schema[1:]])
    w = Window.partitionBy(key).orderBy(F.col("_at").asc_nulls_first(), *[f"_t{i}" for i in range(len(ties))])
    rows = rows.union(heads).withColumns({"_spans": F.last("_spans", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_at").over(w)})
    nth = lambda at, s: F.call_function("div", F.greatest(F.lit(0).cast("long"), F.ceil(at) - s["begin"]) + (step - 1), F.lit(step).cast("long"))  # noqa: E731  the first step at or after; of null the first

    def steps(s: Column) -> Column:
        low, high = nth(F.col("_at"), s), F.floor((s["end"] - s["begin"]) / step)
        high = F.least(high, F.when(F.col("_next").isNotNull(), nth(F.col("_next"), s) - 1))  # beside a null least takes the other
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda i: s["begin"] + i * step)).otherwise(F.array().cast("array<long>"))

    rows = rows.select(key, "_v", F.explode(F.flatten(F.transform("_spans", steps))).alias("t"))
    rows = rows.select(key, "t", *[F.col(f"_v.{c}").alias(c) for c in ["entry_t", *values]])
    if end is None:
        return rows
    live = F.col(end).isNull() | (F.col("t") < F.col(end))
    return rows.select(key, "t", *[F.when(live, F.col(c)).alias(c) for c in ["entry_t", *values]])


def contexts(paragraphs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """A paragraph between the one before and the one after it."""
    w = Window.partitionBy(key).orderBy(order)
    return paragraphs.withColumn("context", F.concat_ws("\n\n", F.lag(text).over(w), F.col(text), F.lead(text).over(w)))


def balanced_chunks(lines: DataFrame, key, order: str, most: int = 4) -> DataFrame:
    """Adds ``chunk``: the fewest chunks of at most ``most`` lines, the earlier ones taking the extra line."""
    k = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*k)
    rows = lines.withColumns({"_n": F.count("*").over(w), "_i": F.row_number().over(w.orderBy(order)) - 1})
    rows = rows.withColumn("_p", F.expr(f"(_n + {most - 1}) div {most}"))
    rows = rows.withColumns({"_size": F.expr("_n div _p"), "_extra": F.expr("_n % _p")})
    chunk = F.expr("case when _i < _extra * (_size + 1) then _i div (_size + 1) else _extra + (_i - _extra * (_size + 1)) div _size end")
    return rows.withColumn("chunk", chunk.cast("bigint")).drop("_n", "_i", "_p", "_size", "_extra")


def even_split(words: DataFrame, key, idx: str, length: str, begin, end) -> DataFrame:
    """A line's interval split over its words by their lengths."""
    k = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*k)
    upto = F.sum(length).over(w.orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(length).over(w)
    at = lambda n: begin + (end - begin) * n / whole
    return words.withColumns({"split_begin": at(upto - F.col(length)), "split_end": at(upto)})


def shift_offsets(offset_us, *columns: Column) -> list[Column]:
    """A constant offset over times."""
    return [c + offset_us for c in columns]
