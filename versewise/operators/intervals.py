"""Interval algebra over half-open ``[begin, end)`` intervals and the joins in time.

Tables have one or more key columns; every operator works within a key, in one shuffle on it. Ties are broken by
explicit columns, so results do not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def overlaps(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Strict overlap of half-open intervals: touching ones do not overlap."""
    return F.least(e1, e2) > F.greatest(b1, b2)


def islands(rows: DataFrame, key, order: str, gap: int | float, to: str = "island", ties: Sequence[str] = ()) -> DataFrame:
    """Adds ``to``: the number of the run a row belongs to; a step of more than ``gap`` begins a new one (E5)."""
    w = Window.partitionBy(*_keys(key)).orderBy(order, *ties)
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(to, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(rows: DataFrame, key, order: str, gap: int | float, minimum: int = 1) -> DataFrame:
    """``(key, first, last, n)`` of the runs of at least ``minimum`` rows."""
    k = _keys(key)
    grouped = islands(rows, k, order, gap).groupBy(*k, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return grouped.where(F.col("n") >= minimum).drop("island")


def active_intervals(frames: DataFrame, key, step: int, duration: str | None = None, idx: str = "frame_idx", active: str = "active") -> DataFrame:
    """Runs of active frames as ``(key, begin, end)``, the last one clipped to the duration (E5)."""
    k = _keys(key)
    w = Window.partitionBy(*k).orderBy(idx)
    rows = frames.where(active).withColumn("_g", F.col(idx) - F.row_number().over(w))
    out = rows.groupBy(*k, "_g").agg((F.min(idx) * step).alias("begin"), ((F.max(idx) + 1) * step).alias("end"), *([F.max(duration).alias("_d")] if duration else []))
    end = F.least("end", "_d") if duration else F.col("end")
    return out.select(*k, "begin", end.alias("end")).where("begin < end")


def merge_intervals(rows: DataFrame, key, begin: str = "begin", end: str = "end") -> DataFrame:
    """Union of intervals; those that touch merge (E6). Empty and null intervals are left out."""
    k = _keys(key)
    rows = rows.where(F.col(begin) < F.col(end))
    w = Window.partitionBy(*k).orderBy(begin, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(before.isNull() | (F.col(begin) > before), 1).otherwise(0))
    marked = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*k, "_g").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("_g")


def _sweep(left: DataFrame, right: DataFrame, keep: Column, k: list[str], begin: str, end: str) -> DataFrame:
    """Pieces between neighbouring bounds where ``keep`` holds of the depths ``l`` and ``r``, merged."""
    def bounds(rows: DataFrame, l: int, r: int) -> DataFrame:
        rows = rows.where(F.col(begin) < F.col(end))
        up = rows.select(*k, F.col(begin).alias("t"), F.lit(l).alias("l"), F.lit(r).alias("r"))
        return up.union(rows.select(*k, F.col(end).alias("t"), F.lit(-l).alias("l"), F.lit(-r).alias("r")))

    at = bounds(left, 1, 0).union(bounds(right, 0, 1)).groupBy(*k, "t").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    w = Window.partitionBy(*k).orderBy("t")
    depth = w.rowsBetween(Window.unboundedPreceding, 0)
    pieces = at.select(*k, F.col("t").alias(begin), F.lead("t").over(w).alias(end), F.sum("l").over(depth).alias("l"), F.sum("r").over(depth).alias("r"))
    return merge_intervals(pieces.where(keep & F.col(end).isNotNull()).select(*k, begin, end), k, begin, end)


def difference(left: DataFrame, right: DataFrame, key, begin: str = "begin", end: str = "end") -> DataFrame:
    """What the left intervals cover and the right ones do not, merged."""
    return _sweep(left, right, (F.col("l") > 0) & (F.col("r") == 0), _keys(key), begin, end)


def intersection(left: DataFrame, right: DataFrame, key, begin: str = "begin", end: str = "end") -> DataFrame:
    """What both cover, merged."""
    return _sweep(left, right, (F.col("l") > 0) & (F.col("r") > 0), _keys(key), begin, end)


def complement(rows: DataFrame, key, spans: DataFrame, begin: str = "begin", end: str = "end") -> DataFrame:
    """What the intervals leave of each key's whole span in ``spans(key, begin, end)``."""
    return difference(spans, rows, key, begin, end)


def gaps(rows: DataFrame, key, minimum: int = 0, start: int = 0, begin: str = "begin", end: str = "end") -> DataFrame:
    """Silences of at least ``minimum`` before an interval, the first from ``start``."""
    k = _keys(key)
    w = Window.partitionBy(*k).orderBy(begin, end)
    before = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(start))
    return rows.select(*k, before.alias("gap_begin"), F.col(begin).alias("gap_end")).where((F.col("gap_end") - F.col("gap_begin") >= minimum) & (F.col("gap_end") > F.col("gap_begin")))


def coverage(activity: DataFrame, estimated: DataFrame, key) -> DataFrame:
    """``(key, activity, estimated, shared, uncovered, excess, score)``: two asymmetric shares, the score the larger.

    ``uncovered`` is the share of activity outside the estimate and ``excess`` the share of the estimate outside
    activity; null where the denominator is 0.
    """
    k = _keys(key)
    size = lambda rows, name: merge_intervals(rows, k).groupBy(*k).agg(F.sum(F.col("end") - F.col("begin")).alias(name))
    whole = size(activity, "activity").join(size(estimated, "estimated"), k, "full").join(size(intersection(activity, estimated, k), "shared"), k, "left")
    whole = whole.select(*k, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("activity", "estimated", "shared")])
    outside = lambda c: F.when(F.col(c) > 0, (F.col(c) - F.col("shared")) / F.col(c))
    return whole.withColumns({"uncovered": outside("activity"), "excess": outside("estimated")}).withColumn("score", F.greatest("uncovered", "excess"))


def _level(length: Column, width: int) -> Column:
    """The least n with ``length <= width * 2^n``: an interval lies in two buckets at most of its level."""
    n = F.greatest(F.lit(0), F.ceil(F.log2(length / F.lit(width))).cast("int"))
    return F.when(length > F.lit(width) * F.pow(F.lit(2.0), n), n + 1).otherwise(n)  # the logarithm is rounded


def _levels(rows: DataFrame, length: Column, width: int) -> list[int]:
    """The levels that intervals have: one number a doubling of their length, so at most 63."""
    return sorted(r.n for r in rows.select(_level(length, width).alias("n")).distinct().collect())


def _bucket(t: Column, level: Column, width: int) -> Column:
    return F.floor(t / F.lit(width) / F.pow(F.lit(2.0), level)).cast("long")


def _dealt(rows: DataFrame, begin: str, end: str, levels: Column, width: int) -> DataFrame:
    """A row for each level and bucket that an interval touches."""
    rows = rows.withColumn("_level", F.explode(levels))
    return rows.withColumn("_bucket", F.explode(F.sequence(_bucket(F.col(begin), F.col("_level"), width), _bucket(F.col(end) - 1, F.col("_level"), width))))


def overlap_join(left: DataFrame, right: DataFrame, key, width: int, condition: Column | None = None) -> DataFrame:
    """Pairs of intervals that overlap strictly, as ``l.*`` and ``r.*`` columns with prefixes ``l_`` and ``r_``.

    Buckets are dyadic: ``width`` doubled as often as an interval is long. An interval is at home in the two buckets at most
    that it touches at its own level, and looks into those of coarser levels that the other side has. So a row is dealt at
    most twice a level, however unlike the lengths. Homes meet homes and visitors; a pair is kept in the bucket where the
    later of the two begins, so that none is repeated. ``width`` should be near the shorter lengths.
    """
    k = _keys(key)
    pre = lambda rows, p: rows.select(*[F.col(c).alias(c if c in k else f"{p}_{c}") for c in rows.columns])
    l, r = pre(left, "l").where("l_begin < l_end"), pre(right, "r").where("r_begin < r_end")
    own = {p: _level(F.col(f"{p}_end") - F.col(f"{p}_begin"), width) for p in "lr"}
    levels = {p: _levels(rows, F.col(f"{p}_end") - F.col(f"{p}_begin"), width) for p, rows in (("l", l), ("r", r))}
    coarser = lambda p, other, equal: F.filter(F.array(*map(F.lit, levels[other])).cast("array<int>"), lambda n: n >= own[p] if equal else n > own[p])
    home = lambda rows, p: _dealt(rows, f"{p}_begin", f"{p}_end", F.array(own[p]), width)
    visits = lambda rows, p, other, equal: _dealt(rows, f"{p}_begin", f"{p}_end", coarser(p, other, equal), width)
    met = home(l, "l").join(visits(r, "r", "l", True), [*k, "_level", "_bucket"]).unionByName(visits(l, "l", "r", False).join(home(r, "r"), [*k, "_level", "_bucket"]))
    ok = overlaps(F.col("l_begin"), F.col("l_end"), F.col("r_begin"), F.col("r_end")) & (_bucket(F.greatest("l_begin", "r_begin"), F.col("_level"), width) == F.col("_bucket"))
    return met.where(ok if condition is None else ok & condition).drop("_level", "_bucket")


def points_in_intervals(points: DataFrame, spans: DataFrame, key, width: int, t: str = "t", begin: str = "begin", end: str = "end") -> DataFrame:
    """Points joined to the intervals that hold them, ``begin <= t < end``.

    Intervals are dealt to the two dyadic buckets at most of their own level (see ``overlap_join``), points to one a level.
    """
    k = _keys(key)
    spans = spans.where(F.col(begin) < F.col(end))
    length = F.col(end) - F.col(begin)
    dealt = _dealt(spans, begin, end, F.array(_level(length, width)), width)
    levels = F.array(*map(F.lit, _levels(spans, length, width))).cast("array<int>")
    at = points.withColumn("_level", F.explode(levels)).withColumn("_bucket", _bucket(F.col(t), F.col("_level"), width))
    met = at.join(dealt, [*k, "_level", "_bucket"])
    return met.where((F.col(begin) <= F.col(t)) & (F.col(t) < F.col(end))).drop("_level", "_bucket")


def asof_join(left: DataFrame, right: DataFrame, key, t: str, values: Sequence[str], right_first: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Left rows with the ``values`` of the last right row at or before their time, or nulls (C4).

    One union and one window a key: no range join and no row explosion. ``right_first``: a right row at the same
    time counts. Among right rows of one time the last by ``ties`` counts.
    """
    k = _keys(key)
    rest = [c for c in left.columns if c not in {*k, t}]
    value = F.struct(*[F.col(c) for c in values])
    a = left.select(*k, t, F.struct(*rest).alias("_l") if rest else F.lit(None).alias("_l"), F.lit(None).cast(right.select(value.alias("v")).schema[0].dataType).alias("_r"), F.lit(1 if right_first else 0).alias("_side"), *[F.lit(None).cast(right.schema[c].dataType).alias(f"_t{i}") for i, c in enumerate(ties)])
    b = right.select(*k, t, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), value.alias("_r"), F.lit(0 if right_first else 1).alias("_side"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)])
    w = Window.partitionBy(*k).orderBy(t, "_side", *[f"_t{i}" for i in range(len(ties))]).rowsBetween(Window.unboundedPreceding, 0)
    rows = a.union(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    rows = rows.where(F.col("_side") == (1 if right_first else 0))
    return rows.select(*k, t, *[F.col(f"_l.{c}") for c in rest], *[F.col(f"_r.{c}").alias(c) for c in values])


def media_time(output: Column, anchor_output: Column, anchor_media: Column, running: Column) -> Column:
    """Media time of an output time after the last clock event."""
    return anchor_media + F.when(running, output - anchor_output).otherwise(0)


def near_pairs(left: DataFrame, right: DataFrame, key, tolerance: int, t: str = "t", id_: str = "id") -> DataFrame:
    """Pairs within ``tolerance`` of each other: ``(key, l_id, l_t, r_id, r_t)``, through buckets."""
    k = _keys(key)
    step = tolerance + 1
    a = left.select(*k, F.col(id_).alias("l_id"), F.col(t).alias("l_t")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("l_t") / step) + d for d in (-1, 0, 1)])))
    b = right.select(*k, F.col(id_).alias("r_id"), F.col(t).alias("r_t")).withColumn("_b", F.floor(F.col("r_t") / step))
    return a.join(b, [*k, "_b"]).where(F.abs(F.col("l_t") - F.col("r_t")) <= tolerance).drop("_b")


def nearest(left: DataFrame, right: DataFrame, key, tolerance: int, mutual: bool = False, t: str = "t", id_: str = "id") -> DataFrame:
    """Each left event's nearest right event within ``tolerance``; with ``mutual`` only pairs nearest both ways.

    Ties: the earlier event, then the smaller id (C7, C8).
    """
    pairs = near_pairs(left, right, key, tolerance, t, id_)
    k = _keys(key)
    dist = F.abs(F.col("l_t") - F.col("r_t"))
    of = lambda mine, other: F.row_number().over(Window.partitionBy(*k, f"{mine}_id").orderBy(dist, f"{other}_t", f"{other}_id"))
    ranked = pairs.withColumn("_l", of("l", "r"))
    if mutual:
        return ranked.withColumn("_r", of("r", "l")).where("_l = 1 and _r = 1").drop("_l", "_r")
    return ranked.where("_l = 1").drop("_l")


def greedy_nearest(left: DataFrame, right: DataFrame, key, tolerance: int, t: str = "t", id_: str = "id") -> DataFrame:
    """One-to-one: left events in time order each take the nearest unused right event within ``tolerance``.

    Ties go to the earlier right event, then the smaller id. A left event is sure of its nearest unused right one if no earlier
    left event, still open, could take that; so in each round every open pair that is first in this way is settled, of all keys
    and stretches at once, and what it uses is left out. There are as many rounds as the longest chain of events that wait for
    each other; each goes to a checkpoint. Ids must differ within a key.
    """
    k = _keys(key)
    open_ = near_pairs(left, right, key, tolerance, t, id_)
    names = open_.columns
    mine, theirs = Window.partitionBy(*k, "l_id"), Window.partitionBy(*k, "r_id")
    best = F.row_number().over(mine.orderBy(F.abs(F.col("l_t") - F.col("r_t")), "r_t", "r_id")) == 1
    first = F.row_number().over(theirs.orderBy("l_t", "l_id")) == 1
    settled = None
    while True:
        marked = open_.withColumn("_best", best).withColumn("_sure", F.col("_best") & first).withColumn("_used", F.max("_sure").over(theirs)).withColumn("_done", F.max("_sure").over(mine))
        marked = marked.where("_sure or not (_used or _done)").select(*names, "_sure").checkpoint()
        done, open_ = marked.where("_sure").select(names), marked.where("not _sure").select(names)
        settled = done if settled is None else settled.unionByName(done)
        if open_.isEmpty():
            return settled


def not_contained(inner: DataFrame, outer: DataFrame, key, width: int) -> DataFrame:
    """Intervals that no single outer interval holds whole (C14)."""
    k = _keys(key)
    held = overlap_join(inner, outer, k, width, (F.col("r_begin") <= F.col("l_begin")) & (F.col("l_end") <= F.col("r_end")))
    return inner.join(held.select(*k, F.col("l_begin").alias("begin"), F.col("l_end").alias("end")).distinct(), [*k, "begin", "end"], "left_anti")


def windows_of_lines(lines: DataFrame, windows: DataFrame, key, width: int) -> DataFrame:
    """Lines with the analysis windows that they intersect."""
    return overlap_join(lines, windows, key, width)
