"""Alignment rows: acceptance, placement of unresolved lines, and their refinement, as windows by recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators import selection

# Fixed values of the acceptance and placement rules.
MIN_SUPPORT, MIN_SIMILARITY, US_PER_CHAR = -3.5, 0.15, (40_000, 400_000)
NEIGHBOUR_SIMILARITY, NEIGHBOUR_RATE = 0.05, 1_000_000
EDGE_US_PER_LINE = 2_500_000


def _by_line(key: str, line: str) -> Window:
    return Window.partitionBy(key).orderBy(line)


def gate(support: Column, similarity: Column, rate: Column) -> Column:
    """Reasons against a proposal, an empty array if there are none (B17). Null support fails."""
    return F.array_compact(F.array(
        F.when(F.coalesce(support, F.lit(float("-inf"))) < MIN_SUPPORT, F.lit("weak_separated_support")),
        F.when(F.coalesce(similarity, F.lit(0.0)) < MIN_SIMILARITY, F.lit("weak_separated_lexical_agreement")),
        F.when(rate < US_PER_CHAR[0], F.lit("implausible_duration")),
        F.when(rate > US_PER_CHAR[1], F.lit("implausible_rate"))))


def proposal_flags(support: Column, similarity: Column, longest_char: Column, length: Column, repeated: Column) -> Column:
    """Diagnostics of a proposal (B16); the estimate is the proposal when nothing but repetition is flagged."""
    return F.array_compact(F.array(F.when(support < -3.0, F.lit("weak_support")), F.when(similarity < 0.55, F.lit("weak_lexical")), F.when(longest_char > 1_500_000, F.lit("extended_character")), F.when(length > 20_000_000, F.lit("extended_line")), F.when(repeated, F.lit("repeated"))))


def neighbour_acceptance(rows: DataFrame, key: str, line: str, base: str, rate: str, similarity: str, max_rate: float = NEIGHBOUR_RATE, min_similarity: float = NEIGHBOUR_SIMILARITY, to: str = "accepted") -> DataFrame:
    """Adds ``to``: base-accepted rows, and rejected ones framed by base-accepted neighbours.

    Both neighbours, or one and a similarity of at least ``min_similarity``; the rate is bounded. The neighbours'
    base flags decide, so that acceptance does not chain.
    """
    w = _by_line(key, line)
    before, after = F.coalesce(F.lag(base).over(w), F.lit(False)), F.coalesce(F.lead(base).over(w), F.lit(False))
    framed = (before & after) | ((before | after) & (F.coalesce(F.col(similarity), F.lit(0.0)) >= min_similarity))
    return rows.withColumn(to, F.col(base) | F.coalesce((F.col(rate) <= max_rate) & framed, F.lit(False)))


def next_begin(rows: DataFrame, key: str, line: str, begin: str, to: str = "following") -> DataFrame:
    """Adds the next non-null begin after each row."""
    w = _by_line(key, line).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(to, F.first(begin, ignorenulls=True).over(w))


def fill_unresolved(rows: DataFrame, key: str, line: str, begin: str, end: str, duration: str) -> DataFrame:
    """Adds ``fill_begin, fill_end`` to rows without an estimate: spread evenly between the neighbours.

    A run at the edge takes at most 2.5 s a line; a run of everything is anchored at the end. Steps are whole
    microseconds, and a fill begins one microsecond after its slot does.
    """
    w = _by_line(key, line)
    rows = rows.withColumns({
        "_run": F.count(begin).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_before": F.last(end, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first(begin, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)),
    })
    empty = F.col(begin).isNull()
    run = Window.partitionBy(key, "_run", empty)
    rows = rows.withColumns({"_n": F.count("*").over(run), "_k": F.row_number().over(run.orderBy(line)) - 1})
    stop = F.coalesce("_after", duration)
    first = F.coalesce("_before", F.greatest(F.lit(0), stop - F.col("_n") * EDGE_US_PER_LINE))
    rows = rows.withColumns({"_a": first, "_b": F.when(F.col("_after").isNull(), F.least(stop, first + F.col("_n") * EDGE_US_PER_LINE)).otherwise(stop)})
    rows = rows.withColumn("_step", F.expr("(_b - _a) div _n"))
    fill = lambda extra: F.when(empty, F.col("_a") + (F.col("_k") + extra) * F.col("_step"))
    return rows.withColumns({"fill_begin": fill(0) + 1, "fill_end": fill(1)}).drop("_run", "_before", "_after", "_n", "_k", "_a", "_b", "_step")


def relocate_boundary_runs(rows: DataFrame, components: DataFrame, key: str, line: str, begin: str, end: str, duration: str, protected: str | None = None) -> DataFrame:
    """Moves filled runs at the edge into the nearest unclaimed activity component that holds them.

    ``rows`` carry ``fill_begin, fill_end``; ``components(key, begin, end)`` are activity intervals. The nearest
    component within the free span is chosen first (the last one for a leading run, the first for a trailing
    one) and only then tested: it must be longer than the run and overlap no estimate. Runs between estimates,
    runs of everything, protected ones and those that already lie inside stay. Adds ``shift``.
    """
    w = _by_line(key, line)
    known = F.col(begin).isNotNull()
    rows = rows.withColumns({"_run": F.count(begin).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.count(begin).over(Window.partitionBy(key))})
    shy = F.max(F.col(protected).cast("int")) if protected else F.lit(0)
    edge = rows.where(~known & (F.col("_all") > 0) & ((F.col("_run") == 0) | (F.col("_run") == F.col("_all")))).groupBy(key, "_run").agg(F.min("fill_begin").alias("f"), F.max("fill_end").alias("l"), F.max(duration).alias("d"), shy.alias("shy"))
    ends = rows.where(known).groupBy(key).agg(F.min(F.struct(line, F.col(begin).alias("v"))).alias("lo"), F.max(F.struct(line, F.col(end).alias("v"))).alias("hi"))
    edge = edge.where("shy = 0").join(ends, key).withColumns({"lower": F.when(F.col("_run") == 0, F.lit(0)).otherwise(F.col("hi.v")), "upper": F.when(F.col("_run") == 0, F.col("lo.v")).otherwise(F.col("d"))})
    inside = components.select(key, F.col("begin").alias("cb"), F.col("end").alias("ce"))
    free = edge.join(inside, key).where("cb >= lower and ce <= upper")
    chosen = free.groupBy(key, "_run", "f", "l").agg(F.max(F.struct("cb", "ce")).alias("last"), F.min(F.struct("cb", "ce")).alias("first"))
    chosen = chosen.withColumn("c", F.when(F.col("_run") == 0, F.col("last")).otherwise(F.col("first")))
    fits = (F.col("l") > F.col("f")) & (F.col("c.ce") - F.col("c.cb") >= F.col("l") - F.col("f") + 1) & ~((F.col("c.cb") <= F.col("f")) & (F.col("l") <= F.col("c.ce")))
    taken = rows.where(known).select(key, F.col(begin).alias("tb"), F.col(end).alias("te"))
    moves = chosen.where(fits).select(key, "_run", F.col("c.cb").alias("cb"), F.col("c.ce").alias("ce"), (F.col("c.cb") + 1 - F.col("f")).alias("shift"))
    clash = moves.join(taken, key).where("greatest(cb, tb) < least(ce, te)").select(key, "_run").distinct()
    moves = moves.join(clash, [key, "_run"], "left_anti").select(key, "_run", "shift")
    out = rows.join(moves, [key, "_run"], "left").withColumn("shift", F.when(known, F.lit(0)).otherwise(F.coalesce("shift", F.lit(0))))
    return out.withColumns({"fill_begin": F.col("fill_begin") + F.col("shift"), "fill_end": F.col("fill_end") + F.col("shift")}).drop("_run", "_all")


def reject_overlaps(rows: DataFrame, key: str, line: str, accepted: str, begin: str, end: str, to: str = "overlap_rejected") -> DataFrame:
    """Adds ``to``: an accepted row that begins before the previous accepted one ends rejects both."""
    w = Window.partitionBy(key, accepted).orderBy(line)
    clash = (F.col(begin) < F.lag(end).over(w)) | (F.lead(begin).over(w) < F.col(end))
    return rows.withColumn(to, F.col(accepted) & F.coalesce(clash, F.lit(False)))


def refine_estimates(rows: DataFrame, frames: DataFrame, key: str = "recording_id", line: str = "line_id", frame_us: int = 20_000, onset_db: float = 30.0, offset_db: float = 20.0, most_extension: int = 600_000) -> DataFrame:
    """Onset trim and offset extension of accepted estimates by activity.

    ``rows`` carry ``begin_us, end_us, accepted, rate``; ``frames(key, frame_idx, level_db)``. The reference level is
    the interpolated 99th percentile; onset is the first frame above it less 30 dB (none: rejected), and the
    offset runs on through frames above it less 20 dB, by 0.6 s at most and not past the next proposal.
    """
    ref = selection.percentiles(frames, [key], "level_db", {"ref": 0.99}).drop("n")
    rows = next_begin(rows, key, line, "begin_us")
    limit = F.least(F.col("end_us") + most_extension, F.coalesce("following", F.col("end_us") + most_extension))
    spans = rows.where("accepted").select(key, line, "begin_us", "end_us", limit.alias("limit"), F.floor(F.col("begin_us") / frame_us).alias("f0"), F.floor((F.col("end_us") + frame_us - 1) / frame_us).alias("f1"))
    last = F.greatest("f1", F.floor((F.col("limit") + frame_us - 1) / frame_us))
    wanted = spans.withColumn("frame_idx", F.explode(F.sequence("f0", last)))
    met = wanted.join(frames, [key, "frame_idx"], "left").join(ref, key)
    loud = F.col("level_db") > F.col("ref") - onset_db
    quiet = F.coalesce(F.col("level_db") <= F.col("ref") - offset_db, F.lit(True)) | (F.col("frame_idx") * frame_us >= F.col("limit"))
    found = met.groupBy(key, line, "begin_us", "end_us", "limit").agg(F.min(F.when((F.col("frame_idx") < F.col("f1")) & loud, F.col("frame_idx"))).alias("on"), F.min(F.when((F.col("frame_idx") >= F.col("f1")) & quiet, F.col("frame_idx"))).alias("off"))
    onset = F.when(F.col("on").isNotNull(), F.greatest("begin_us", F.col("on") * frame_us))
    offset = F.least(F.greatest("end_us", F.coalesce(F.col("off") * frame_us, F.col("limit"))), F.greatest("end_us", "limit"))
    found = found.select(key, line, onset.alias("onset_us"), offset.alias("offset_us")).withColumn("kept", F.col("onset_us").isNotNull() & (F.col("onset_us") < F.col("offset_us")))
    out = rows.join(found, [key, line], "left")
    median = F.expr("percentile(case when accepted then rate end, 0.5)").over(Window.partitionBy(key))
    kept = F.coalesce("kept", F.lit(False))
    return out.withColumn("_m", median).withColumns({
        "estimate_begin": F.when(kept, F.col("onset_us")), "estimate_end": F.when(kept, F.col("offset_us")),
        "onset_trim": F.when(kept & (F.col("onset_us") > F.col("begin_us")), F.col("onset_us") - F.col("begin_us")),
        "offset_extension": F.when(kept & (F.col("offset_us") > F.col("end_us")), F.col("offset_us") - F.col("end_us")),
        "refine_flags": F.array_compact(F.array(F.when(F.col("accepted") & ~kept, F.lit("no_vocal_activity")), F.when(kept & (F.col("_m") > 0) & (F.col("rate") > 1.75 * F.col("_m")), F.lit("uncertain_boundary")))),
    }).drop("_m", "kept", "onset_us", "offset_us", "following")


def clamp_words(words: Column, onset: Column, offset: Column) -> Column:
    """Word spans (array of start, length, begin_us, end_us) inside a refined line, or null if one would vanish.

    The first word begins at the onset and the last ends at the offset; the others are pushed behind their
    predecessor.
    """
    kind = "array<struct<begin_us:bigint,end_us:bigint>>"
    first = F.struct(F.lit(0).alias("k"), onset.alias("previous"), F.lit(True).alias("good"), F.array().cast(kind).alias("out"))

    def step(s: Column, w: Column) -> Column:
        a = F.when(s["k"] == 0, onset).otherwise(F.greatest(w["begin_us"], s["previous"]))
        b = F.when(s["k"] == F.size(words) - 1, offset).otherwise(F.least(F.greatest(w["end_us"], a), offset))
        return F.struct((s["k"] + 1).alias("k"), b.alias("previous"), (s["good"] & (a < b)).alias("good"), F.concat(s["out"], F.array(F.struct(a.alias("begin_us"), b.alias("end_us")))).alias("out"))

    return F.when(F.size(words) > 0, F.aggregate(words, first, step, lambda s: F.when(s["good"], s["out"])))


def trim_to_next(rows: DataFrame, key: str, line: str, begin: str, end: str) -> DataFrame:
    """A line ends where the next begins, if that is earlier."""
    return rows.withColumn(end, F.least(end, F.lead(begin).over(_by_line(key, line))))


def status(estimate: Column, fill: Column, omitted: Column) -> Column:
    """``aligned``, ``omitted`` or ``placed``."""
    return F.when(estimate.isNotNull(), F.lit("aligned")).when(omitted | fill.isNull(), F.lit("omitted")).otherwise(F.lit("placed"))


def refinement_window(begin: Column, end: Column, duration: Column, pad: int = 1_000_000, grid: int = 20_000) -> Column:
    """Padded by a second, clamped to the audio, snapped down to the grid."""
    snap = lambda t: (F.floor(t / grid) * grid).cast("bigint")
    return F.struct(snap(F.greatest(F.lit(0), begin - pad)).alias("begin"), snap(F.least(duration, end + pad)).alias("end"))


def effective(correction: Column, estimate: Column) -> Column:
    """A correction before an estimate."""
    return F.coalesce(correction, estimate)


def review_flag(value: Column, threshold, unresolved: Column) -> Column:
    """``not_flagged`` at or above the threshold; unavailable or unresolved is for review."""
    return F.when(unresolved | value.isNull() | F.isnan(value) | (value < threshold), F.lit("review_required")).otherwise(F.lit("not_flagged"))


def support_class(begin: Column, end: Column, first: Column, last: Column) -> Column:
    """``missing``, ``invalid``, ``out_of_window`` or ``valid`` support of a recognised interval."""
    return F.when(begin.isNull() | end.isNull(), F.lit("missing")).when((begin < 0) | (begin >= end), F.lit("invalid")).when((begin < first) | (end > last), F.lit("out_of_window")).otherwise(F.lit("valid"))


def apply_refinement(rows: DataFrame, local: DataFrame, key: str = "recording_id", line: str = "line_id", edge_us: int = 100_000) -> DataFrame:
    """Local refinements in source time: censored near the window's edge, rejected outside the anchor.

    ``local(key, line, local_begin, local_end, origin, stop)`` is relative to ``origin``; rows carry the anchor
    ``begin_us, end_us`` and ``flags``.
    """
    met = rows.join(local, [key, line], "left")
    a, b = F.col("local_begin") + F.col("origin"), F.col("local_end") + F.col("origin")
    outside = (b <= F.col("begin_us")) | (a >= F.col("end_us"))
    censored = (F.col("local_begin") < edge_us) | (F.col("stop") - b < edge_us)
    more = F.array_compact(F.array(F.when(outside, F.lit("refinement_outside_anchor")), F.when(~outside & censored, F.lit("censored_refinement"))))
    kept = a.isNotNull() & ~outside
    return met.withColumns({"refined_begin": F.when(kept, a), "refined_end": F.when(kept, b), "flags": F.array_union("flags", more)}).select(*rows.columns, "refined_begin", "refined_end")


def alternating_split(rows: DataFrame, key, order: str, block: int = 1, to: str = "held_out") -> DataFrame:
    """Every other row, or block of rows, is held out."""
    k = [key] if isinstance(key, str) else list(key)
    i = F.row_number().over(Window.partitionBy(*k).orderBy(order)) - 1
    return rows.withColumn(to, F.floor(i / block) % 2 == 1)
