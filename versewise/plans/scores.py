"""Scores of alignments against references: positional joins, errors, repeats, qualification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.functions import text as tx
from versewise.functions.text import is_vocable
from versewise.operators import intervals as iv, schedule, stats

KEY = ["recording_id", "line_id"]


def positional_join(report: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, violations): rows matched by occurrence, their texts checked and never used as a key.

    Both sides carry ``recording_id, line_id, text, begin_us, end_us``.
    """
    name = lambda rows, p: rows.select(*KEY, *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in KEY])
    both = name(report, "est").join(name(reference, "ref"), KEY, "full")
    rule = F.when(F.col("ref_text").isNull(), F.lit("missing_in_reference")).when(F.col("est_text").isNull(), F.lit("missing_in_report")).when(F.col("est_text") != F.col("ref_text"), F.lit("text_mismatch"))
    judged = both.withColumn("rule_id", rule)
    return judged.where("rule_id is null").drop("rule_id"), judged.where("rule_id is not null").select("recording_id", F.col("line_id").cast("string").alias("row"), "rule_id")


def wrong_repeats(pairs: DataFrame) -> DataFrame:
    """Lines whose estimate misses its own reference but overlaps another of the same text."""
    own = iv.overlaps(F.col("est_begin_us"), F.col("est_end_us"), F.col("ref_begin_us"), F.col("ref_end_us"))
    missed = pairs.where(F.col("est_begin_us").isNotNull() & ~own)
    others = pairs.select("recording_id", F.col("ref_text").alias("_text"), F.col("line_id").alias("_line"), F.col("ref_begin_us").alias("_b"), F.col("ref_end_us").alias("_e"))
    same = (missed.recording_id == others.recording_id) & (F.col("ref_text") == F.col("_text")) & (F.col("line_id") != F.col("_line")) & iv.overlaps(F.col("est_begin_us"), F.col("est_end_us"), F.col("_b"), F.col("_e"))
    return missed.join(others, same, "left_semi")


def full_song_score(pairs: DataFrame) -> DataFrame:
    """Per recording: lines, placed, overlapping, and error summaries of onsets and offsets in ms."""
    placed = F.col("est_begin_us").isNotNull()
    hit = placed & iv.overlaps(F.col("est_begin_us"), F.col("est_end_us"), F.col("ref_begin_us"), F.col("ref_end_us"))
    errors = pairs.withColumns({"on": (F.col("est_begin_us") - F.col("ref_begin_us")) / 1000, "off": (F.col("est_end_us") - F.col("ref_end_us")) / 1000})
    named = lambda c: [x.alias(f"{c}_{n}") for x, n in zip(stats.error_summary(F.col(c)), ("n", "median", "p95", "mae", "worst", "late"))]
    wrong = wrong_repeats(pairs).groupBy("recording_id").agg(F.count("*").alias("wrong_repeats"))
    out = errors.groupBy("recording_id").agg(F.count("*").alias("lines"), F.count_if(placed).alias("placed"), F.count_if(hit).alias("overlapping"), *named("on"), *named("off"))
    return out.join(wrong, "recording_id", "left").withColumn("wrong_repeats", F.coalesce("wrong_repeats", F.lit(0)))


def coverage_diagnostic(lines: DataFrame, activities: dict[str, DataFrame], texts: DataFrame) -> DataFrame:
    """Whether estimates cover what an audio-only model hears: scores to look at, never an acceptance (I8: E6, E7, D9, H9).

    ``lines(recording_id, line_id, begin, end)`` with null bounds where unresolved; ``activities`` by name, intervals
    ``(recording_id, begin, end)``; ``texts(recording_id, language, source_text, greedy_text)``. A row a recording of ``texts``:
    ``unresolved`` lines, ``<name>_uncovered, <name>_excess, <name>_score`` of each activity, and ``lexical_score``, the
    disagreement of the canonical texts, in English alone.
    """
    key = "recording_id"
    lexical = F.when(F.col("language") == "en", tx.disagreement(tx.canonical(F.col("source_text")), tx.canonical(F.col("greedy_text"))))
    open_ = lines.groupBy(key).agg(F.count_if(F.col("begin").isNull() | F.col("end").isNull()).alias("unresolved"))
    out = texts.select(key, lexical.alias("lexical_score")).join(open_, key, "left").fillna(0, ["unresolved"])
    placed = lines.where("begin is not null and end is not null").select(key, "begin", "end")
    for name, activity in activities.items():
        c = iv.coverage(activity.select(key, "begin", "end"), placed, key)
        out = out.join(c.select(key, *[F.col(x).alias(f"{name}_{x}") for x in ("uncovered", "excess", "score")]), key, "left")
    return out


def qualification(pairs: DataFrame, kind: str | None = None) -> DataFrame:
    """Pooled and per-recording rates of placement by overlap; vocable lines are counted apart."""
    rows = pairs.withColumns({"vocable": is_vocable(F.col("ref_text")), "placed": F.col("est_begin_us").isNotNull()})
    hit = F.coalesce(iv.overlaps(F.col("est_begin_us"), F.col("est_end_us"), F.col("ref_begin_us"), F.col("ref_end_us")), F.lit(False))
    sung = ~F.col("vocable")
    n = F.count_if(sung)
    measures = [n.alias("lines"), F.count_if(F.col("vocable")).alias("vocables"), F.count_if(sung & F.col("placed") & hit).alias("right"), F.count_if(sung & F.col("placed") & ~hit).alias("wrong"), F.count_if(sung & ~F.col("placed")).alias("unresolved"), (F.count_if(sung & F.col("placed") & hit) / F.nullif(n, F.lit(0))).alias("right_rate")]
    return stats.pooled_and_by_kind(rows.withColumn("group", F.col(kind or "recording_id").cast("string")), "group", measures)


def word_timing(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Word onsets against the reference and against an even split by length (I14, E39, D3), in ms.

    ``words(recording_id, line_id, k, length, est_us, ref_us)``, ``lines(recording_id, line_id, begin_us, end_us)``.
    """
    rows = schedule.even_split(words.join(lines, KEY), KEY, "k", "length", F.col("begin_us"), F.col("end_us"))
    long = rows.select("recording_id", F.explode(F.array(F.struct(F.lit("aligned").alias("engine"), ((F.col("est_us") - F.col("ref_us")) / 1000).alias("e")), F.struct(F.lit("even_split").alias("engine"), ((F.col("split_begin") - F.col("ref_us")) / 1000).alias("e")))).alias("x")).select("recording_id", "x.*")
    return stats.floor_rank_summary(long, ["engine"], "e")


def engine_comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines that a new engine recovers, loses and keeps, by recording."""
    return stats.set_deltas(before, after, KEY, ["recording_id"])


def availability(candidates: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference lines that some candidate overlaps."""
    met = iv.overlap_join(reference.select("recording_id", "line_id", F.col("begin_us").alias("begin"), F.col("end_us").alias("end")), candidates, "recording_id", 10_000_000)
    return reference.join(met.select("recording_id", F.col("l_line_id").alias("line_id")).distinct(), KEY, "left_semi")


def apply_reviews(rows: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with corrections, review events to append): one decision a line; repeated ones are left out."""
    n = F.count("*").over(Window.partitionBy(*KEY))
    single = decisions.withColumn("_n", n).where("_n = 1").drop("_n")
    out = rows.join(single.select(*KEY, "action", "interval"), KEY, "left").withColumns({"effective": F.coalesce("interval", "estimate"), "review_state": F.coalesce("action", "review_state")})
    return out.drop("action", "interval"), single
