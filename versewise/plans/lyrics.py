"""Composite pipelines over lyrics: normalisation (I1), acceptance (I3), placement (I4), correspondence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.functions import text as tx
from versewise.operators import align, intervals as iv, match, schedule, selection


def normalise_lyrics(texts: DataFrame, key: str = "recording_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, dropped, credits) of whole lyrics texts (I1: A4, B1-B7, E19, E20).

    Lines carry their source line, paragraph and chunk, the main text, backing phrases, the second-voice mark and
    UTF-16 ranges. A line of backing phrases alone goes to the sung line before it; without one it is dropped, as are
    section labels and lines without letters. One window a song; nothing is collected.
    """
    body = tx.unify_apostrophes(tx.unify_breaks(F.col(text)))
    raw = texts.select(key, F.posexplode(F.split(body, "\n")).alias("i", "raw")).withColumn("source_line", F.col("i") + 1).drop("i")
    raw = raw.withColumns({"second_voice": tx.is_second_voice(F.col("raw")), "line": F.when(tx.is_second_voice(F.col("raw")), tx.without_voice_mark(F.col("raw"))).otherwise(F.col("raw"))})
    w = Window.partitionBy(key).orderBy("source_line")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    raw = raw.withColumn("paragraph_id", F.sum(F.when(F.trim("line") == "", 1).otherwise(0)).over(upto)).where(F.trim("line") != "")
    raw = raw.withColumns({"label": tx.is_section_label(F.col("line")), "credit": tx.credit(F.col("line")), "main": tx.main_text(F.col("line")), "phrases": tx.backing(F.col("line"))})
    raw = raw.withColumn("sung", ~F.col("label") & F.col("credit").isNull() & tx.has_letters(F.col("main")))
    raw = raw.withColumn("line_id", F.sum(F.col("sung").cast("int")).over(upto) - 1)
    alone = ~F.col("label") & F.col("credit").isNull() & ~F.col("sung")
    reason = F.when(F.col("label"), F.lit("section label")).when(alone & (F.size("phrases") == 0), F.lit("no letters")).when(alone & (F.col("line_id") < 0), F.lit("background vocals without a preceding line"))
    dropped = raw.withColumn("reason", reason).where("reason is not null").select(key, "source_line", F.col("line").alias("text"), "reason")
    names = raw.where("credit is not null").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("source_line", "credit"))).alias("c")).select(key, F.array_join(F.transform("c", lambda x: x["credit"]), ", ").alias("names"))
    behind = raw.where((F.col("line_id") >= 0) & (F.col("sung") | alone) & (F.size("phrases") > 0)).groupBy(key, "line_id").agg(F.array_sort(F.collect_list(F.struct("source_line", "phrases"))).alias("b"))
    behind = behind.select(key, "line_id", F.array_join(F.flatten(F.transform("b", lambda x: x["phrases"])), " ").alias("background"))
    lines = schedule.balanced_chunks(raw.where("sung"), [key, "paragraph_id"], "source_line").join(behind, [key, "line_id"], "left")
    size = tx.utf16_length(F.col("main"))
    before = Window.partitionBy(key).orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns({"length_utf16": size, "start_utf16": F.coalesce(F.sum(size + 1).over(before), F.lit(0)), "alignment_text": tx.canonical(tx.fold_latin(F.col("main")))})
    return lines.select(key, "line_id", "paragraph_id", "chunk", "start_utf16", "length_utf16", F.col("main").alias("text"), "alignment_text", "source_line", "second_voice", "background"), dropped, names


def accept_and_refine(proposals: DataFrame, frames: DataFrame, key: str = "recording_id") -> DataFrame:
    """Acceptance by evidence and neighbours, then boundaries by activity (I3: B17, E1, D17, E2-E4).

    ``proposals(key, line_id, begin_us, end_us, support, similarity, n_chars)``.
    """
    rows = proposals.withColumn("rate", (F.col("end_us") - F.col("begin_us")) / F.col("n_chars"))
    rows = rows.withColumn("reasons", align.gate(F.col("support"), F.col("similarity"), F.col("rate"))).withColumn("base", (F.size("reasons") == 0) & F.col("begin_us").isNotNull())
    rows = align.neighbour_acceptance(rows, key, "line_id", "base", "rate", "similarity")
    return align.refine_estimates(rows, frames, key)


def place_unresolved(rows: DataFrame, frames: DataFrame, key: str = "recording_id", frame_us: int = 20_000, onset_db: float = 30.0) -> DataFrame:
    """Placement of what was not accepted, and its status (I4: E9, E5, E10, B18).

    ``rows(key, line_id, estimate_begin, estimate_end, duration)``; silence (a reference at the floor) moves nothing.
    """
    filled = align.fill_unresolved(rows, key, "line_id", "estimate_begin", "estimate_end", "duration")
    ref = selection.percentiles(frames, [key], "level_db", {"ref": 0.99}).drop("n")
    loud = frames.join(ref, key).withColumn("active", (F.col("level_db") > F.col("ref") - onset_db) & (F.col("ref") > -120))
    moved = align.relocate_boundary_runs(filled, iv.active_intervals(loud, key, frame_us), key, "line_id", "estimate_begin", "estimate_end", "duration")
    return moved.withColumn("status", align.status(F.col("estimate_begin"), F.col("fill_begin"), F.lit(False)))


def correspondence(candidates: DataFrame, observations: DataFrame, key: str = "recording_id") -> tuple[DataFrame, DataFrame]:
    """(decisions, unused observations) from assessed candidates (I5, I6: B24, E31-E33, C13).

    ``candidates(key, occurrence, id, agreement, similarity, lines, duration)``, ``observations(key, begin, end)``.
    """
    judged = match.assess(candidates).withColumns({"begin": F.element_at("lines", 1)["b"], "end": F.element_at("lines", -1)["e"]})
    ranked = match.suppress_near_duplicates(judged.where("eligible"), [key, "occurrence"], "id", "score", "begin", "end").where("duplicate_of is null")
    every = match.chronological_path(ranked.select(key, "occurrence", "id", "begin", "end", "utility"), key, occurrences=candidates.select(key, "occurrence"))
    used = every.where("state = 'supported'").select(key, "occurrence", F.col("candidate").alias("id")).join(ranked, [key, "occurrence", "id"]).select(key, "begin", "end")
    met = iv.overlap_join(observations, used, key, 10_000_000).select(key, F.col("l_begin").alias("begin"), F.col("l_end").alias("end")).distinct()
    return every, observations.join(met, [key, "begin", "end"], "left_anti")
