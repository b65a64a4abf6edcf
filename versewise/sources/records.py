"""Scans of reports, artifacts, annotations and recogniser output (A6-A13). Schemas are fixed, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators.align import support_class

WORDS = "array<struct<start_utf16:int,length_utf16:int,interval_us:array<bigint>>>"
REPORT = f"format string, audio string, duration_us bigint, lines array<struct<line:int,text:string,status:string,interval_us:array<bigint>,flags:array<string>,background:string,words:{WORDS},proposal_us:array<bigint>,support:double,similarity:double>>"
RECOGNITION = "result struct<language:string>, transcription array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>,tokens:array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>>>>>"


def _name() -> Column:
    """The file's name without its ending, or what a folder named ``recording_id=...`` above it says."""
    at = F.col("_metadata.file_path")
    folder = F.regexp_extract(at, r"/recording_id=([^/]+)/[^/]*$", 1)
    return F.when(folder != "", folder).otherwise(F.regexp_extract(at, r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("recording_id")


def read_reports(spark: SparkSession, path: str, formats: Sequence[str]) -> DataFrame:
    """Lines of alignment reports of the accepted formats."""
    raw = spark.read.schema(REPORT).json(path, multiLine=True).where(F.col("format").isin(*formats))
    return raw.select(_name(), "duration_us", F.explode("lines").alias("l")).select("recording_id", "duration_us", "l.*")


def read_artifacts(spark: SparkSession, path: str, schema: str, most_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """(records, violations) of strict JSON files: size bounded, no duplicate keys, schema held to."""
    raw = spark.read.text(path, wholetext=True).select(_name(), F.col("_metadata.file_size").alias("size"), "value")
    parsed = raw.withColumns({"strict": F.try_parse_json("value"), "record": F.from_json("value", schema, {"mode": "PERMISSIVE"})})
    rule = F.when(F.col("size") > most_bytes, F.lit("too_large")).when(F.col("strict").isNull(), F.lit("invalid_json")).when(F.col("record").isNull(), F.lit("schema_mismatch")).when(F.col("value").rlike(r"\b(?:NaN|-?Infinity)\b"), F.lit("non_finite"))
    judged = parsed.withColumn("rule_id", rule)
    return judged.where("rule_id is null").select("recording_id", "record.*"), judged.where("rule_id is not null").select("recording_id", F.lit("file").alias("row"), "rule_id")


def read_word_csv(spark: SparkSession, path: str) -> DataFrame:
    """Word annotations with their line numbers: a word with ``line_end`` closes a line."""
    raw = spark.read.option("header", True).schema("word_start double, word_end double, line_end string").csv(path)
    raw = raw.select(_name(), "word_start", "word_end", "line_end").withColumn("k", F.monotonically_increasing_id())
    w = Window.partitionBy("recording_id").orderBy("k")
    return raw.withColumns({"word": F.row_number().over(w) - 1, "closes": F.lag(F.col("line_end").isNotNull().cast("int"), 1, 0).over(w)}).withColumn("line", F.sum("closes").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("k", "closes")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section annotations ``*? mm:ss mm:ss kind text``; kind d and empty texts are dropped."""
    pattern = r"^\s*(\*?)\s*(\d+):(\d{2})\s+(\d+):(\d{2})\s+(\w)\s+(.*\S)\s*$"
    g = lambda i: F.regexp_extract("value", pattern, i)
    time = lambda m, s: (g(m).cast("bigint") * 60 + g(s).cast("bigint")) * 1000000
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(_name(), (g(1) == "*").alias("star"), time(2, 3).alias("start_us"), time(4, 5).alias("end_us"), g(6).alias("kind"), g(7).alias("text")).where("kind <> 'd'")


def read_recognition(spark: SparkSession, path: str) -> DataFrame:
    """Recognised segments in order, with their tokens: ``(recording_id, segment, text, begin_ms, end_ms, tokens)``."""
    raw = spark.read.schema(RECOGNITION).json(path, multiLine=True)
    rows = raw.select(_name(), F.posexplode("transcription").alias("segment", "t"))
    return rows.select("recording_id", "segment", "t.text", F.col("t.offsets.from").alias("begin_ms"), F.col("t.offsets.to").alias("end_ms"), "t.tokens")


def word_observations(segments: DataFrame, windows: DataFrame, tick_ms: int = 10) -> DataFrame:
    """Recognised words in source time with a reason where they cannot be used.

    ``windows(recording_id, begin_us, end_us)`` places each recording's excerpt in its source.
    """
    rows = segments.join(windows, "recording_id").withColumns({"begin_tick": F.expr(f"begin_ms div {tick_ms} + begin_us div {tick_ms * 1000}"), "end_tick": F.expr(f"end_ms div {tick_ms} + begin_us div {tick_ms * 1000}")})
    kind = support_class(F.col("begin_ms"), F.col("end_ms"), F.lit(0), F.expr("(end_us - begin_us) div 1000"))
    return rows.withColumns({"reason": F.when(kind != "valid", kind), "uncertainty": uncertainty(F.col("text"))})


def uncertainty(text: Column) -> Column:
    """Labels of bracketed, parenthesised and musical text."""
    return F.array_compact(F.array(F.when(text.rlike(r"\[.*\]"), F.lit("bracketed")), F.when(text.rlike(r"\(.*\)"), F.lit("parenthesised")), F.when(text.rlike("[\\u2669-\\u266F]"), F.lit("music"))))


def segment_observations(segments: DataFrame, windows: DataFrame) -> DataFrame:
    """Recognised segments with counts of their tokens' timing states."""
    rows = segments.join(windows, "recording_id").withColumn("last", F.expr("(end_us - begin_us) div 1000"))
    state = lambda x: support_class(x["offsets"]["from"], x["offsets"]["to"], F.lit(0), F.col("last"))
    rows = rows.withColumn("states", F.transform("tokens", state))
    counts = F.map_from_entries(F.transform(F.array_distinct("states"), lambda s: F.struct(s, F.size(F.filter("states", lambda x: x == s)))))
    return rows.withColumns({"timing": counts, "reason": F.nullif(support_class(F.col("begin_ms"), F.col("end_ms"), F.lit(0), F.col("last")), F.lit("valid"))}).drop("states", "last")


def projected_segments(segments: DataFrame, windows: DataFrame, tick_ms: int = 10) -> DataFrame:
    """Native segments of overlapping windows as observations, or the reason why they are none (I7: A11, B21, B22).

    ``segments(recording_id, window, segment, text, begin_ms, end_ms, tokens)``, times from the window's start;
    ``windows(recording_id, window, begin_us, end_us)``. Segments of a window are a chain: one that begins before the last one
    with a valid time is ambiguous. ``token_issues`` counts the tokens of each timing fault; every token has its segment's
    support, so there is no word timing. Adds ``begin_tick, end_tick, reason, uncertainty, token_count, token_issues``.
    """
    rows = segments.join(windows, ["recording_id", "window"])
    length = F.expr("(end_us - begin_us) div 1000")
    state = lambda x: F.when(x["begin_ms"].isNull() | x["end_ms"].isNull(), F.lit("missing")).when((x["begin_ms"] < 0) | (x["begin_ms"] > x["end_ms"]), F.lit("invalid")).when(x["end_ms"] > length, F.lit("out_of_window")).when((x["begin_ms"] < F.col("begin_ms")) | (x["end_ms"] > F.col("end_ms")), F.lit("outside_segment"))
    faults = F.array_compact(F.transform("tokens", state))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(faults)), lambda s: F.struct(s, F.size(F.filter(faults, lambda f: f == s)))))
    rows = rows.withColumns({"status": support_class(F.col("begin_ms"), F.col("end_ms"), F.lit(0), length), "token_count": F.size("tokens"), "token_issues": counts})
    rows = rows.withColumns({"begin_tick": F.expr(f"begin_ms div {tick_ms} + begin_us div {tick_ms * 1000}"), "end_tick": F.expr(f"end_ms div {tick_ms} + begin_us div {tick_ms * 1000}")})
    chain = Window.partitionBy("recording_id", "window").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("status") == "valid", F.col("begin_tick")), ignorenulls=True).over(chain)
    status = F.when((F.col("status") == "valid") & (F.col("begin_tick") < before), F.lit("ambiguous")).otherwise(F.col("status"))
    reason = F.when(status != "valid", F.concat(F.lit("segment_timing_"), status)).when(F.col("text") == "", F.lit("empty_recognition")).when(F.col("text").rlike(r"[\x00-\x1F]"), F.lit("unsupported_text_control"))
    noise = F.when(F.col("text").rlike(r"\[[^\]]*\]|\([^)]*\)|[♪♫]"), F.array(F.lit("nonlexical_event_or_annotation"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({"reason": reason, "uncertainty": noise}).drop("status")


def read_cases(spark: SparkSession, path: str, development_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cases, violations) of manifests: unique keys and relative paths."""
    raw = spark.read.schema("case string, variant string, role string, artifact string, features string").json(path)
    n = F.count("*").over(Window.partitionBy("case", "variant"))
    rule = F.when(F.col("n") > 1, F.lit("duplicate_case")).when(F.col("artifact").rlike(r"^/|(^|/)\.\.(/|$)"), F.lit("path_not_relative"))
    judged = raw.withColumn("n", n).withColumn("rule_id", rule).drop("n")
    good = judged.where("rule_id is null").drop("rule_id")
    return (good.where("role = 'development'") if development_only else good), judged.where("rule_id is not null").select(F.col("case").alias("recording_id"), F.col("variant").alias("row"), "rule_id")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Pronunciation ranges with their readings."""
    schema = "version int, source_sha256 string, overrides array<struct<paragraph:int,start_utf16:int,length_utf16:int,text:string,reading:string,note:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(_name(), "source_sha256", F.explode("overrides").alias("o")).select("recording_id", "source_sha256", "o.*")
