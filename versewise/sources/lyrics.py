"""Scans of timed and untimed lyrics (A1-A5): files to lines, with no parsing outside column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.functions import let, text as tx
from versewise.functions.times import lrc_time, ttml_time

TAG = r"\[(\d+:[0-5]\d(?:[.:]\d{1,3})?)\]"
INLINE = r"<(\d+:[0-5]\d(?:[.:]\d{1,3})?)>([^<]*)"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(recording_id, body)``: whole files with unified line breaks.

    The id is the file's name without its ending, or what a folder named ``recording_id=...`` above it says.
    """
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    folder, name = F.regexp_extract(at, r"/recording_id=([^/]+)/[^/]*$", 1), F.regexp_extract(at, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return raw.select(F.when(folder != "", folder).otherwise(name).alias("recording_id"), tx.unify_breaks(F.col("value")).alias("body"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("recording_id", F.posexplode(F.split("body", "\n")).alias("i", "line")).withColumn("source_line", F.col("i") + 1).drop("i")


def read_lrc(spark: SparkSession, path: str, pattern: str = "*.lrc") -> DataFrame:
    """LRC files: ``(recording_id, entry_idx, begin_us, text, source_line, supplied_breaks, segments)`` (A1, A2).

    Stacked tags give one entry each; ``[offset:ms]`` shifts a file; other bracketed tags are metadata; a line that
    begins with ``|`` continues the timed line before it (an empty line between them does not matter, any other
    does). Inline ``<mm:ss.xx>`` tags become segments with UTF-16 ranges, each ending where the next begins, and
    are taken out of the text. Entries are ordered by time and source line; equal ones count once (F1).
    """
    lines = _lines(_files(spark, path, pattern)).where(F.trim("line") != "")
    offset = F.nullif(F.regexp_extract("line", r"(?i)^\s*\[offset:\s*([+-]?\d+)\s*\]", 1), F.lit("")).cast("bigint")
    key = Window.partitionBy("recording_id")
    lines = lines.withColumn("offset_ms", F.coalesce(F.max(offset).over(key), F.lit(0)))
    more = F.ltrim("line").startswith("|")
    group = F.sum(F.when(more, 0).otherwise(1)).over(key.orderBy("source_line").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumns({"more": more, "g": group})
    body = F.when(F.col("more"), F.regexp_replace("line", r"^\s*\|", "")).otherwise(F.regexp_replace("line", rf"^\s*(?:{TAG}\s*)+", ""))
    tags = F.regexp_extract_all(F.regexp_extract("line", rf"^\s*((?:{TAG}\s*)*)", 1), F.lit(TAG), F.lit(1))
    parts = lines.groupBy("recording_id", "g").agg(F.min("source_line").alias("source_line"), F.max("offset_ms").alias("offset_ms"), F.max(F.when(~F.col("more"), tags)).alias("tags"), F.array_sort(F.collect_list(F.struct("source_line", body.alias("t")))).alias("parts"), F.max("more").alias("supplied_breaks"))
    rows = parts.select("recording_id", "source_line", "supplied_breaks", "offset_ms", F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("raw"), F.explode("tags").alias("tag"))
    begin = (lrc_time(F.col("tag")) + F.col("offset_ms")) * 1000
    rows = rows.select("recording_id", "source_line", "supplied_breaks", begin.alias("begin_us"), F.trim(F.regexp_replace("raw", r"<\d+:[0-5]\d(?:[.:]\d{1,3})?>", "")).alias("text"), inline_segments(F.col("raw"), F.col("offset_ms")).alias("segments"))
    rows = rows.dropDuplicates(["recording_id", "begin_us", "text"])
    return rows.withColumn("entry_idx", F.row_number().over(key.orderBy("begin_us", "source_line")) - 1)


def inline_segments(raw: Column, offset_ms: Column) -> Column:
    """Word segments of inline boundaries: (start_utf16, length_utf16, begin_us, end_us); empty without tags (A2)."""
    times, texts = (F.regexp_extract_all(raw, F.lit(INLINE), F.lit(i)) for i in (1, 2))
    at = lambda t: (lrc_time(t) + offset_ms) * 1000

    def of(times: Column, texts: Column) -> Column:
        ends = tx.running(F.transform(texts, tx.utf16_length))
        rows = F.arrays_zip(times.alias("t"), texts.alias("x"), ends.alias("e"))
        row = lambda z, i: F.struct((z["e"] - tx.utf16_length(z["x"])).alias("start_utf16"), tx.utf16_length(z["x"]).alias("length_utf16"), at(z["t"]).alias("begin_us"), at(F.get(times, i + 1)).alias("end_us"))
        return F.filter(F.transform(rows, row), lambda s: s["length_utf16"] > 0)

    return let(times, lambda t: let(texts, lambda x: of(t, x)))


_PART = "kind string, text string, begin string, end string, dur string"
_TTML = f"array<struct<shift: array<string>, begin: string, end: string, dur: string, agent: string, parts: array<struct<{_PART.replace(' string', ': string')}>>>>"
_METADATA = "{http://www.w3.org/ns/ttml#metadata}"


def _paragraphs(body: str | None) -> list[dict] | None:
    """Paragraphs of one TTML file, what they hold in the order of the text; null unless it is well-formed and plain XML."""
    from xml.etree import ElementTree

    if not body or "<!DOCTYPE" in body or "<!ENTITY" in body:
        return None
    try:
        root = ElementTree.fromstring(body.lstrip("\ufeff").strip())
    except (ElementTree.ParseError, ValueError):
        return None
    name = lambda node: node.tag.rpartition("}")[2]
    attribute = lambda node, key: node.get(_METADATA + key) or node.get(key)
    inside = lambda node: (node.text or "") + "".join(("\n" if name(c) == "br" else inside(c)) + (c.tail or "") for c in node)
    timed = lambda node: {k: node.get(k) for k in ("begin", "end", "dur")}
    part = lambda kind, text, node=None: {"kind": kind, "text": text, **(timed(node) if node is not None else dict.fromkeys(("begin", "end", "dur")))}
    out = []
    for b in (c for c in root if name(c) == "body"):
        for d in (c for c in b if name(c) == "div"):
            for p in (c for c in d if name(c) == "p"):
                parts = [part("text", p.text)] if p.text else []
                for c in p:
                    kind = "br" if name(c) == "br" else "other" if name(c) != "span" else "span" if attribute(c, "role") is None else "background"
                    parts.append(part(kind, "\n" if kind == "br" else inside(c), c))
                    parts += [part("text", c.tail)] if c.tail else []
                out.append({"shift": [b.get("begin"), d.get("begin")], **timed(p), "agent": attribute(p, "agent"), "parts": parts})
    return out


def _parsed(bodies: pd.Series) -> pd.Series:
    return bodies.map(_paragraphs)


def read_ttml(spark: SparkSession, path: str, pattern: str = "*.ttml") -> DataFrame:
    """TTML files: ``(recording_id, entry_idx, begin_us, end_us, text, supplied_breaks, segments, background, second_voice, fault)`` (A3).

    Times are relative to the parent (body, division, paragraph); an end is given as ``end`` or ``dur``. Spans and line breaks
    keep their order: a paragraph with spans has their texts and breaks as its text, and of each span a segment with its
    UTF-16 range; one without has its own text. Spans with a role are backing vocals; agent ``v2`` is the second voice. ``fault``
    names the first rule that a paragraph breaks, or is null. Files that are not well-formed XML give no rows (see ``unreadable_ttml``).
    """
    files = _files(spark, path, pattern)
    parse = F.pandas_udf(_parsed, _TTML)
    rows = files.select("recording_id", F.posexplode(parse("body")).alias("entry_idx", "p"))
    shift = F.aggregate(F.col("p.shift"), F.lit(0).cast("bigint"), lambda s, b: s + F.coalesce(ttml_time(b), F.lit(0)))
    rows = rows.withColumn("base", shift).withColumn("begin_us", F.col("base") + ttml_time(F.col("p.begin")))
    stop = lambda x, base, begin: F.coalesce(base + ttml_time(x["end"]), begin + ttml_time(x["dur"]))
    rows = rows.withColumn("end_us", stop(F.col("p"), F.col("base"), F.col("begin_us")))
    of = lambda *kinds: F.filter(F.col("p.parts"), lambda x: x["kind"].isin(*kinds))
    joined = lambda parts: F.array_join(F.transform(parts, lambda x: x["text"]), "")
    words = of("span", "br")
    ends = tx.running(F.transform(words, lambda x: tx.utf16_length(x["text"])))
    begin = lambda x: F.col("begin_us") + ttml_time(x["begin"])
    segment = lambda z: F.struct(z["w"]["text"].alias("text"), (z["e"] - tx.utf16_length(z["w"]["text"])).alias("start_utf16"), tx.utf16_length(z["w"]["text"]).alias("length_utf16"), begin(z["w"]).alias("begin_us"), stop(z["w"], F.col("begin_us"), begin(z["w"])).alias("end_us"))
    segments = F.transform(F.filter(F.arrays_zip(words.alias("w"), ends.alias("e")), lambda z: z["w"]["kind"] == "span"), segment)
    rows = rows.withColumns({"spans": of("span"), "segments": segments, "backing": F.get(of("background"), F.lit(0))})
    own = F.coalesce(F.col("begin_us") + ttml_time(F.col("backing.begin")), F.col("begin_us"))
    background = F.when(F.col("backing").isNotNull(), F.struct(F.trim(F.col("backing.text")).alias("text"), own.alias("begin_us"), F.coalesce(stop(F.col("backing"), F.col("begin_us"), own), F.col("end_us")).alias("end_us"), (F.col("backing.begin").isNotNull() & F.coalesce("backing.end", "backing.dur").isNotNull()).alias("explicit")))
    text = F.when(F.size("spans") > 0, joined(words)).otherwise(joined(of("text", "br")))
    rows = rows.withColumns({"text": text, "background": background})
    both = lambda x: x["end"].isNotNull() & x["dur"].isNotNull()
    outside = lambda s: s["begin_us"].isNull() | s["end_us"].isNull() | (s["begin_us"] < F.col("begin_us")) | (s["begin_us"] >= s["end_us"]) | (s["end_us"] > F.col("end_us"))
    before = F.lag("end_us").over(Window.partitionBy("recording_id").orderBy("entry_idx"))
    rules = {
        "interval": both(F.col("p")) | F.col("begin_us").isNull() | F.col("end_us").isNull() | (F.col("begin_us") >= F.col("end_us")),
        "out_of_order": before > F.col("begin_us"),
        "unsupported_text": (F.size(of("other")) > 0) | ((F.size("spans") > 0) & (F.size(of("text")) > 0)),
        "empty_span": F.exists("spans", lambda x: F.trim(x["text"]) == ""),
        "span_interval": F.exists("spans", both) | F.exists("segments", outside),
        "span_order": F.exists(F.transform("segments", lambda s, i: F.get(F.col("segments"), i - 1)["end_us"] > s["begin_us"]), lambda x: F.coalesce(x, F.lit(False))),
        "background": (F.size(of("background")) > 1) | (F.col("backing").isNotNull() & ((F.trim("backing.text") == "") | F.contains(F.trim("backing.text"), F.lit("\n")))),
        "blank_line": (F.col("text") != "") & F.exists(F.split("text", "\n"), lambda x: F.trim(x) == ""),
    }
    fault = F.coalesce(*[F.when(broken, F.lit(rule)) for rule, broken in rules.items()])
    return rows.select("recording_id", "entry_idx", "begin_us", "end_us", "text", F.contains("text", F.lit("\n")).alias("supplied_breaks"), "segments", "background", F.coalesce(F.col("p.agent") == "v2", F.lit(False)).alias("second_voice"), fault.alias("fault"))


def unreadable_ttml(spark: SparkSession, path: str, pattern: str = "*.ttml") -> DataFrame:
    """``(recording_id)`` of TTML files that are not well-formed XML, or declare a document type or entities."""
    return _files(spark, path, pattern).where(F.pandas_udf(_parsed, _TTML)("body").isNull()).select("recording_id")


def read_plain(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Plain lyrics: ``(recording_id, source_line, paragraph, text)`` of the lines that are not blank (A4)."""
    lines = _lines(_files(spark, path, pattern))
    blank = F.trim("line") == ""
    w = Window.partitionBy("recording_id").orderBy("source_line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("paragraph", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank).select("recording_id", "source_line", "paragraph", F.col("line").alias("text"))


def read_timed(spark: SparkSession, path: str) -> DataFrame:
    """All timed formats of a folder, by their endings (A5)."""
    common = ["recording_id", "entry_idx", "begin_us", "text"]
    return read_lrc(spark, path).select(*common).unionByName(read_ttml(spark, path).select(*common))
