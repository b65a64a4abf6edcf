"""Scans of files (A1-A4, F1): lyrics written from events, a file a user, and read back; the SQL states what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewise.functions import text as tx
from versewise.plans.registry import EV, HOUR, MONTH, events, query
from versewise.sources import lyrics, sinks
from versewise.streaming.replay import shared_folder

_DAY = 24 * HOUR
_REL = f"r AS (SELECT *, t - {MONTH[0]} AS rel, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM ev)"


def _written(bodies: DataFrame, name: str) -> str:
    folder = shared_folder(bodies.sparkSession, name)
    sinks.write_documents(bodies.withColumnRenamed("user_id", "recording_id"), folder, "body")
    return folder


def _joined(rows: DataFrame, piece, by: str) -> DataFrame:
    """One body a user, its pieces in the order of time."""
    parts = rows.select("user_id", "t", "event_id", piece.alias("piece")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", "piece"))).alias("p"))
    return parts.select("user_id", F.array_join(F.transform("p", lambda x: x["piece"]), by).alias("body"))


_SPANNED = "floor(value) % 3 > 0"


@query(f"""WITH {EV}, {_REL}, x AS (SELECT *, rel + 1500000 AS b, rel + 1500000 + 60000000 AS e, {_SPANNED} AS spanned, event_type || ' ' AS s1, 'no <' || CAST(event_id AS VARCHAR) || '>' AS s2, 'é' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS s3 FROM r),
    y AS (SELECT *, length(s1) AS n1, length(s2) AS n2, length(s3) AS n3 FROM x)
    SELECT user_id, i AS entry_idx, b AS begin_us, e AS end_us, CASE WHEN spanned THEN s1 || s2 || chr(10) || s3 ELSE s1 || '&' || chr(10) || s3 END AS text, true AS supplied_breaks,
    CASE WHEN spanned THEN concat_ws(',', concat_ws(':', 0, n1, b, b + 10000000), concat_ws(':', n1, n2, b + 10000000, b + 20500000), concat_ws(':', n1 + n2 + 1, n3, b + 30000000, b + 40000000)) ELSE '' END AS segments,
    CASE WHEN event_type = 'purchase' THEN concat_ws(':', 'ooh ' || CAST(event_id AS VARCHAR), b + 5000000, e, 'false') WHEN event_type = 'view' THEN concat_ws(':', 'aah', b + 1000000, b + 2000000, 'true') END AS background, event_type = 'error' AS second_voice,
    CASE WHEN lag(e) OVER (PARTITION BY user_id ORDER BY i) > b THEN 'out_of_order' WHEN spanned AND event_type = 'click' AND floor(value) % 2 = 0 THEN 'unsupported_text' END AS fault FROM y""")
def scanned_ttml(spark, d):
    """Spans, breaks and backing vocals in order; times relative to their parents; paragraphs that break a rule named."""
    e = events(spark, d).withColumns({"b": F.col("t") - MONTH[0], "v": F.floor("value")})
    span = lambda text, begin, end: F.concat(F.lit(f'<span begin="{begin}s" {end}>'), tx.xml_escape(text), F.lit("</span>"))
    s1, s2, s3 = F.concat("event_type", F.lit(" ")), F.concat(F.lit("no <"), F.col("event_id").cast("string"), F.lit(">")), F.concat(F.lit("é"), F.col("v").cast("string"))
    gap = F.when((F.col("event_type") == "click") & (F.col("v") % 2 == 0), F.lit(" ")).otherwise(F.lit(""))
    spans = F.concat(span(s1, 0, 'end="10s"'), span(s2, 10, 'dur="10.5s"'), F.lit("<br/>"), gap, span(s3, 30, 'end="00:00:40"'))
    plain = F.concat(tx.xml_escape(s1), F.lit("&amp;<br/>"), s3)
    back = F.when(F.col("event_type") == "purchase", F.concat(F.lit('<span ttm:role="x-bg" begin="5s"> ooh '), F.col("event_id").cast("string"), F.lit("</span>"))).when(F.col("event_type") == "view", F.lit('<span ttm:role="x-bg" begin="1s" dur="1s">aah</span>')).otherwise(F.lit(""))
    agent = F.when(F.col("event_type") == "error", F.lit(' ttm:agent="v2"')).otherwise(F.lit(""))
    p = F.concat(F.lit('<p begin="'), tx.stamp(F.col("b")), F.lit('" dur="60s"'), agent, F.lit(">"), F.when(F.expr(_SPANNED), spans).otherwise(plain), back, F.lit("</p>"))
    bodies = _joined(e, p, "\n")
    head, tail = '<tt xmlns="http://www.w3.org/ns/ttml" xmlns:ttm="http://www.w3.org/ns/ttml#metadata"><body begin="1s"><div begin="500ms">', "</div></body></tt>"
    folder = _written(bodies.withColumn("body", F.concat(F.lit(head), "body", F.lit(tail))), "ttml")
    rows = lyrics.read_ttml(spark, folder, "*")
    segments = F.array_join(F.transform("segments", lambda s: F.concat_ws(":", *[s[c].cast("string") for c in ("start_utf16", "length_utf16", "begin_us", "end_us")])), ",")
    background = F.when(F.col("background").isNotNull(), F.concat_ws(":", "background.text", *[F.col(f"background.{c}").cast("string") for c in ("begin_us", "end_us", "explicit")]))
    return rows.select(F.col("recording_id").cast("bigint").alias("user_id"), F.col("entry_idx").cast("bigint").alias("entry_idx"), "begin_us", "end_us", "text", "supplied_breaks", segments.alias("segments"), background.alias("background"), "second_voice", "fault")


_MS = f"m AS (SELECT *, (t - {MONTH[0]}) // 1000 AS ms FROM ev)"


@query(f"""WITH {EV}, {_MS}, v AS (SELECT user_id, ms, 'seen on day ' || CAST(ms // 86400000 AS VARCHAR) AS text, false AS supplied_breaks, '' AS segments FROM m WHERE event_type = 'view'),
    o AS (SELECT user_id, ms, event_type || ' ' || CAST(event_id AS VARCHAR) || CASE WHEN value >= 50 THEN chr(10) || 'and ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) ELSE '' END AS text, value >= 50 AS supplied_breaks,
    CASE WHEN event_type = 'purchase' THEN concat_ws(',', concat_ws(':', 0, 9, (ms + 250) * 1000, (ms + 750) * 1000), concat_ws(':', 9, length(CAST(event_id AS VARCHAR)), (ms + 750) * 1000, (ms + 1250) * 1000)) ELSE '' END AS segments FROM m WHERE event_type <> 'view' AND NOT (event_type = 'purchase' AND value >= 50))
    SELECT DISTINCT user_id, (ms + 250) * 1000 AS begin_us, text, supplied_breaks, segments FROM (SELECT * FROM v UNION ALL SELECT * FROM o)""")
def scanned_lrc(spark, d):
    """Stacked tags, an offset, continuation lines, metadata and inline word times (A1, A2, F1)."""
    e = events(spark, d).withColumns({"ms": F.floor((F.col("t") - MONTH[0]) / 1000), "v": F.floor("value")}).where("not (event_type = 'purchase' and value >= 50)")
    stamp = lambda ms, a, b: F.concat(F.lit(a), F.format_string("%02d:%02d.%03d", (ms / 60000).cast("long"), (ms / 1000 % 60).cast("long"), (ms % 1000).cast("long")), F.lit(b))
    tag = stamp(F.col("ms"), "[", "]")
    at = lambda more: stamp(F.col("ms") + more, "<", ">")
    words = F.when(F.col("event_type") == "purchase", F.concat(at(0), "event_type", F.lit(" "), at(500), F.col("event_id").cast("string"), at(1000))).otherwise(F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")))
    line = F.concat(tag, words, F.when(F.col("value") >= 50, F.concat(F.lit("\n|and "), F.col("v").cast("string"))).otherwise(F.lit("")))
    single = e.where("event_type <> 'view'").select("user_id", "t", "event_id", line.alias("piece"))
    views = e.where("event_type = 'view'").groupBy("user_id", F.floor(F.col("ms") / 86400000).alias("day")).agg(F.min("t").alias("t"), F.min("event_id").alias("event_id"), F.array_join(F.array_sort(F.collect_set(tag)), "").alias("tags"))
    stacked = views.select("user_id", "t", "event_id", F.concat("tags", F.lit("seen on day "), F.col("day").cast("string")).alias("piece"))
    bodies = _joined(single.unionByName(stacked), F.col("piece"), "\r\n")
    folder = _written(bodies.withColumn("body", F.concat(F.lit("﻿[ti:Events]\r\n[offset:+250]\r\n\r\n"), "body")), "lrc")
    rows = lyrics.read_lrc(spark, folder, "*")
    segments = F.array_join(F.transform("segments", lambda s: F.concat_ws(":", *[s[c].cast("string") for c in ("start_utf16", "length_utf16", "begin_us", "end_us")])), ",")
    return rows.select(F.col("recording_id").cast("bigint").alias("user_id"), "begin_us", "text", "supplied_breaks", segments.alias("segments"))


@query(f"""WITH {EV}, {_REL}, p AS (SELECT *, rel // {_DAY} AS day, lag(rel // {_DAY}) OVER (PARTITION BY user_id ORDER BY i) AS before FROM r), q AS (SELECT *, sum(CASE WHEN before <> day THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS paragraph FROM p)
    SELECT user_id, CAST(i + 1 + paragraph AS BIGINT) AS source_line, CAST(paragraph AS BIGINT) AS paragraph, event_type || ' ' || CAST(event_id AS VARCHAR) AS text FROM q""")
def scanned_plain(spark, d):
    """Plain lyrics with blank lines between days (A4)."""
    e = events(spark, d).withColumn("day", F.floor((F.col("t") - MONTH[0]) / _DAY))
    line = F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))
    days = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("t", "event_id", line.alias("x")))).alias("p")).select("user_id", F.col("day").alias("t"), F.lit(0).alias("event_id"), F.array_join(F.transform("p", lambda x: x["x"]), "\n").alias("piece"))
    folder = _written(_joined(days, F.col("piece"), "\n\n"), "plain")
    return lyrics.read_plain(spark, folder, "*").select(F.col("recording_id").cast("bigint").alias("user_id"), F.col("source_line").cast("bigint").alias("source_line"), F.col("paragraph").cast("bigint").alias("paragraph"), "text")
