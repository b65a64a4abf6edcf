"""Scans of records (A6-A10, A12, A13, A16, A17), the proposal gate (B17) and whole score rows (I13, I14, I16) as queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators import align, match
from versewise.plans import scores
from versewise.plans.judged import _HIT, _PAIRS, _pairs
from versewise.plans.registry import EV, HOUR, IV, MONTH, events, intervals, merged_sql, query, sweep_sql
from versewise.plans.scans import _REL, _joined, _written
from versewise.sources import records, sinks
from versewise.streaming.replay import shared_folder


def _id(column: str = "recording_id"):
    return F.col(column).cast("bigint").alias("user_id")


@query(f"""WITH {EV}, {_REL} SELECT user_id, CAST({MONTH[1] - MONTH[0]} AS BIGINT) AS duration_us, CAST(i AS BIGINT) AS line, event_type AS text, CASE WHEN value > 20 THEN rel END AS begin_us, CASE WHEN event_type = 'error' THEN 'weak_support,"x"' ELSE '' END AS flags, value / 100 AS similarity FROM r WHERE user_id % 7 > 0""")
def scanned_reports(spark, d):
    """Reports of an accepted format, a JSON file a user."""
    e = events(spark, d).withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    flags = F.when(F.col("event_type") == "error", F.array(F.lit("weak_support"), F.lit('"x"'))).otherwise(F.array().cast("array<string>"))
    rel = F.col("t") - MONTH[0]
    one = F.struct("line", F.col("event_type").alias("text"), F.when(F.col("value") > 20, F.array(rel, rel + 10)).alias("interval_us"), flags.alias("flags"), (F.col("value") / 100).alias("similarity"))
    bodies = e.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("lines"))
    report = F.struct(F.when(F.col("user_id") % 7 == 0, "old").otherwise("v1").alias("format"), F.lit(MONTH[1] - MONTH[0]).alias("duration_us"), "lines")
    folder = _written(bodies.select("user_id", F.to_json(report).alias("body")), "reports")
    rows = records.read_reports(spark, folder, ["v1"])
    return rows.select(_id(), "duration_us", F.col("line").cast("bigint").alias("line"), "text", F.get("interval_us", F.lit(0)).alias("begin_us"), F.array_join("flags", ",").alias("flags"), "similarity")


@query(f"""WITH {EV}, u AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) SELECT user_id, CASE WHEN user_id % 5 IN (0, 4) THEN n END AS a, CASE user_id % 5 WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'too_large' END AS rule_id FROM u""")
def strict_artifacts(spark, d):
    """JSON files that are good, name a key twice, break off or are too large."""
    n = F.count("*").cast("string")
    body = F.when(F.col("user_id") % 5 == 1, F.concat(F.lit('{"a": 1, "a": '), "n", F.lit("}"))).when(F.col("user_id") % 5 == 2, F.concat(F.lit('{"a": '), "n")).when(F.col("user_id") % 5 == 3, F.concat(F.lit('{"a": '), "n", F.repeat(F.lit(" "), 400), F.lit("}"))).otherwise(F.concat(F.lit('{"a": '), "n", F.lit("}")))
    bodies = events(spark, d).groupBy("user_id").agg(n.alias("n")).select("user_id", body.alias("body"))
    good, bad = records.read_artifacts(spark, _written(bodies, "artifacts"), "a bigint", 300)
    return good.select(_id(), "a", F.lit(None).cast("string").alias("rule_id")).unionByName(bad.select(_id(), F.lit(None).cast("bigint").alias("a"), "rule_id"))


@query(f"""WITH {EV}, {_REL}, w AS (SELECT user_id, i, rel // 1000 / 1000.0 AS s, event_type = 'purchase' AS closing FROM r) SELECT user_id, CAST(i AS BIGINT) AS word, s AS word_start, coalesce(count(*) FILTER (closing) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM w""")
def scanned_words(spark, d):
    """Word annotations as CSV; a word with an end of line closes it."""
    e = events(spark, d)
    s = F.floor((F.col("t") - MONTH[0]) / 1000) / 1000
    line = F.concat_ws(",", F.format_string("%.3f", s), F.format_string("%.3f", s + 0.5), F.when(F.col("event_type") == "purchase", F.lit("x")).otherwise(F.lit("")))
    bodies = _joined(e, line, "\n").withColumn("body", F.concat(F.lit("word_start,word_end,line_end\n"), "body"))
    rows = records.read_word_csv(spark, _written(bodies, "words"))
    return rows.select(_id(), F.col("word").cast("bigint").alias("word"), "word_start", F.col("line").cast("bigint").alias("line"))


@query(f"""WITH {EV}, s AS (SELECT user_id, event_id, (t - {MONTH[0]}) // 1000000 AS sec, event_type FROM ev WHERE event_type <> 'error')
    SELECT user_id, count(*) AS sections, count(*) FILTER (event_type = 'view') AS starred, CAST(sum(sec) * 1000000 AS BIGINT) AS starts, string_agg(event_type || ' ' || CAST(event_id AS VARCHAR), chr(10) ORDER BY sec, event_type || ' ' || CAST(event_id AS VARCHAR)) AS lyrics FROM s GROUP BY 1""")
def scanned_sections(spark, d):
    """Section annotations (A9), errors as kind d, which is dropped, and their text in order."""
    e = events(spark, d)
    sec = F.floor((F.col("t") - MONTH[0]) / 1_000_000)
    stamp = lambda s: F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    line = F.concat_ws(" ", F.when(F.col("event_type") == "view", F.lit("*")), stamp(sec), stamp(sec + 20), F.when(F.col("event_type") == "error", "d").otherwise("b"), "event_type", F.col("event_id").cast("string"))
    rows = records.read_sections(spark, _written(_joined(e, line, "\n"), "sections")).withColumn("star", F.col("star").cast("int"))
    facts = rows.groupBy("recording_id").agg(F.count("*").alias("sections"), F.sum("star").alias("starred"), F.sum("start_us").alias("starts"))
    return facts.join(sinks.section_text(rows), "recording_id").select(_id(), "sections", "starred", "starts", "lyrics")


@query(f"""WITH {EV}, {_REL}, x AS (SELECT user_id, i, event_type, rel // 1000 AS b, rel // 1000 + CAST(floor(value * 1000) AS BIGINT) - CASE WHEN value < 5 THEN 9000 ELSE 0 END AS e FROM r)
    SELECT user_id, CAST(i AS BIGINT) AS segment, b // 10 + {MONTH[0] // 10000} AS begin_tick, CASE WHEN b >= e THEN 'invalid' WHEN e > {29 * 86400000} THEN 'out_of_window' END AS reason, CASE event_type WHEN 'view' THEN 'bracketed' WHEN 'click' THEN 'parenthesised' ELSE '' END AS uncertainty FROM x""")
def scanned_recognition(spark, d):
    """Recogniser output as JSON, a file a user, in source time."""
    e = events(spark, d)
    b = F.floor((F.col("t") - MONTH[0]) / 1000)
    text = F.when(F.col("event_type") == "view", "[seen]").when(F.col("event_type") == "click", "(on) it").otherwise(F.col("event_type"))
    end = b + F.floor(F.col("value") * 1000) - F.when(F.col("value") < 5, 9000).otherwise(0)
    one = F.struct("t", "event_id", F.struct(text.alias("text"), F.struct(b.alias("from"), end.alias("to")).alias("offsets"), F.array().cast("array<struct<text:string>>").alias("tokens")).alias("x"))
    bodies = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda v: v["x"]).alias("x")).select("user_id", F.to_json(F.struct(F.struct(F.lit("en").alias("language")).alias("result"), F.col("x").alias("transcription"))).alias("body"))
    segments = records.read_recognition(spark, _written(bodies, "recognition"))
    windows = segments.select("recording_id").distinct().select("recording_id", F.lit(MONTH[0]).alias("begin_us"), F.lit(MONTH[0] + 29 * 24 * HOUR).alias("end_us"))
    return records.word_observations(segments, windows).select(_id(), F.col("segment").cast("bigint").alias("segment"), "begin_tick", "reason", F.array_join("uncertainty", ",").alias("uncertainty"))


@query(f"""WITH {EV}, c AS (SELECT user_id % 100 AS k, event_type AS v, count(DISTINCT user_id) AS n, min(user_id) AS u FROM ev GROUP BY ALL)
    SELECT CAST(k AS VARCHAR) AS "case", v AS variant, CASE WHEN n > 1 THEN 'duplicate_case' WHEN u % 4 = 0 THEN 'path_not_relative' END AS rule_id, CASE WHEN n > 1 THEN n ELSE 1 END AS n FROM c""")
def scanned_cases(spark, d):
    """Manifests as JSON lines: repeated cases and paths that leave the folder are violations."""
    u = events(spark, d).select("user_id", "event_type").distinct()
    path = F.when(F.col("user_id") % 8 == 0, "/x/y").when(F.col("user_id") % 4 == 0, "a/../b").otherwise("a/b..c")
    folder = shared_folder(spark, "cases")
    u.select((F.col("user_id") % 100).cast("string").alias("case"), F.col("event_type").alias("variant"), F.lit("development").alias("role"), path.alias("artifact")).write.json(folder)
    good, bad = records.read_cases(spark, folder)
    rows = good.select("case", "variant", F.lit(None).cast("string").alias("rule_id")).unionByName(bad.select(F.col("recording_id").alias("case"), F.col("row").alias("variant"), "rule_id"))
    return rows.groupBy("case", "variant", "rule_id").agg(F.count("*").alias("n"))


@query(f"""WITH {EV}, {_REL} SELECT user_id, CAST(i AS BIGINT) AS paragraph, event_type AS text, 'r' || CAST(event_id AS VARCHAR) AS reading, CAST(length(event_type) AS BIGINT) AS length_utf16 FROM r""")
def scanned_overrides(spark, d):
    """Pronunciation ranges with their readings, a JSON file a user."""
    e = events(spark, d).withColumn("paragraph", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")) - 1)
    one = F.struct("paragraph", F.lit(0).alias("start_utf16"), F.length("event_type").alias("length_utf16"), F.col("event_type").alias("text"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("reading"))
    bodies = e.groupBy("user_id").agg(F.sort_array(F.collect_list(one)).alias("overrides")).select("user_id", F.to_json(F.struct(F.lit(1).alias("version"), F.lit("0").alias("source_sha256"), "overrides")).alias("body"))
    rows = records.read_overrides(spark, _written(bodies, "overrides"))
    return rows.select(_id(), F.col("paragraph").cast("bigint").alias("paragraph"), "text", "reading", F.col("length_utf16").cast("bigint").alias("length_utf16"))


@query(f"WITH {EV} SELECT user_id, event_id, t, round(value, 2) AS value FROM ev")
def written_trajectories(spark, d):
    """Rows as CSV with a header, read back."""
    folder = shared_folder(spark, "trajectories")
    sinks.write_trajectories(events(spark, d).select("user_id", "event_id", "t", F.round("value", 2).alias("value")), folder)
    return spark.read.option("header", True).schema("user_id bigint, event_id bigint, t bigint, value double").csv(folder)


@query(f"""WITH {EV}, p AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN -floor(value) / 20 END AS support, CASE WHEN event_type <> 'view' THEN event_id % 40 / 100.0 END AS similarity, CAST(floor(value) AS BIGINT) * 4000 AS rate FROM ev)
    SELECT event_id, concat_ws(',', CASE WHEN support IS NULL OR support < -3.5 THEN 'weak_separated_support' END, CASE WHEN coalesce(similarity, 0) < 0.15 THEN 'weak_separated_lexical_agreement' END, CASE WHEN rate < 40000 THEN 'implausible_duration' END, CASE WHEN rate > 400000 THEN 'implausible_rate' END) AS reasons FROM p""")
def gated_proposals(spark, d):
    """Reasons against proposals."""
    e = events(spark, d)
    support, similarity = F.when(F.col("event_type") != "error", -F.floor("value") / 20), F.when(F.col("event_type") != "view", F.col("event_id") % 40 / 100)
    return e.select("event_id", F.array_join(align.gate(support, similarity, F.floor("value") * 4000), ",").alias("reasons"))


_Q = lambda c: f'count("{c}") AS {c}_n, round(quantile_cont(abs("{c}"), 0.5), 4) AS {c}_median, round(quantile_cont(abs("{c}"), 0.95), 4) AS {c}_p95, round(avg(abs("{c}")), 4) AS {c}_mae, round(max(abs("{c}")), 4) AS {c}_worst, round(avg(CASE WHEN abs("{c}") > 500 THEN 1 WHEN "{c}" IS NOT NULL THEN 0 END), 6) AS {c}_late'


@query(f"""WITH {EV}, {IV}, {_PAIRS}, x AS (SELECT *, (eb - rb) / 1000.0 AS "on", (ee - re) / 1000.0 AS "off" FROM pr),
    w AS (SELECT recording_id, count(*) AS wrong FROM pr a WHERE eb IS NOT NULL AND NOT {_HIT} AND EXISTS (SELECT 1 FROM pr b WHERE a.recording_id = b.recording_id AND a.text = b.text AND a.line_id <> b.line_id AND greatest(a.eb, b.rb) < least(a.ee, b.re)) GROUP BY 1),
    s AS (SELECT recording_id, count(*) AS lines, count(eb) AS placed, count(*) FILTER (eb IS NOT NULL AND {_HIT}) AS overlapping, {_Q("on")}, {_Q("off")} FROM x GROUP BY 1)
    SELECT s.*, coalesce(wrong, 0) AS wrong_repeats FROM s LEFT JOIN w USING (recording_id)""")
def full_song_rows(spark, d):
    """All columns of the score of a recording: onsets, offsets, wrong repeats."""
    out = scores.full_song_score(_pairs(spark, d))
    return out.select(*[F.round(c, 6 if c.endswith("_late") else 4).alias(c) if c.endswith(("median", "p95", "mae", "worst", "late")) else F.col(c) for c in out.columns])


_WORD = f"""w AS (SELECT recording_id, line_id, rb, re, k, n AS "length", rb + (re - rb) * k // 4 AS ref, rb + (re - rb) * k // 4 + 1000 * ((line_id + k) % 900 - 300) AS est FROM pr, (VALUES (0, 3), (1, 5), (2, 2)) AS v(k, n))"""


@query(f"""WITH {EV}, {IV}, {_PAIRS}, {_WORD}, e AS (SELECT 'aligned' AS engine, (est - ref) / 1000.0 AS e FROM w UNION ALL SELECT 'even_split', (rb + (re - rb) * CASE k WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 8 END / 10 - ref) / 1000.0 FROM w),
    r AS (SELECT engine, e, abs(e) AS a, row_number() OVER (PARTITION BY engine ORDER BY abs(e)) - 1 AS i, count(*) OVER (PARTITION BY engine) AS n FROM e)
    SELECT engine, count(*) AS n, round(quantile_cont(e, 0.5), 4) AS signed_median, round(max(a) FILTER (i = least(n - 1, CAST(floor(0.9 * n) AS BIGINT))), 4) AS p90, round(max(a) FILTER (i = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))), 4) AS p95, round(avg(CASE WHEN a <= 100 THEN 1 ELSE 0 END), 6) AS within_100, round(avg(CASE WHEN a <= 200 THEN 1 ELSE 0 END), 6) AS within_200 FROM r GROUP BY 1""")
def timed_words(spark, d):
    """Onsets of three words a line, against the reference and against an even split by length."""
    p = _pairs(spark, d)
    lines = p.select("recording_id", "line_id", F.col("ref_begin_us").alias("begin_us"), F.col("ref_end_us").alias("end_us"))
    k = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("length")) for i, n in enumerate((3, 5, 2))]))
    w = p.select("recording_id", "line_id", "ref_begin_us", "ref_end_us", k.alias("x")).select("*", "x.k", "x.length").withColumn("ref_us", F.expr("ref_begin_us + (ref_end_us - ref_begin_us) * k div 4"))
    w = w.withColumn("est_us", F.col("ref_us") + 1000 * ((F.col("line_id") + F.col("k")) % 900 - 300))
    out = scores.word_timing(w.select("recording_id", "line_id", "k", "length", "est_us", "ref_us"), lines)
    return out.select("engine", "n", *[F.round(c, 6 if c.startswith("within") else 4).alias(c) for c in ("signed_median", "p90", "p95", "within_100", "within_200")])


def _covered(name: str, activity: str) -> str:
    share = f"(SELECT user_id, sum(\"end\" - \"begin\") AS z FROM {{}} GROUP BY 1)"
    part = f"""{sweep_sql(activity, "es", f"x{name}", "l > 0 AND r > 0")}, {merged_sql(activity, f"m{name}")}, c{name} AS (SELECT user_id, coalesce(a.z, 0) AS a, coalesce(e.z, 0) AS e, coalesce(x.z, 0) AS x FROM {share.format(f"m{name}")} a FULL JOIN {share.format("me")} e USING (user_id) LEFT JOIN {share.format(f"x{name}")} x USING (user_id)),
    d{name} AS (SELECT user_id, CASE WHEN a > 0 THEN (a - x) / a END AS u, CASE WHEN e > 0 THEN (e - x) / e END AS v FROM c{name})"""
    return part


_TEXTS = """tx AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'en' ELSE 'ja' END AS language, string_agg(event_type, ' ' ORDER BY t, event_id) AS source, string_agg(CASE WHEN event_id % 3 = 0 THEN 'vew' ELSE event_type END, '' ORDER BY t, event_id) AS heard FROM ev GROUP BY 1)"""


@query(f"""WITH {EV}, {IV}, es AS (SELECT * FROM iv WHERE event_type = 'purchase' AND event_id % 6 > 0), sp AS (SELECT * FROM iv WHERE event_type IN ('view', 'click')), ct AS (SELECT * FROM iv WHERE event_type = 'error'), {merged_sql("es", "me")}, {_covered("s", "sp")}, {_covered("c", "ct")}, {_TEXTS},
    un AS (SELECT user_id, count(*) FILTER (event_id % 6 = 0) AS unresolved FROM iv WHERE event_type = 'purchase' GROUP BY 1)
    SELECT tx.user_id AS recording_id, round(CASE WHEN language = 'en' THEN levenshtein(replace(source, ' ', ''), heard) / greatest(length(replace(source, ' ', '')), length(heard)) END, 6) AS lexical_score, coalesce(unresolved, 0) AS unresolved,
    round(s.u, 6) AS spectral_uncovered, round(s.v, 6) AS spectral_excess, round(greatest(s.u, s.v), 6) AS spectral_score, round(c.u, 6) AS ctc_uncovered, round(c.v, 6) AS ctc_excess, round(greatest(c.u, c.v), 6) AS ctc_score FROM tx LEFT JOIN un USING (user_id) LEFT JOIN ds s USING (user_id) LEFT JOIN dc c USING (user_id)""")
def coverage_diagnostics(spark, d):
    """Purchases as lines, against two kinds of activity and a text heard without the source (I8)."""
    e = events(spark, d)
    rows = lambda *kinds: intervals(e, *kinds).withColumnRenamed("user_id", "recording_id")
    p = rows("purchase")
    placed = F.col("event_id") % 6 > 0
    lines = p.select("recording_id", F.col("event_id").alias("line_id"), F.when(placed, F.col("begin")).alias("begin"), F.when(placed, F.col("end")).alias("end"))
    joined = lambda word, by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", word.alias("w")))), lambda x: x["w"]), by)
    heard = F.when(F.col("event_id") % 3 == 0, "vew").otherwise(F.col("event_type"))
    texts = e.groupBy(F.col("user_id").alias("recording_id")).agg(joined(F.col("event_type"), " ").alias("source_text"), joined(heard, "").alias("greedy_text")).withColumn("language", F.when(F.col("recording_id") % 2 == 0, "en").otherwise("ja"))
    out = scores.coverage_diagnostic(lines, {"spectral": rows("view", "click"), "ctc": rows("error")}, texts)
    return out.select(*[F.col(c) if c in ("recording_id", "unresolved") else F.round(c, 6).alias(c) for c in out.columns])


_CAND = "cand AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 1.5 ELSE event_id % 100 / 100.0 END AS agreement, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 37 / 37.0 - 0.1 END AS similarity, CAST(floor(value) AS BIGINT) AS v FROM ev)"


@query(f"""WITH {EV}, {_CAND}, x AS (SELECT *, agreement > 1 OR similarity IS NULL AS bad_score, v % 7 = 0 AS none, v % 7 > 0 AND v % 5 = 1 AS misplaced, v * 1000000 + 2000000 AS length FROM cand),
    r AS (SELECT *, [CASE WHEN bad_score THEN 'invalid_score' END, CASE WHEN none THEN 'missing_line_support' END, CASE WHEN misplaced THEN 'invalid_or_skipped_timing' END] AS f, [CASE WHEN agreement < 0.5 THEN 'weak_token_agreement' END, CASE WHEN similarity < 0.0 THEN 'weak_span_similarity' END, CASE WHEN length > {match.MAX_PASSAGE_US} THEN 'extended_passage' END] AS g FROM x),
    s AS (SELECT *, list_sort(list_filter(CASE WHEN bad_score OR none OR misplaced THEN f ELSE g END, lambda y: y IS NOT NULL)) AS reasons FROM r)
    SELECT event_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS eligible, round(CASE WHEN len(reasons) = 0 THEN (agreement + similarity) / 2 ELSE 0 END, 9) AS score, round(CASE WHEN len(reasons) = 0 THEN greatest(0, (agreement + similarity) / 2 - {match.UTILITY_FLOOR}) ELSE 0 END, 9) AS utility FROM s""")
def assessed_candidates(spark, d):
    """Reasons against passages, their score and utility."""
    n, v = F.col("event_id"), F.floor("value")
    pair = lambda b, e: F.struct(b.cast("bigint").alias("b"), e.cast("bigint").alias("e"))
    two = F.array(pair(F.lit(1_000_000), F.lit(2_000_000)), pair(F.when(v % 5 == 1, 1_500_000).otherwise(2_000_000), v * 1_000_000 + 3_000_000))
    rows = events(spark, d).select("event_id", F.when(n % 11 == 0, 1.5).otherwise(n % 100 / 100).alias("agreement"), F.when(n % 13 > 0, n % 37 / 37 - 0.1).alias("similarity"), F.when(v % 7 == 0, F.array().cast("array<struct<b:bigint,e:bigint>>")).otherwise(two).alias("lines"), F.lit(10**12).alias("duration"))
    out = match.assess(rows)
    return out.select("event_id", F.array_join("reasons", ",").alias("reasons"), "eligible", F.round("score", 9).alias("score"), F.round("utility", 9).alias("utility"))
