"""Text, number, time and quality rules as queries over documents, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.functions import text as tx
from versewise.functions import times as tm
from versewise.operators import quality
from versewise.plans.registry import EV, LINES, events, lines, query, table
from versewise.sources import records

#: Decomposed letters, and a line that holds them.
_LOOSE = "replace(replace(line, 'é', 'é'), 'ü', 'ü')"


def _sql(select: str, source: str = "ln", more: str = "") -> str:
    return f"WITH {LINES} SELECT doc_id, line_no, {select} FROM {source} {more}"


def _lines(spark, d, **columns):
    return lines(spark, d).select("doc_id", "line_no", *[c.alias(n) for n, c in columns.items()])


@query("SELECT doc_id, nfc_normalize(text) AS clean FROM documents")
def composed_breaks(spark, d):
    """Texts with foreign line ends, a byte order mark and loose marks, made regular (B2)."""
    rough = F.expr("concat('﻿', replace(replace(replace(text, 'é', 'é'), 'ü', 'ü'), '\\n', '\\r\\n'))")
    return table(spark, d, "documents").select("doc_id", tx.compose(tx.unify_breaks(rough)).alias("clean"))


_QUOTED = "translate(line, 'oqw', '‘`´')"


@query(_sql(f"regexp_replace(regexp_replace(translate({_QUOTED}, 'ʼ`´＇', '’’’’'), '([\\p{{L}}\\p{{N}}])‘', '\\1’', 'g'), '‘([0-9][0-9]s\\b)', '’\\1', 'g') AS clean"))
def apostrophes(spark, d):
    return _lines(spark, d, clean=tx.unify_apostrophes(F.expr(_QUOTED)))


_LABELLED = "CASE WHEN line_no % 3 = 0 THEN concat(' [', line, '] ') WHEN line_no % 3 = 1 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz ', '') ELSE line END"


@query(_sql(f"regexp_matches(x, '^\\s*\\[[^\\]]*\\]\\s*$') AS label, regexp_matches(x, '[\\p{{L}}\\p{{M}}\\p{{Nd}}]') AS letters", f"(SELECT doc_id, line_no, {_LABELLED} AS x FROM ln)"))
def label_lines(spark, d):
    x = F.expr(_LABELLED)
    return _lines(spark, d, label=tx.is_section_label(x), letters=tx.has_letters(x))


@query(_sql("nullif(trim(regexp_replace(regexp_extract(CASE WHEN line_no % 2 = 0 THEN ' Written  BY : ' || line || ' ' ELSE line END, '(?i)^\\s*written\\s+by\\s*:\\s*(.+?)\\s*$', 1), '\\s+', ' ', 'g')), '') AS names"))
def credit_lines(spark, d):
    return _lines(spark, d, names=tx.credit(F.expr("CASE WHEN line_no % 2 = 0 THEN concat(' Written  BY : ', line, ' ') ELSE line END")))


@query(_sql("line_no % 2 = 0 OR starts_with(ltrim(line), '>') AS second, regexp_replace(CASE WHEN line_no % 2 = 0 THEN '  >' || line ELSE line END, '^\\s*>', '') AS bare"))
def second_voices(spark, d):
    x = F.expr("CASE WHEN line_no % 2 = 0 THEN concat('  >', line) ELSE line END")
    return _lines(spark, d, second=tx.is_second_voice(x), bare=tx.without_voice_mark(x))


_PHRASED = "translate(line, '.,', '()')"


@query(_sql(f"array_to_string(list_filter(list_transform(regexp_extract_all({_PHRASED}, '\\(([^()]*)\\)', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), '|') AS backing, regexp_replace(trim(regexp_replace(regexp_replace({_PHRASED}, '\\([^()]*\\)', ' ', 'g'), '\\s+', ' ', 'g')), ' ([,.;:!?])', '\\1', 'g') AS main"))
def backing_phrases(spark, d):
    x = F.expr(_PHRASED)
    return _lines(spark, d, backing=F.concat_ws("|", tx.backing(x)), main=tx.main_text(x))


@query(_sql("strip_accents(line) AS folded"))
def folded_letters(spark, d):
    return _lines(spark, d, folded=tx.fold_latin(F.col("line")))


@query(_sql("CASE WHEN c <> '' THEN 'U+' || lpad(upper(to_hex(unicode(c))), 4, '0') END AS code", "(SELECT *, regexp_extract(strip_accents(line), '([^\\sA-Za-z\\p{P}’])', 1) AS c FROM ln)"))
def unsupported_characters(spark, d):
    return _lines(spark, d, code=tx.first_unsupported(F.col("line")))


_EN = "CASE WHEN line_no % 4 = 0 THEN line ELSE translate(line, 'äéöü0123456789$#', '') END"


@query(_sql("CASE WHEN NOT regexp_matches(x, '[\\p{S}\\p{M}\\p{C}\\p{N}]|[^\\P{L}A-Za-z]') THEN array_to_string(list_transform(regexp_extract_all(x, '[A-Za-z]+(?:[''’][A-Za-z]+)*'), lambda w: lower(replace(w, '’', ''''))), ' ') END AS words", f"(SELECT doc_id, line_no, {_EN} AS x FROM ln)"))
def english_lines(spark, d):
    w = tx.english_words(F.expr(_EN))
    return _lines(spark, d, words=F.when(w.isNotNull(), F.array_join(w, " ")))


@query(f"WITH {EV} SELECT event_id, coalesce(CASE WHEN event_id % 7 > 0 THEN value / 100 END, 1) < 0.4 OR event_type IN ('click', 'error') AS low FROM ev")
def low_confidence_rows(spark, d):
    return events(spark, d).select("event_id", tx.low_confidence(F.when(F.col("event_id") % 7 > 0, F.col("value") / 100), F.array("event_type"), ["click", "error"]).alias("low"))


@query(_sql("line_no % 5 = 0 AS japanese"))
def japanese_lines(spark, d):
    return _lines(spark, d, japanese=tx.has_japanese(F.when(F.col("line_no") % 5 == 0, F.concat("line", F.lit("かな"))).otherwise(F.col("line"))))


@query(f"WITH {LINES}, w AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS w FROM ln) SELECT doc_id, line_no, CAST(sum(greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+')))) AS BIGINT) AS syllables FROM w GROUP BY 1, 2")
def syllable_counts(spark, d):
    w = lines(spark, d).select("doc_id", "line_no", F.explode(F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0))).alias("w"))
    return w.groupBy("doc_id", "line_no").agg(F.sum(tx.syllables(F.col("w"))).cast("bigint").alias("syllables"))


@query("SELECT o_orderkey, sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS digest FROM orders")
def json_fingerprints(spark, d):
    return table(spark, d, "orders").select("o_orderkey", tx.fingerprint(F.col("o_orderkey"), F.col("o_orderstatus")).alias("digest"))


@query(f"WITH {LINES} SELECT doc_id, line_no, CAST(k AS BIGINT) AS k, regexp_matches(substr({_LOOSE}, k, 100), '^[\\p{{M}}\\x{{200D}}]') AS inside FROM (SELECT *, unnest([2, 5, 11, 17]) AS k FROM ln)")
def grapheme_cuts(spark, d):
    rows = lines(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, (2, 5, 11, 17)))))
    return rows.select("doc_id", "line_no", F.col("k").cast("bigint").alias("k"), tx.joins_grapheme(F.expr(f"substring({_LOOSE}, k, 100)")).alias("inside"))


@query(_sql("substr(line, 3, 5) AS slice"))
def utf16_slices(spark, d):
    return _lines(spark, d, slice=tx.utf16_slice(F.col("line"), F.lit(2), F.lit(5)))


@query(_sql("array_to_string(list_concat(CASE WHEN regexp_matches(x, '\\[.*\\]') THEN ['bracketed'] ELSE [] END, CASE WHEN regexp_matches(x, '\\(.*\\)') THEN ['parenthesised'] ELSE [] END, CASE WHEN regexp_matches(x, '[♩-♯]') THEN ['music'] ELSE [] END), '|') AS labels", "(SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN translate(line, ',.', '()') WHEN line_no % 3 = 1 THEN translate(line, 'ab', '[]') ELSE '♪' || line END AS x FROM ln)"))
def uncertain_texts(spark, d):
    x = F.expr("CASE WHEN line_no % 3 = 0 THEN translate(line, ',.', '()') WHEN line_no % 3 = 1 THEN translate(line, 'ab', '[]') ELSE concat('♪', line) END")
    return _lines(spark, d, labels=F.concat_ws("|", records.uncertainty(x)))


_DAY = 86_400_000_000


@query(f"WITH {EV}, c AS (SELECT event_id, t % {_DAY} AS c FROM ev) SELECT event_id, c AS clock, (c // 1000000) * 1000000 AS seconds, (c // 1000) * 1000 AS millis, CAST(NULL AS BIGINT) AS wrong FROM c")
def clock_times(spark, d):
    c = F.expr(f"t % {_DAY}")
    rows = events(spark, d).withColumn("c", c).withColumns({"s": F.expr("c div 1000000"), "f": F.expr("c % 1000000")})
    clock = F.format_string("%02d:%02d:%02d.%06d", F.expr("s div 3600"), F.expr("s div 60 % 60"), F.expr("s % 60"), F.col("f"))
    return rows.select("event_id", tm.ttml_time(clock).alias("clock"), tm.ttml_time(F.concat(F.col("s").cast("string"), F.lit("s"))).alias("seconds"), tm.ttml_time(F.concat(F.expr("cast(c div 1000 as string)"), F.lit("ms"))).alias("millis"), tm.ttml_time(F.format_string("%d:%d", "s", "f")).alias("wrong"))


@query(f"WITH {EV}, c AS (SELECT event_id, t // 1000 % 3600000 AS c FROM ev) SELECT event_id, c AS thousandths, (c // 10) * 10 AS hundredths, (c // 1000) * 1000 AS whole FROM c")
def tag_times(spark, d):
    rows = events(spark, d).select("event_id", F.expr("t div 1000 % 3600000").alias("c"))
    tag = lambda unit, form: tm.lrc_time(F.format_string(form, F.expr("c div 60000"), F.expr("c div 1000 % 60"), *([F.expr(f"c % 1000 div {unit}")] if unit < 1000 else [])))
    return rows.select("event_id", tag(1, "%d:%02d.%03d").alias("thousandths"), tag(10, "%d:%02d:%02d").alias("hundredths"), tag(1000, "%02d:%02d").alias("whole"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_extendedprice / 7 AS DECIMAL(20,7)) * 1000000, 0) AS BIGINT) AS us FROM lineitem")
def rounded_microseconds(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tm.seconds_to_us((F.col("l_extendedprice") / 7).cast("decimal(20,7)")).alias("us"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN 1000000 % CAST(l_quantity AS BIGINT) = 0 THEN l_partkey * (1000000 // CAST(l_quantity AS BIGINT)) END AS us FROM lineitem")
def tick_times(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tm.ticks_to_us(F.col("l_partkey"), F.col("l_quantity").cast("bigint")).alias("us"))


@query("SELECT l_orderkey, l_linenumber, l_partkey // gcd(l_partkey, q) AS num, q // gcd(l_partkey, q) AS den, l_partkey * 7 < 1000 * q AS less FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem)")
def reduced_fractions(spark, d):
    r = tm.rational(-F.col("l_partkey"), -F.col("l_quantity").cast("bigint"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"))
    return rows.select("l_orderkey", "l_linenumber", "r.num", "r.den", tm.rational_less(F.col("r"), F.struct(F.lit(1000).alias("num"), F.lit(7).alias("den"))).alias("less"))


@query("SELECT l_orderkey, l_linenumber, CAST(ceil(l_partkey / 800.0) AS BIGINT) AS frames, l_partkey * 1000000 // 60 AS start_us FROM lineitem")
def frame_counts(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tm.output_frames(F.col("l_partkey")).alias("frames"), tm.frame_start_us(F.col("l_partkey")).alias("start_us"))


@query(f"WITH {EV}, x AS (SELECT event_id, value / 50 - 0.5 AS x, least(1, greatest(0, value / 50 - 0.5)) AS c, greatest(0, value / 50 - 0.5) AS p FROM ev) SELECT event_id, round(c * c * (3 - 2 * c), 9) AS smooth, round(1 - (1 + p) * exp(-p), 9) AS damped, round(c * c * c * (c * (c * 6 - 15) + 10), 9) AS quintic FROM x")
def easing(spark, d):
    x = F.col("value") / 50 - 0.5
    return events(spark, d).select("event_id", F.round(tm.smoothstep(x), 9).alias("smooth"), F.round(tm.critical(x), 9).alias("damped"), F.round(tm.quintic(x), 9).alias("quintic"))


# Quality rules: rows of the tables with faults that follow from their numbers, and the rules' findings.
def _found(condition: str, rule: str, key: str = "user_id", row: str = "event_id", source: str = "ev") -> str:
    return f"SELECT CAST({key} AS BIGINT) AS recording_id, CAST({row} AS VARCHAR) AS row, '{rule}' AS rule_id FROM {source} WHERE {condition}"


@query(f"WITH {EV} " + " UNION ALL ".join(_found(c, r) for c, r in (("event_id % 5 = 0 AND event_id % 7 > 0", "missing_in_source"), ("event_id % 5 > 0 AND event_id % 7 = 0", "missing_in_stored"), ("event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 = 0", "mapping_changed"))))
def changed_mappings(spark, d):
    e = events(spark, d)
    fresh = e.where("event_id % 5 > 0").withColumn("value", F.when(F.col("event_id") % 11 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return quality.changed_rows(e.where("event_id % 7 > 0"), fresh, "user_id", "event_id", ["value", "event_type"])


@query(f"WITH {EV} " + _found("event_id % 3 > 0 AND (event_id % 9 = 1 OR event_id % 4 = 0)", "review_without_history"))
def unexplained_reviews(spark, d):
    e = events(spark, d)
    state = F.when(F.col("event_id") % 3 == 0, "unreviewed").otherwise("accepted")
    history = e.where("event_id % 9 <> 1").select("user_id", "event_id", F.when(F.col("event_id") % 4 == 0, "rejected").otherwise("accepted").alias("action"))
    return quality.reviewed_without_history(e.withColumn("state", state), history, "user_id", "event_id", "state")


_OBS = "(SELECT user_id, CASE WHEN event_id % 50 = 1 THEN event_id - 1 ELSE event_id END AS obs_id, CAST(floor(value) AS BIGINT) - 2 AS a, CAST(floor(value) AS BIGINT) - 2 + event_id % 4 AS b, CASE WHEN event_id % 6 = 0 THEN ' ' WHEN event_id % 8 = 0 THEN event_type || chr(7) ELSE event_type END AS x FROM ev)"


@query(f"WITH {EV}, o AS (SELECT *, count(*) OVER (PARTITION BY user_id, obs_id) AS n FROM {_OBS}) " + " UNION ALL ".join(_found(c, r, row="obs_id", source="o") for c, r in (("n > 1", "duplicate_id"), ("a < 0 OR a >= b", "invalid_ticks"), ("a < 1 OR b > 60", "outside_window"), ("regexp_matches(x, '\\p{Cc}')", "control_character"), ("trim(x) = ''", "empty_text"))))
def observation_faults(spark, d):
    e = events(spark, d)
    id_ = F.when(F.col("event_id") % 50 == 1, F.col("event_id") - 1).otherwise(F.col("event_id"))
    text = F.when(F.col("event_id") % 6 == 0, F.lit(" ")).when(F.col("event_id") % 8 == 0, F.concat("event_type", F.lit("\x07"))).otherwise(F.col("event_type"))
    a = F.floor("value") - 2
    rows = e.select(F.col("user_id").alias("recording_id"), id_.alias("obs_id"), a.alias("begin_tick"), (a + F.col("event_id") % 4).alias("end_tick"), F.lit(1).alias("window_begin"), F.lit(60).alias("window_end"), text.alias("text"))
    return quality.observation_violations(rows)


_OVER = "(SELECT doc_id, line_no, line, (line_no * 7) AS a, CASE WHEN line_no % 4 = 0 THEN 9 WHEN line_no % 4 = 1 THEN 0 ELSE 5 END AS n FROM ln)"


@query(f"WITH {LINES}, o AS (SELECT *, max(a + n) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto, substr(line, a + 1, n) AS slice, CASE WHEN line_no % 6 = 0 THEN 'other' ELSE substr(line, a + 1, n) END AS x FROM {_OVER}) " + " UNION ALL ".join(_found(c, r, "doc_id", "a", "o") for c, r in (("a < upto", "override_overlap"), ("n <= 0", "override_empty"), ("slice IS DISTINCT FROM x", "wrong_slice"))))
def override_faults(spark, d):
    size = F.when(F.col("line_no") % 4 == 0, 9).when(F.col("line_no") % 4 == 1, 0).otherwise(5)
    rows = lines(spark, d).select(F.col("doc_id").alias("recording_id"), F.lit(0).alias("paragraph"), (F.col("line_no") * 7).cast("int").alias("start_utf16"), size.alias("length_utf16"), F.col("line").alias("source"), "line_no")
    text = F.when(F.col("line_no") % 6 == 0, F.lit("other")).otherwise(tx.utf16_slice(F.col("source"), F.col("start_utf16"), F.col("length_utf16")))
    return quality.override_violations(rows.withColumn("text", text))


_A, _B, _C, _E = "event_id % 10 - 1", "5 + event_id % 3", "10 + 2 * (event_id % 7)", "20 + 3 * (event_id % 7) - 8 * (event_id % 2)"


@query(f"WITH {EV} " + " UNION ALL ".join(_found(c, r) for c, r in ((f"{_A} > {_B} OR {_C} > {_E} OR {_B} > {_C}", "band_order"), (f"{_A} < 0 OR {_E} > 36", "band_bounds"), ("event_type NOT IN ('click', 'view')", "unknown_kind"))))
def annotation_faults(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), "vocal").otherwise("noise")
    bands = [F.expr(x).alias(n) for x, n in ((_A, "onset_earliest_us"), (_B, "onset_latest_us"), (_C, "offset_earliest_us"), (_E, "offset_latest_us"))]
    rows = events(spark, d).select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("seq"), *bands, F.lit(36).alias("duration_us"), kind.alias("kind"))
    return quality.annotation_violations(rows)


@query("WITH p AS (SELECT o_custkey AS k, count(*) AS n, count(DISTINCT o_orderpriority) AS people, count(DISTINCT o_orderstatus) AS audio FROM orders GROUP BY 1) " + " UNION ALL ".join(_found(c, r, "k", "k", "p") for c, r in (("n <> 2", "not_two_passes"), ("people < n", "same_annotator"), ("audio > 1", "different_audio"))))
def pass_faults(spark, d):
    return quality.pass_violations(table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("annotator"), F.col("o_orderstatus").alias("audio_sha256")))


@query(f"WITH {EV}, p AS (SELECT user_id, t // {_DAY} AS o, count(*) AS n, count(DISTINCT event_type) AS ids FROM ev GROUP BY 1, 2) " + " UNION ALL ".join(_found(c, r, row="o", source="p") for c, r in (("n > ids", "duplicate_candidate"), ("n > 64", "too_many_candidates"))))
def candidate_faults(spark, d):
    return quality.candidate_violations(events(spark, d).select(F.col("user_id").alias("recording_id"), F.expr(f"t div {_DAY}").alias("occurrence"), F.col("event_type").alias("id")))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_KANA = {"kata": "アイカキーサシタチナニハヒマミヤラリワンガギザジダヂ", "hira": "あいかきーさしたちなにはひまみやらりわんがぎざじだぢ"}
_RUNS = {"kata": "\\x{30A1}-\\x{30FA}ー\\x{3099}\\x{309A}", "hira": "\\x{3041}-\\x{3096}ー\\x{3099}\\x{309A}"}


@query(f"""WITH {LINES}, k AS (SELECT doc_id, line_no, CASE WHEN doc_id % 2 = 0 THEN translate(lower(line), '{_LETTERS}', '{_KANA["kata"]}') ELSE translate(lower(line), '{_LETTERS}', '{_KANA["hira"]}') END AS text FROM ln WHERE doc_id % 5 <> 2),
    c AS (SELECT doc_id, line_no, text, i, text[i] AS ch FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM k)), l AS (SELECT * FROM c WHERE NOT regexp_matches(ch, '[\\p{{P}}\\s]')),
    g AS (SELECT *, sum(CASE WHEN ch <> 'ー' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no, i) AS gap FROM l), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gap ORDER BY line_no, i) AS nth, count(*) FILTER (i % 4 <> 0) OVER (PARTITION BY doc_id, gap) AS have FROM g WHERE ch = 'ー'),
    x AS (SELECT *, regexp_matches(text[greatest(1, i - 1)], '[\\x{{30A1}}-\\x{{30FA}}]') AS kata FROM m WHERE nth > have),
    y AS (SELECT *, regexp_extract(text[1:i - 1], CASE WHEN kata THEN '([{_RUNS["kata"]}]*)$' ELSE '([{_RUNS["hira"]}]*)$' END, 1) AS a, regexp_extract(text[i:], CASE WHEN kata THEN '^([{_RUNS["kata"]}]*)' ELSE '^([{_RUNS["hira"]}]*)' END, 1) AS z FROM x),
    r AS (SELECT DISTINCT doc_id, line_no, i - 1 - length(a) AS start_utf16, length(a) + length(z) AS length_utf16, a || z AS text FROM y),
    o AS (SELECT *, coalesce(lag(start_utf16 + length_utf16) OVER (PARTITION BY doc_id, line_no ORDER BY start_utf16, length_utf16) > start_utf16, false) AS clash FROM r)
    SELECT doc_id, line_no, start_utf16, length_utf16, text FROM o WHERE doc_id NOT IN (SELECT doc_id FROM o WHERE clash)""")
def long_vowels(spark, d):
    """Lines as kana, e as the long-vowel mark; the units lose every mark at a place that four divides, some have a letter more."""
    rows = lines(spark, d).select(F.col("doc_id").alias("recording_id"), F.col("line_no").alias("paragraph"), F.when(F.col("doc_id") % 2 == 0, F.translate(F.lower("line"), _LETTERS, _KANA["kata"])).otherwise(F.translate(F.lower("line"), _LETTERS, _KANA["hira"])).alias("text"))
    heard = F.array_join(F.filter(F.split("text", ""), lambda c, i: (c != "ー") | ((i + 1) % 4 != 0)), "")
    units = rows.select("recording_id", F.col("paragraph").alias("unit"), F.concat(heard, F.when(F.col("recording_id") % 5 == 2, "ン").otherwise("")).alias("text"))
    return quality.long_vowel_suggestions(rows, units).select(F.col("recording_id").alias("doc_id"), F.col("paragraph").alias("line_no"), F.col("start_utf16").cast("bigint").alias("start_utf16"), F.col("length_utf16").cast("bigint").alias("length_utf16"), "text")



@query(f"WITH {EV}, s AS (SELECT user_id, event_id, t, CAST(floor(value) AS BIGINT) AS d FROM ev) " + " UNION ALL ".join(_found(c, r, source="s") for c, r in (("t + d > t + 60 OR t + 2 * d > t + 60 OR t + d - event_id % 3 < t", "segment_outside"), ("event_id % 3 > 0", "segment_order"), ("d <= 0 OR t + d - event_id % 3 >= t + 2 * d", "segment_empty"))))
def segment_faults(spark, d):
    t, n = F.col("t"), F.col("n")
    seg = lambda a, b: F.struct(a.alias("begin_us"), b.alias("end_us"))
    rows = events(spark, d).withColumn("n", F.floor("value"))
    return quality.segment_violations(rows.select("user_id", "event_id", t.alias("b"), (t + 60).alias("e"), F.array(seg(t, t + n), seg(t + n - F.col("event_id") % 3, t + 2 * n)).alias("s")), "user_id", "event_id", "b", "e", "s")
