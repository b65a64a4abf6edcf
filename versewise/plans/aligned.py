"""Unit mapping and bridging (E40, E38), segment evidence (I7), frozen thresholds (I11, A18, B20), held-out spacing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.functions import text as tx
from versewise.operators import labels, stats
from versewise.plans.measures import _SCORE, _scores
from versewise.plans.registry import EV, HOUR, LINES, MONTH, events, lines, query, table
from versewise.sources import records, sinks
from versewise.streaming.replay import shared_folder


@query(f"""WITH {LINES}, a AS (SELECT doc_id, line_no, regexp_replace(lower(line), '[^a-z]', '', 'g') AS x FROM ln), b AS (SELECT doc_id, line_no, sum(length(x)) OVER w AS e, sum(length(x)) OVER w - length(x) AS b, sum(length(x)) OVER (PARTITION BY doc_id) AS n FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    c AS (SELECT *, (n + 6) // 7 AS nu, e > b AND b % 7 = 0 AND (e % 7 = 0 OR e = n) AS whole FROM b),
    d AS (SELECT *, CASE WHEN doc_id % 10 = 4 AND nu > 2 THEN 'units_out_of_order' WHEN n = 0 OR doc_id % 10 = 3 THEN 'text_mismatch' END AS why FROM c)
    SELECT doc_id, line_no, CASE WHEN why IS NULL AND whole THEN CAST(b // 7 * 100000 AS BIGINT) END AS begin_us, CASE WHEN why IS NULL AND whole THEN CAST((e - 1) // 7 * 100000 + 90000 AS BIGINT) END AS end_us, coalesce(why, CASE WHEN NOT whole THEN 'unaligned' END) AS unresolved FROM d""")
def mapped_lines(spark, d):
    """Units of seven letters over the lines' letters; some documents lose their last unit, some have one that begins too early."""
    rows = lines(spark, d).select(F.col("doc_id").alias("recording_id"), F.col("line_no").alias("line_id"), F.regexp_replace(F.lower("line"), "[^a-z]", "").alias("alignment_text"))
    whole = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("line_id", "alignment_text"))).alias("x"))
    cut = whole.select("recording_id", F.regexp_extract_all(F.array_join(F.transform("x", lambda v: v["alignment_text"]), ""), F.lit(".{1,7}"), F.lit(0)).alias("u"))
    kept = F.when(F.col("recording_id") % 10 == 3, F.slice("u", F.lit(1), F.greatest(F.lit(0), F.size("u") - 1))).otherwise(F.col("u"))
    units = cut.select("recording_id", F.posexplode(kept).alias("unit", "text"))
    early = F.when((F.col("recording_id") % 10 == 4) & (F.col("unit") == 2), 50_000).otherwise(0)
    units = units.withColumns({"begin_us": (F.col("unit") * 100_000 - early).cast("bigint"), "end_us": (F.col("unit") * 100_000 + 90_000).cast("bigint")})
    return labels.units_to_lines(units, rows).select(F.col("recording_id").alias("doc_id"), F.col("line_id").alias("line_no"), "begin_us", "end_us", "unresolved")


@query(f"""WITH {LINES}, w AS (SELECT doc_id, line_no, w, unnest(range(1, len(w) + 1)) AS k FROM (SELECT doc_id, line_no, regexp_extract_all(line, '[A-Za-z]+') AS w FROM ln)),
    u AS (SELECT doc_id, line_no, k, greatest(1, len(regexp_extract_all(lower(w[k]), '[aeiouy]+'))) AS s, CASE WHEN length(w[k]) % 3 > 0 THEN k * 500000 END AS b, CASE WHEN length(w[k]) % 3 > 0 THEN k * 500000 + 40000 * length(w[k]) END AS e, (len(w) + 1) * 500000 AS high FROM w),
    p AS (SELECT doc_id, line_no, list_sort(list(e - b) FILTER (b IS NOT NULL)) AS sizes FROM u GROUP BY ALL),
    x AS (SELECT u.*, least(400000, greatest(120000, coalesce(sizes[len(sizes) // 2 + 1], 200000))) AS pace, CASE WHEN b IS NOT NULL THEN greatest(e, least(coalesce(lead(b) OVER (PARTITION BY doc_id, line_no ORDER BY k), e), e + 1000000)) END AS reach FROM u JOIN p USING (doc_id, line_no)),
    y AS (SELECT *, first_value(b IGNORE NULLS) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, last_value(reach IGNORE NULLS) OVER (PARTITION BY doc_id, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prv, count(b) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS run FROM x),
    z AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, line_no, run, b IS NULL) AS every, sum(s) OVER g AS upto, row_number() OVER g AS nth FROM y WINDOW g AS (PARTITION BY doc_id, line_no, run, b IS NULL ORDER BY k))
    SELECT doc_id, line_no, CAST(k AS BIGINT) AS unit, CAST(CASE WHEN b IS NOT NULL THEN b WHEN prv IS NULL THEN greatest(0, coalesce(nxt, 0) - pace * (every - upto + s)) WHEN nxt IS NULL THEN greatest(prv, least(high, prv + pace * (upto - s))) WHEN nth = 1 THEN prv ELSE greatest(prv, nxt) END AS BIGINT) AS unit_begin,
    CAST(CASE WHEN b IS NOT NULL THEN reach WHEN prv IS NULL THEN greatest(0, coalesce(nxt, 0) - pace * (every - upto)) WHEN nxt IS NULL THEN greatest(prv, least(high, prv + pace * upto)) ELSE greatest(prv, nxt) END AS BIGINT) AS unit_end FROM z""")
def bridged_units(spark, d):
    """Words of lines, those of a length that 3 divides without a span."""
    w = lines(spark, d).select("doc_id", "line_no", F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    u = w.select("doc_id", F.col("line_no").alias("line_id"), ((F.size("w").cast("bigint") + 1) * 500_000).alias("high"), F.posexplode("w").alias("i", "x")).withColumn("unit", (F.col("i") + 1).cast("bigint"))  # long: times in microseconds outgrow 32 bits
    has = F.length("x") % 3 > 0
    u = u.withColumns({"syllables": tx.syllables(F.col("x")), "begin_us": F.when(has, F.col("unit") * 500_000), "end_us": F.when(has, F.col("unit") * 500_000 + 40_000 * F.length("x"))})
    return labels.bridge_units(u, "doc_id", high="high").select("doc_id", F.col("line_id").alias("line_no"), "unit", "unit_begin", "unit_end")


_W, _HOP = 30 * HOUR, 26 * HOUR
_TEXT = "CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN '(click) on' WHEN 'purchase' THEN '[buy' ELSE '' END"


@query(f"""WITH {EV}, s AS (SELECT user_id, event_id, w, {MONTH[0]} + w * {_HOP} AS wb, t - {MONTH[0]} - w * {_HOP} AS rel, value, {_TEXT} AS text FROM (SELECT *, unnest(range(greatest(0, CAST(floor((t - {MONTH[0]} - {_W}) / {_HOP}) AS BIGINT) + 1), (t - {MONTH[0]}) // {_HOP} + 1)) AS w FROM ev) WHERE t - {MONTH[0]} - w * {_HOP} < {_W}),
    g AS (SELECT *, rel // 1000 - CASE WHEN value > 100 THEN 7200000 ELSE 0 END AS b, rel // 1000 + CAST(floor(value * 60000) AS BIGINT) - CASE WHEN value < 20 THEN 600000 ELSE 0 END AS e, {_W // 1000} AS size, row_number() OVER (PARTITION BY user_id, w ORDER BY rel, event_id) AS i FROM s),
    k AS (SELECT *, CASE WHEN b < 0 OR b >= e THEN 'invalid' WHEN e > size THEN 'out_of_window' ELSE 'valid' END AS status, wb // 10000 + b // 10 AS tick FROM g),
    h AS (SELECT *, last_value(CASE WHEN status = 'valid' THEN tick END IGNORE NULLS) OVER (PARTITION BY user_id, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
    j AS (SELECT *, CASE WHEN status = 'valid' AND tick < before THEN 'ambiguous' ELSE status END AS st, [CASE WHEN b < 0 OR b > e THEN 'invalid' WHEN e > size THEN 'out_of_window' END, CASE WHEN value > 60 THEN 'missing' WHEN b < 0 THEN 'invalid' WHEN b > size THEN 'out_of_window' WHEN b > e THEN 'outside_segment' END, CASE WHEN b < 0 OR b > e + 500 THEN 'invalid' WHEN e + 500 > size THEN 'out_of_window' ELSE 'outside_segment' END] AS faults FROM h)
    SELECT user_id, w AS "window", event_id, CASE WHEN st <> 'valid' THEN 'segment_timing_' || st WHEN text = '' THEN 'empty_recognition' END AS reason, regexp_matches(text, '\\[[^\\]]*\\]|\\([^)]*\\)') AS annotated, CAST(3 AS BIGINT) AS token_count,
    coalesce((SELECT string_agg(f || '=' || n, ',' ORDER BY f) FROM (SELECT f, count(*) AS n FROM (SELECT unnest(faults) AS f) WHERE f IS NOT NULL GROUP BY f)), '') AS token_issues, CAST(tick AS BIGINT) AS begin_tick FROM j""")
def segment_evidence(spark, d):
    """Events as recognised segments of overlapping windows, some out of order, some beyond their window."""
    e = events(spark, d).withColumn("at", F.col("t") - MONTH[0])
    first = F.greatest(F.lit(0), F.floor((F.col("at") - _W) / _HOP) + 1)
    s = e.withColumn("window", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("at") / _HOP))))).withColumn("rel", F.col("at") - F.col("window") * _HOP).where(f"rel >= 0 and rel < {_W}")
    begin = F.expr("rel div 1000") - F.when(F.col("value") > 100, 7_200_000).otherwise(0)
    end = F.expr("rel div 1000 + cast(floor(value * 60000) as bigint)") - F.when(F.col("value") < 20, 600_000).otherwise(0)
    s = s.withColumns({"begin_ms": begin, "end_ms": end, "text": F.expr(_TEXT), "segment": F.row_number().over(Window.partitionBy("user_id", "window").orderBy("rel", "event_id"))})
    token = lambda b, e: F.struct(b.alias("begin_ms"), e.alias("end_ms"))
    own = F.when(F.col("value") <= 60, F.col("begin_ms"))
    s = s.withColumn("tokens", F.array(token(F.col("begin_ms"), F.col("end_ms")), token(own, own), token(F.col("begin_ms"), F.col("end_ms") + 500)))
    s = s.withColumnRenamed("user_id", "recording_id")
    windows = s.select("recording_id", "window").distinct().withColumns({"begin_us": MONTH[0] + F.col("window") * _HOP, "end_us": MONTH[0] + F.col("window") * _HOP + _W})
    rows = records.projected_segments(s.select("recording_id", "window", "segment", "event_id", "text", "begin_ms", "end_ms", "tokens"), windows)
    issues = F.array_join(F.transform(F.map_entries("token_issues"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return rows.select(F.col("recording_id").alias("user_id"), "window", "event_id", "reason", (F.size("uncertainty") > 0).alias("annotated"), F.col("token_count").cast("bigint").alias("token_count"), issues.alias("token_issues"), "begin_tick")


_ORDER = ["doc_id", "lang", "matched", "legacy", "short_share", "line_share"]
_FEATURES = ["short_share", "line_share"]


def _frozen(spark, rows):
    """Thresholds fitted on rows, written and read back."""
    path = f"{shared_folder(spark, 'frozen')}/record"
    sinks.write_frozen(sinks.frozen_record(rows, stats.fit_features(rows, ["lang"], _FEATURES, "matched"), _ORDER), path)
    return sinks.read_frozen(spark, path, "lang string, feature string, threshold double")


@query(f"""WITH {_SCORE}, f AS (SELECT doc_id % 2 AS odd, lang, matched, legacy, feature, score FROM (SELECT *, 'short_share' AS feature, short_share AS score FROM sc UNION ALL SELECT *, 'line_share', line_share FROM sc)),
    g AS (SELECT lang, feature, max(score) FILTER (matched) AS good FROM f WHERE odd = 0 GROUP BY ALL), t AS (SELECT lang, feature, CASE WHEN good IS NOT NULL THEN coalesce((good + min(score) FILTER (NOT matched AND score > good)) / 2, 1.0) END AS threshold FROM f JOIN g USING (lang, feature) WHERE odd = 0 GROUP BY lang, feature, good),
    r AS (SELECT f.*, CASE WHEN odd = 0 THEN 'development' ELSE 'reserved' END AS role, score > threshold AS flag FROM f LEFT JOIN t USING (lang, feature)), b AS (SELECT *, 'alone' AS rule FROM r UNION ALL SELECT * REPLACE (CASE WHEN legacy THEN true ELSE flag END AS flag), 'with_legacy' FROM r)
    SELECT feature, rule, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, CASE WHEN grouping(role) = 1 THEN 'all' ELSE role END AS role, count(*) FILTER (matched AND flag) AS tp, count(*) FILTER (NOT matched AND flag) AS fp, count(*) FILTER (NOT matched AND NOT flag) AS tn, count(*) FILTER (matched AND NOT flag) AS fn, count(*) FILTER (flag IS NULL) AS unavailable
    FROM b GROUP BY GROUPING SETS ((feature, rule, lang, role), (feature, rule))""")
def frozen_scores(spark, d):
    """Thresholds fitted on documents of even id, frozen with them, and both halves scored by the record that is read back."""
    rows = _scores(spark, d).withColumn("role", F.when(F.col("doc_id") % 2 == 0, "development").otherwise("reserved"))
    development = rows.where("role = 'development'")
    record = _frozen(spark, development)
    held = sinks.require_fitted(development, record, _ORDER).unionByName(rows.where("role <> 'development'"))
    return stats.score_matrix(held, _FEATURES, record, "matched", "legacy", ["lang", "role"])


@query("SELECT * FROM (VALUES ('development', CAST(0 AS BIGINT)), ('reserved', 1), ('one score differs', 1)) AS v(rows_scored, violations)")
def refused_scores(spark, d):
    """Whether a record refuses the rows that it was fitted on, the other half, and the same rows with one score changed."""
    rows = _scores(spark, d)
    development = rows.where("doc_id % 2 = 0")
    record = _frozen(spark, development)
    least = development.agg(F.min("doc_id").alias("_least"))
    changed = development.crossJoin(least).withColumn("short_share", F.when(F.col("doc_id") == F.col("_least"), F.col("short_share") + 0.25).otherwise(F.col("short_share"))).drop("_least")
    count = lambda name, on: sinks.frozen_violations(on, record, _ORDER).agg(F.count("*").alias("violations")).select(F.lit(name).alias("rows_scored"), "violations")
    return count("development", development).unionByName(count("reserved", rows.where("doc_id % 2 = 1"))).unionByName(count("one score differs", changed))


@query("""WITH o AS (SELECT l_suppkey, regr_slope(l_extendedprice, l_quantity) AS own, avg(l_quantity) AS x, avg(l_extendedprice) AS y, count(*) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT a.l_suppkey, avg(b.own) AS scale, any_value(a.y) - avg(b.own) * any_value(a.x) AS shift, any_value(a.n) AS n FROM o a JOIN o b ON a.l_suppkey <> b.l_suppkey GROUP BY 1)
    SELECT l_suppkey, round(scale, 4) AS scale, round(shift, 3) AS "offset", n, round(sqrt(avg((l_extendedprice - shift - scale * l_quantity) ** 2)), 3) AS rmse, round(max(abs(l_extendedprice - shift - scale * l_quantity)), 3) AS worst FROM lineitem JOIN s USING (l_suppkey) GROUP BY l_suppkey, scale, shift, n""")
def spacing_held_out(spark, d):
    """Price by quantity of every supplier, judged by the mean slope of the others."""
    out = stats.held_out_spacing(table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_extendedprice").cast("double").alias("l_extendedprice")), "l_suppkey", "l_quantity", "l_extendedprice")
    return out.select("l_suppkey", F.round("scale", 4).alias("scale"), F.round("offset", 3).alias("offset"), "n", F.round("rmse", 3).alias("rmse"), F.round("worst", 3).alias("worst"))
