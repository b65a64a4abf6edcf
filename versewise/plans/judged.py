"""Scores of estimates against references, as queries over events: a day's events of a user are a recording's lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.operators import intervals as iv
from versewise.operators import schedule, stats
from versewise.plans import scores
from versewise.plans.registry import EV, IV, events, intervals, query

#: Lines with a reference interval and an estimate beside it; some are not placed, some texts differ.
_PAIRS = """pr AS (SELECT user_id AS recording_id, event_id AS line_id, event_type AS text, "begin" AS rb, "end" AS re,
    CASE WHEN event_id % 6 > 0 THEN "begin" + 400000 * (event_id % 13 - 6) * CASE WHEN event_id % 10 = 0 THEN 1000 ELSE 1 END END AS eb,
    CASE WHEN event_id % 6 > 0 THEN "end" + 300000 * (event_id % 11 - 5) END AS ee FROM iv)"""
_HIT = "greatest(eb, rb) < least(ee, re)"


def _pairs(spark, d):
    n = F.col("line_id")
    rows = intervals(events(spark, d)).select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("line_id"), F.col("event_type").alias("ref_text"), F.col("begin").alias("ref_begin_us"), F.col("end").alias("ref_end_us"))
    wide = F.when(n % 10 == 0, 1000).otherwise(1)
    return rows.withColumns({"est_begin_us": F.when(n % 6 > 0, F.col("ref_begin_us") + 400000 * (n % 13 - 6) * wide), "est_end_us": F.when(n % 6 > 0, F.col("ref_end_us") + 300000 * (n % 11 - 5))})


def _sides(spark, d):
    side = lambda p: _pairs(spark, d).select("recording_id", "line_id", F.col("ref_text").alias("text"), F.col(f"{p}_begin_us").alias("begin_us"), F.col(f"{p}_end_us").alias("end_us"))
    return side("est"), side("ref")


@query(f"""WITH {EV}, {IV}, {_PAIRS} SELECT recording_id, CAST(line_id AS VARCHAR) AS row, CASE WHEN line_id % 7 = 0 THEN 'missing_in_reference' WHEN line_id % 5 = 0 THEN 'missing_in_report' ELSE 'text_mismatch' END AS rule_id
    FROM pr WHERE NOT (line_id % 7 = 0 AND line_id % 5 = 0) AND (line_id % 7 = 0 OR line_id % 5 = 0 OR line_id % 4 = 0)""")
def positional_faults(spark, d):
    est, ref = _sides(spark, d)
    est = est.where("line_id % 5 > 0").withColumn("text", F.when(F.col("line_id") % 4 == 0, "other").otherwise(F.col("text")))
    return scores.positional_join(est, ref.where("line_id % 7 > 0"))[1]


@query(f"""WITH {EV}, {IV}, {_PAIRS}, x AS (SELECT *, (eb - rb) / 1000.0 AS "on", (ee - re) / 1000.0 AS "off", coalesce({_HIT}, false) AS hit FROM pr WHERE eb IS NOT NULL)
    SELECT recording_id, count(*) AS n, round(quantile_cont(abs("on"), 0.5), 4) AS onset_median, round(quantile_cont(abs("on"), 0.95), 4) AS onset_p95, round(avg(CASE WHEN abs("on") > 500 THEN 1 ELSE 0 END), 6) AS onset_late,
    round(quantile_cont(abs("off"), 0.5), 4) AS offset_median, round(quantile_cont(abs("off"), 0.95), 4) AS offset_p95, round(avg(CASE WHEN abs("off") > 500 THEN 1 ELSE 0 END), 6) AS offset_late,
    count(*) FILTER (abs("on") > 2000) + count(*) FILTER (abs("off") > 2000) AS far, count(*) FILTER (NOT hit) AS misses FROM x GROUP BY 1""")
def boundary_summaries(spark, d):
    rows = _pairs(spark, d).where("est_begin_us is not null")
    on, off = (F.col("est_begin_us") - F.col("ref_begin_us")) / 1000, (F.col("est_end_us") - F.col("ref_end_us")) / 1000
    hit = iv.overlaps(F.col("est_begin_us"), F.col("est_end_us"), F.col("ref_begin_us"), F.col("ref_end_us"))
    out = rows.groupBy("recording_id").agg(*stats.boundary_summary(on, off, hit))
    return out.withColumns({c: F.round(c, 4 if c.endswith(("median", "p95")) else 6) for c in out.columns if c.startswith(("onset", "offset"))})


@query(f"""WITH {EV}, {IV}, {_PAIRS}, x AS (SELECT recording_id, eb IS NOT NULL AS placed, eb IS NOT NULL AND {_HIT} AS hit, (eb - rb) / 1000.0 AS "on", (ee - re) / 1000.0 AS "off" FROM pr)
    SELECT recording_id, count(*) AS lines, count(*) FILTER (placed) AS placed, count(*) FILTER (hit) AS overlapping, count("on") AS on_n, round(avg(abs("on")), 4) AS on_mae, round(max(abs("on")), 4) AS on_worst FROM x GROUP BY 1""")
def song_scores(spark, d):
    out = scores.full_song_score(_pairs(spark, d))
    return out.select("recording_id", "lines", "placed", "overlapping", "on_n", F.round("on_mae", 4).alias("on_mae"), F.round("on_worst", 4).alias("on_worst"))


@query(f"""WITH {EV}, {IV}, {_PAIRS}, g AS (SELECT CAST(recording_id AS VARCHAR) AS grp, * FROM pr UNION ALL SELECT 'all', * FROM pr)
    SELECT grp AS "group", count(*) AS lines, count(*) FILTER (eb IS NOT NULL AND {_HIT}) AS "right", count(*) FILTER (eb IS NOT NULL AND NOT {_HIT}) AS wrong, count(*) FILTER (eb IS NULL) AS unresolved FROM g GROUP BY 1""")
def qualified_rates(spark, d):
    return scores.qualification(_pairs(spark, d)).select("group", "lines", "right", "wrong", "unresolved")


@query(f"""WITH {EV}, {IV}, {_PAIRS}, c AS (SELECT recording_id, eb AS b, ee AS e FROM pr WHERE eb < ee AND line_id % 3 = 0)
    SELECT DISTINCT pr.recording_id, line_id FROM pr JOIN c ON pr.recording_id = c.recording_id AND greatest(rb, b) < least(re, e)""")
def available_lines(spark, d):
    est, ref = _sides(spark, d)
    candidates = est.where("begin_us < end_us and line_id % 3 = 0").select("recording_id", F.col("begin_us").alias("begin"), F.col("end_us").alias("end"))
    return scores.availability(candidates, ref).select("recording_id", "line_id")


@query(f"""WITH {EV}, {IV}, o AS (SELECT user_id, "begin" - 60000000 * (event_id % 3) AS b, "end" + 60000000 AS e FROM iv WHERE event_id % 2 = 0)
    SELECT user_id, event_id FROM iv WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = iv.user_id AND o.b <= iv."begin" AND iv."end" <= o.e)""")
def uncontained_intervals(spark, d):
    rows = intervals(events(spark, d)).select("user_id", "event_id", "begin", "end")
    outer = rows.where("event_id % 2 = 0").select("user_id", (F.col("begin") - 60000000 * (F.col("event_id") % 3)).alias("begin"), (F.col("end") + 60000000).alias("end"))
    return iv.not_contained(rows, outer, "user_id", 3_600_000_000).select("user_id", "event_id")


@query(f"""WITH {EV}, {IV}, w AS (SELECT user_id, m, o + m * 43200000000 AS b, o + m * 43200000000 + 60000000000 AS e FROM (SELECT DISTINCT user_id, 1704067200000000 AS o FROM iv), (SELECT unnest(range(0, 62)) AS m))
    SELECT iv.user_id, event_id, m AS "window" FROM iv JOIN w ON iv.user_id = w.user_id AND greatest("begin", b) < least("end", e)""")
def lines_in_windows(spark, d):
    rows = intervals(events(spark, d)).select("user_id", "event_id", "begin", "end")
    windows = rows.select("user_id").distinct().withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(61)))).withColumn("begin", F.lit(1_704_067_200_000_000) + F.col("window").cast("bigint") * 43_200_000_000)
    met = iv.windows_of_lines(rows, windows.withColumn("end", F.col("begin") + 60_000_000_000), "user_id", 3_600_000_000)
    return met.select("user_id", F.col("l_event_id").alias("event_id"), F.col("r_window").cast("bigint").alias("window"))


@query(f"""WITH {EV} SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other FROM ev GROUP BY 1""")
def state_counts(spark, d):
    return stats.state_counts(events(spark, d), ["user_id"], "event_type", ["click", "view"])


@query(f"WITH {EV}, c AS (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS rank FROM c")
def common_choices(spark, d):
    return stats.common_choices(events(spark, d), "event_type").withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {EV} SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t // 3600000000, event_id % 1000, event_id) AS position FROM ev")
def ordered_events(spark, d):
    rows = events(spark, d).withColumns({"hour": F.expr("t div 3600000000"), "ord": F.struct(F.col("event_id") % 1000, "event_id")})
    return stats.event_order(rows, ["user_id"], "hour", "ord")[0].select("user_id", "event_id", F.col("position").cast("bigint").alias("position"))


@query(f"WITH {EV}, a AS (SELECT user_id, value, NULL AS event_type FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT user_id, value, event_type FROM ev WHERE event_id % 3 = 0) SELECT user_id, count(*) AS n, count(event_type) AS typed, round(sum(value), 4) AS total FROM a GROUP BY 1")
def pooled_rows(spark, d):
    e = events(spark, d)
    rows = stats.pooled(e.where("event_id % 2 = 0").select("user_id", "value"), e.where("event_id % 3 = 0").select("user_id", "value", "event_type"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count("event_type").alias("typed"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {EV}, {IV}, {_PAIRS} SELECT recording_id, count(*) FILTER (line_id % 2 = 0 AND line_id % 3 = 0) AS retained, count(*) FILTER (line_id % 2 > 0 AND line_id % 3 = 0) AS recovered, count(*) FILTER (line_id % 2 = 0 AND line_id % 3 > 0) AS lost
    FROM pr WHERE line_id % 2 = 0 OR line_id % 3 = 0 GROUP BY 1""")
def compared_engines(spark, d):
    rows = _pairs(spark, d)
    return scores.engine_comparison(rows.where("line_id % 2 = 0"), rows.where("line_id % 3 = 0"))


@query(f"""WITH {EV}, {IV}, {_PAIRS}, d AS (SELECT recording_id, line_id, count(*) OVER (PARTITION BY recording_id, line_id) AS n FROM (SELECT recording_id, line_id FROM pr WHERE line_id % 4 = 0 UNION ALL SELECT recording_id, line_id FROM pr WHERE line_id % 12 = 0))
    SELECT recording_id, line_id, CASE WHEN line_id % 4 = 0 AND line_id % 12 > 0 THEN rb ELSE eb END AS effective, CASE WHEN line_id % 4 = 0 AND line_id % 12 > 0 THEN 'corrected' ELSE 'unreviewed' END AS review_state FROM pr""")
def applied_reviews(spark, d):
    rows = _pairs(spark, d)
    lines = rows.select("recording_id", "line_id", F.col("est_begin_us").alias("estimate"), F.lit("unreviewed").alias("review_state"))
    said = rows.select("recording_id", "line_id", F.lit("corrected").alias("action"), F.col("ref_begin_us").alias("interval"))
    decisions = said.where("line_id % 4 = 0").union(said.where("line_id % 12 = 0"))
    return scores.apply_reviews(lines, decisions)[0].select("recording_id", "line_id", "effective", "review_state")


@query(f"""WITH {EV}, s AS (SELECT user_id, max(t - 1704067200000000) AS dur FROM ev GROUP BY 1), w AS (SELECT user_id, dur, unnest(range(0, CAST(greatest(0, ceil((dur - 86400000000) / 43200000000)) AS BIGINT) + 1)) AS i FROM s),
    b AS (SELECT user_id, i, i * 43200000000 AS b, least(dur, i * 43200000000 + 86400000000) AS e FROM w), k AS (SELECT user_id, i, coalesce((lag(e) OVER o + b) // 2, b) AS kb, coalesce((e + lead(b) OVER o) // 2, e) AS ke FROM b WINDOW o AS (PARTITION BY user_id ORDER BY i))
    SELECT user_id, event_id, i AS "window" FROM (SELECT user_id, event_id, t - 1704067200000000 AS t FROM ev) JOIN k USING (user_id) WHERE t >= kb AND t < ke""")
def owned_events(spark, d):
    e = events(spark, d).withColumn("t", F.col("t") - 1_704_067_200_000_000)
    windows = schedule.analysis_windows(e.groupBy("user_id").agg(F.max("t").alias("dur")), "user_id", "dur", 86_400_000_000, 43_200_000_000)
    # Every event is seen by each window that holds it, and kept by the one that owns it.
    seen = iv.overlap_join(e.select("user_id", "event_id", F.col("t").alias("begin"), (F.col("t") + 1).alias("end")), windows.select("user_id", "window", "begin", (F.col("end") + 1).alias("end")), "user_id", 86_400_000_000)
    frames = seen.select("user_id", F.col("l_event_id").alias("event_id"), F.col("r_window").alias("window"), F.col("l_begin").alias("t"))
    return schedule.owned_frames(windows, frames, "user_id", "t").select("user_id", "event_id", F.col("window").cast("bigint").alias("window"))
