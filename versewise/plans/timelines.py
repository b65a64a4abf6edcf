"""Interval, alignment, schedule and series operators over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators import align, intervals as iv, schedule, series
from versewise.plans.registry import EV, HOUR, IV, MONTH, events, intervals, merged_sql, query, sweep_sql, table

_A, _B = "event_type IN ('view', 'click')", "event_type = 'purchase'"
_TWO = f"WITH {EV}, {IV}, a AS (SELECT * FROM iv WHERE {_A}), b AS (SELECT * FROM iv WHERE {_B})"


@query(f"""WITH {EV} SELECT user_id, min(t) AS "first", max(t) AS "last", count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM ev)) GROUP BY user_id, g""")
def activity_runs(spark, d):
    return iv.runs(events(spark, d), "user_id", "t", 6 * HOUR)


@query(f"""WITH {EV}, {IV}, {merged_sql("iv", "m")} SELECT user_id, count(*) AS n, CAST(sum("end" - "begin") // 1000000 AS BIGINT) AS seconds, avg(("end" - "begin") / 1000000.0)::DOUBLE AS mean_s,
    round(quantile_cont(("end" - "begin") / 1000000.0, 0.95), 4) AS p95_s FROM m GROUP BY user_id""".replace("avg((", "round(avg((").replace("::DOUBLE", "::DOUBLE, 4)"))
def activity_summary(spark, d):
    m = iv.merge_intervals(intervals(events(spark, d)), "user_id")
    size = (F.col("end") - F.col("begin")) / 1000000
    return m.groupBy("user_id").agg(F.count("*").alias("n"), F.expr("sum(end - begin) div 1000000").alias("seconds"), F.round(F.avg(size), 4).alias("mean_s"), F.round(F.percentile(size, 0.95), 4).alias("p95_s"))


@query(f'WITH {EV}, {IV}, {merged_sql("iv", "m")} SELECT * FROM m')
def merged_intervals(spark, d):
    return iv.merge_intervals(intervals(events(spark, d)), "user_id").select("user_id", "begin", "end")


@query(f'{_TWO}, {sweep_sql("a", "b", "x", "l > 0 AND r = 0")} SELECT * FROM x')
def interval_difference(spark, d):
    e = events(spark, d)
    return iv.difference(intervals(e, "view", "click"), intervals(e, "purchase"), "user_id")


@query(f'{_TWO}, {sweep_sql("a", "b", "x", "l > 0 AND r > 0")} SELECT * FROM x')
def interval_intersection(spark, d):
    e = events(spark, d)
    return iv.intersection(intervals(e, "view", "click"), intervals(e, "purchase"), "user_id")


@query(f"""{_TWO}, {sweep_sql("a", "b", "x", "l > 0 AND r > 0")}, {merged_sql("a", "ma")}, {merged_sql("b", "mb")},
    s AS (SELECT user_id, coalesce(sa, 0) AS activity, coalesce(sb, 0) AS estimated, coalesce(sx, 0) AS shared FROM
    (SELECT user_id, CAST(sum("end" - "begin") AS BIGINT) AS sa FROM ma GROUP BY 1) FULL JOIN (SELECT user_id, CAST(sum("end" - "begin") AS BIGINT) AS sb FROM mb GROUP BY 1) USING (user_id)
    LEFT JOIN (SELECT user_id, CAST(sum("end" - "begin") AS BIGINT) AS sx FROM x GROUP BY 1) USING (user_id))
    SELECT user_id, activity, estimated, shared, round(CASE WHEN activity > 0 THEN (activity - shared) / activity END, 6) AS uncovered, round(CASE WHEN estimated > 0 THEN (estimated - shared) / estimated END, 6) AS excess,
    round(greatest(CASE WHEN activity > 0 THEN (activity - shared) / activity END, CASE WHEN estimated > 0 THEN (estimated - shared) / estimated END), 6) AS score FROM s""")
def coverage_score(spark, d):
    e = events(spark, d)
    c = iv.coverage(intervals(e, "view", "click"), intervals(e, "purchase"), "user_id")
    return c.withColumns({n: F.round(n, 6) for n in ("uncovered", "excess", "score")})


@query(f"""WITH {EV}, {IV}, span AS (SELECT DISTINCT user_id, {MONTH[0]} AS "begin", {MONTH[1]} AS "end" FROM ev), {sweep_sql("span", "iv", "x", "l > 0 AND r = 0")} SELECT * FROM x WHERE "end" - "begin" >= {HOUR}""")
def unassigned_gaps(spark, d):
    e = events(spark, d)
    spans = e.select("user_id").distinct().select("user_id", F.lit(MONTH[0]).alias("begin"), F.lit(MONTH[1]).alias("end"))
    return iv.complement(intervals(e), "user_id", spans).where(F.col("end") - F.col("begin") >= HOUR)


@query(f"""WITH {EV}, {IV}, g AS (SELECT user_id, coalesce(max("end") OVER (PARTITION BY user_id ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {MONTH[0]}) AS gap_begin, "begin" AS gap_end FROM iv)
    SELECT * FROM g WHERE gap_end - gap_begin >= {4 * HOUR}""")
def instrumental_gaps(spark, d):
    return iv.gaps(intervals(events(spark, d)), "user_id", 4 * HOUR, MONTH[0])


@query(f"""WITH {EV}, u AS (SELECT user_id, t, event_id, value, 0 AS side, event_id AS tie FROM ev WHERE event_type = 'click' UNION ALL SELECT user_id, t, event_id, NULL, 1, NULL FROM ev WHERE event_type = 'purchase')
    SELECT user_id, t, event_id, c_id, c_value FROM (SELECT user_id, t, event_id, side,
    last_value(CASE WHEN side = 0 THEN event_id END IGNORE NULLS) OVER w AS c_id, last_value(CASE WHEN side = 0 THEN value END IGNORE NULLS) OVER w AS c_value FROM u
    WINDOW w AS (PARTITION BY user_id ORDER BY t, side, tie ROWS UNBOUNDED PRECEDING)) WHERE side = 1""")
def asof_focus(spark, d):
    e = events(spark, d)
    clicks = e.where("event_type = 'click'").select("user_id", "t", F.col("event_id").alias("c_id"), F.col("value").alias("c_value"))
    return iv.asof_join(e.where("event_type = 'purchase'").select("user_id", "t", "event_id"), clicks, "user_id", "t", ["c_id", "c_value"], ties=["c_id"])


@query(f"""WITH {EV}, u AS (SELECT user_id, t, event_id, 0 AS side, event_id AS tie FROM ev WHERE event_type = 'click' UNION ALL SELECT user_id, t, event_id, 1, NULL FROM ev WHERE event_type = 'view'),
    j AS (SELECT user_id, t, event_id, side, last_value(CASE WHEN side = 0 THEN event_id END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN side = 0 THEN t END IGNORE NULLS) OVER w AS o FROM u
    WINDOW w AS (PARTITION BY user_id ORDER BY t, side, tie ROWS UNBOUNDED PRECEDING))
    SELECT user_id, t, event_id, o // 2 + CASE WHEN c % 2 = 0 THEN t - o ELSE 0 END AS media_us FROM j WHERE side = 1""")
def media_clock(spark, d):
    e = events(spark, d)
    clock = e.where("event_type = 'click'").select("user_id", "t", F.col("t").alias("output"), F.expr("t div 2").alias("media"), (F.col("event_id") % 2 == 0).alias("running"), F.col("event_id").alias("c"))
    rows = iv.asof_join(e.where("event_type = 'view'").select("user_id", "t", "event_id"), clock, "user_id", "t", ["output", "media", "running"], ties=["c"])
    return rows.select("user_id", "t", "event_id", iv.media_time(F.col("t"), F.col("output"), F.col("media"), F.col("running")).alias("media_us"))


@query(f"""WITH {EV}, {IV}, {merged_sql("iv", "m", "event_type = 'view'")} SELECT e.user_id, e.event_id, e.t, m."begin", m."end" FROM ev e JOIN m ON e.user_id = m.user_id AND m."begin" <= e.t AND e.t < m."end" WHERE e.event_type = 'error'""")
def point_in_interval(spark, d):
    e = events(spark, d)
    m = iv.merge_intervals(intervals(e, "view"), "user_id")
    return iv.points_in_intervals(e.where("event_type = 'error'").select("user_id", "event_id", "t"), m, "user_id", HOUR).select("user_id", "event_id", "t", "begin", "end")


_NEAR = f"""WITH {EV}, p AS (SELECT a.user_id, a.event_id AS l_id, a.t AS l_t, b.event_id AS r_id, b.t AS r_t FROM ev a JOIN ev b ON a.user_id = b.user_id AND abs(a.t - b.t) <= {2 * HOUR} WHERE a.event_type = 'purchase' AND b.event_type = 'view'),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY abs(l_t - r_t), r_t, r_id) AS i, row_number() OVER (PARTITION BY r_id ORDER BY abs(l_t - r_t), l_t, l_id) AS j FROM p)"""


@query(f"{_NEAR} SELECT user_id, l_id, l_t, r_id, r_t FROM k WHERE i = 1")
def nearest_event(spark, d):
    e = events(spark, d).withColumnRenamed("event_id", "id")
    return iv.nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", 2 * HOUR)


@query(f"{_NEAR} SELECT user_id, l_id, l_t, r_id, r_t FROM k WHERE i = 1 AND j = 1")
def nearest_mutual(spark, d):
    e = events(spark, d).withColumnRenamed("event_id", "id")
    return iv.nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", 2 * HOUR, mutual=True)


@query(f"""{_NEAR.replace("WITH", "WITH RECURSIVE", 1)}, lf AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY l_t, l_id) AS i FROM (SELECT user_id, l_id, l_t, list(r_id ORDER BY abs(l_t - r_t), r_t, r_id) AS near FROM p GROUP BY ALL)),
    g AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM lf
    UNION ALL SELECT user_id, i, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick FROM (SELECT lf.user_id, lf.i, used, list_filter(near, lambda r: NOT list_contains(used, r))[1] AS pick FROM g JOIN lf ON lf.user_id = g.user_id AND lf.i = g.i + 1))
    SELECT p.* FROM g JOIN lf USING (user_id, i) JOIN p ON p.user_id = g.user_id AND p.l_id = lf.l_id AND p.r_id = g.pick""")
def nearest_greedy(spark, d):
    e = events(spark, d).withColumnRenamed("event_id", "id")
    return iv.greedy_nearest(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), "user_id", 2 * HOUR)


@query(f"""{_TWO} SELECT a.user_id, a.event_id AS l_event_id, b.event_id AS r_event_id, least(a."end", b."end") - greatest(a."begin", b."begin") AS shared FROM a JOIN b ON a.user_id = b.user_id AND least(a."end", b."end") > greatest(a."begin", b."begin")""")
def overlap_pairs(spark, d):
    e = events(spark, d)
    p = iv.overlap_join(intervals(e, "view", "click"), intervals(e, "purchase"), "user_id", HOUR)
    return p.select("user_id", "l_event_id", "r_event_id", (F.least("l_end", "r_end") - F.greatest("l_begin", "r_begin")).alias("shared"))


@query(f"""WITH {EV}, {IV} SELECT user_id, event_id, event_type FROM iv a WHERE EXISTS (SELECT 1 FROM iv b WHERE a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND least(a."end", b."end") > greatest(a."begin", b."begin"))""")
def wrong_repeat(spark, d):
    rows = intervals(events(spark, d))
    pairs = iv.overlap_join(rows, rows, ["user_id", "event_type"], HOUR, F.col("l_event_id") < F.col("r_event_id"))
    return pairs.select("user_id", "event_type", F.explode(F.array("l_event_id", "r_event_id")).alias("event_id")).distinct()


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_discount) AS line FROM lineitem),
    b AS (SELECT l_orderkey, line, l_discount, l_extendedprice / l_quantity AS rate, l_discount <= 0.06 AND l_quantity >= 5 AS base FROM o),
    n AS (SELECT *, coalesce(lag(base) OVER w, false) AS p, coalesce(lead(base) OVER w, false) AS q FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY line))
    SELECT l_orderkey, line, base, base OR (rate <= 1500 AND ((p AND q) OR ((p OR q) AND l_discount >= 0.08))) AS accepted FROM n""")
def neighbour_acceptance(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).cast("bigint").alias("line"), "l_discount", (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate"), ((F.col("l_discount") <= 0.06) & (F.col("l_quantity") >= 5)).alias("base"))
    return align.neighbour_acceptance(rows, "l_orderkey", "line", "base", "rate", "l_discount", 1500, 0.08).select("l_orderkey", "line", "base", "accepted")


#: Users' events as lines: those of small value have no estimate, the others one of a tenth of the way to the next.
_EST = f"""WITH {EV}, o AS (SELECT user_id, event_id, value, t - {MONTH[0]} AS t0, lead(t) OVER w - {MONTH[0]} AS t1, row_number() OVER w AS line FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    est AS (SELECT user_id, line, CASE WHEN value >= 20 AND t1 > t0 + 10 THEN t0 END AS b, CASE WHEN value >= 20 AND t1 > t0 + 10 THEN t0 + (t1 - t0) // 10 END AS e, {MONTH[1] - MONTH[0]} AS duration FROM o)"""
_FILL = _EST + """, f1 AS (SELECT *, count(b) OVER (w ROWS UNBOUNDED PRECEDING) AS run, last_value(e IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, first_value(b IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM est WINDOW w AS (PARTITION BY user_id ORDER BY line)),
    f2 AS (SELECT *, count(*) OVER (PARTITION BY user_id, run, b IS NULL) AS n, row_number() OVER (PARTITION BY user_id, run, b IS NULL ORDER BY line) - 1 AS k, coalesce(nxt, duration) AS stop FROM f1),
    f3 AS (SELECT *, coalesce(prev, greatest(0, stop - n * 2500000)) AS a FROM f2),
    f4 AS (SELECT *, CASE WHEN nxt IS NULL THEN least(stop, a + n * 2500000) ELSE stop END AS z FROM f3),
    fill AS (SELECT user_id, line, b, e, duration, run, CASE WHEN b IS NULL THEN a + k * ((z - a) // n) + 1 END AS fill_begin, CASE WHEN b IS NULL THEN a + (k + 1) * ((z - a) // n) END AS fill_end FROM f4)"""


def _estimates(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    o = events(spark, d).select("user_id", "value", (F.col("t") - MONTH[0]).alias("t0"), (F.lead("t").over(w) - MONTH[0]).alias("t1"), F.row_number().over(w).cast("bigint").alias("line"))
    known = (F.col("value") >= 20) & (F.col("t1") > F.col("t0") + 10)
    return o.select("user_id", "line", F.when(known, F.col("t0")).alias("b"), F.when(known, F.expr("t0 + (t1 - t0) div 10")).alias("e"), F.lit(MONTH[1] - MONTH[0]).alias("duration"))


@query(_FILL + " SELECT user_id, line, b, e, fill_begin, fill_end FROM fill")
def fill_unresolved(spark, d):
    return align.fill_unresolved(_estimates(spark, d), "user_id", "line", "b", "e", "duration").select("user_id", "line", "b", "e", "fill_begin", "fill_end")


_COMP = f"""comp AS (SELECT user_id, min(t) - {MONTH[0]} AS cb, max(t) - {MONTH[0]} + 60000000 AS ce FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM ev WHERE value < 20)) GROUP BY user_id, g)"""


@query(_FILL + f""", {_COMP}, tot AS (SELECT user_id, count(b) AS al FROM est GROUP BY 1),
    edge AS (SELECT user_id, run, al, min(fill_begin) AS f, max(fill_end) AS l, max(duration) AS d FROM fill JOIN tot USING (user_id) WHERE b IS NULL AND al > 0 AND (run = 0 OR run = al) GROUP BY 1, 2, 3),
    lim AS (SELECT user_id, arg_min(b, line) AS lo, arg_max(e, line) AS hi FROM est WHERE b IS NOT NULL GROUP BY 1),
    e2 AS (SELECT edge.*, CASE WHEN run = 0 THEN 0 ELSE hi END AS lower_, CASE WHEN run = 0 THEN lo ELSE d END AS upper_ FROM edge JOIN lim USING (user_id)),
    ch AS (SELECT e2.user_id, run, f, l, CASE WHEN run = 0 THEN arg_max(cb, cb) ELSE arg_min(cb, cb) END AS cb, CASE WHEN run = 0 THEN arg_max(ce, cb) ELSE arg_min(ce, cb) END AS ce FROM e2 JOIN comp ON e2.user_id = comp.user_id AND cb >= lower_ AND ce <= upper_ GROUP BY 1, 2, 3, 4),
    mv AS (SELECT user_id, run, cb + 1 - f AS shift FROM ch WHERE l > f AND ce - cb >= l - f + 1 AND NOT (cb <= f AND l <= ce) AND NOT EXISTS (SELECT 1 FROM est x WHERE x.user_id = ch.user_id AND x.b IS NOT NULL AND greatest(ch.cb, x.b) < least(ch.ce, x.e)))
    SELECT fill.user_id, line, fill_begin + coalesce(shift, 0) AS fill_begin, fill_end + coalesce(shift, 0) AS fill_end, coalesce(shift, 0) AS shift FROM fill LEFT JOIN mv ON fill.user_id = mv.user_id AND fill.run = mv.run WHERE b IS NULL""")
def boundary_relocation(spark, d):
    rows = align.fill_unresolved(_estimates(spark, d), "user_id", "line", "b", "e", "duration")
    comp = iv.runs(events(spark, d).where("value < 20"), "user_id", "t", 6 * HOUR).select("user_id", (F.col("first") - MONTH[0]).alias("begin"), (F.col("last") - MONTH[0] + 60000000).alias("end"))
    out = align.relocate_boundary_runs(rows, comp, "user_id", "line", "b", "e", "duration")
    return out.where("b is null").select("user_id", "line", "fill_begin", "fill_end", "shift")


@query(_EST + " SELECT user_id, line, b, first_value(b IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM est")
def next_non_null(spark, d):
    return align.next_begin(_estimates(spark, d), "user_id", "line", "b").select("user_id", "line", "b", "following")


@query(f"""WITH {EV}, {IV}, r AS (SELECT *, "end" - "begin" >= 600000000 AS accepted FROM iv), w AS (SELECT *, coalesce("begin" < lag("end") OVER x, false) OR coalesce(lead("begin") OVER x < "end", false) AS clash FROM r WINDOW x AS (PARTITION BY user_id, accepted ORDER BY event_id))
    SELECT user_id, event_id, accepted, accepted AND clash AS overlap_rejected FROM w""")
def reject_overlaps(spark, d):
    rows = intervals(events(spark, d)).withColumn("accepted", F.col("end") - F.col("begin") >= 600000000)
    return align.reject_overlaps(rows, "user_id", "event_id", "accepted", "begin", "end").select("user_id", "event_id", "accepted", "overlap_rejected")


@query(f"""WITH {EV}, s AS (SELECT user_id, event_id, t - {MONTH[0]} AS o, t - {MONTH[0]} - coalesce(lag(t) OVER w - {MONTH[0]}, 0) AS step FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT user_id, event_id, max(o - least({HOUR}, step // 2)) OVER (PARTITION BY user_id ORDER BY o, event_id ROWS UNBOUNDED PRECEDING) AS focus_at FROM s""")
def focus_schedule(spark, d):
    rows = events(spark, d).select("user_id", "event_id", (F.col("t") - MONTH[0]).alias("o"))
    return schedule.focus_schedule(rows, "user_id", "o", HOUR, ("event_id",)).select("user_id", "event_id", "focus_at")


@query(f"WITH {EV} SELECT user_id, event_id, least(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), {MONTH[1]}), {MONTH[1]}) AS departs_at FROM ev")
def departures(spark, d):
    return schedule.departures(events(spark, d), "user_id", "t", "event_id", F.lit(MONTH[1])).select("user_id", "event_id", "departs_at")


@query(f"""WITH {EV} SELECT user_id, event_id, coalesce(CASE WHEN value >= 50 THEN t + 60000000 END, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), {MONTH[1]}) AS until FROM ev""")
def implicit_ends(spark, d):
    rows = events(spark, d).withColumn("stop", F.when(F.col("value") >= 50, F.col("t") + 60000000))
    return schedule.implicit_ends(rows, "user_id", "t", "stop", F.lit(MONTH[1]), ("event_id",)).select("user_id", "event_id", "until")


@query(f"""WITH {EV}, u AS (SELECT user_id, {MONTH[1] - MONTH[0]} AS duration FROM ev GROUP BY 1), w AS (SELECT user_id, unnest(range(0, CAST(ceil((duration - {30 * HOUR}) / {26 * HOUR}.0) AS BIGINT) + 1)) AS i, duration FROM u),
    x AS (SELECT user_id, i AS "window", i * {26 * HOUR} AS b, least(duration, i * {26 * HOUR} + {30 * HOUR}) AS e FROM w),
    k AS (SELECT user_id, "window", b, e, coalesce((lag(e) OVER q + b) // 2, b) AS kb, coalesce((e + lead(b) OVER q) // 2, e) AS ke FROM x WINDOW q AS (PARTITION BY user_id ORDER BY "window"))
    SELECT k.user_id, CAST("window" AS BIGINT) AS "window", count(event_id) AS n FROM k JOIN ev ON k.user_id = ev.user_id AND ev.t - {MONTH[0]} >= kb AND ev.t - {MONTH[0]} < ke GROUP BY 1, 2""")
def hop_windows_owned(spark, d):
    e = events(spark, d).select("user_id", "event_id", (F.col("t") - MONTH[0]).alias("o"))
    spans = e.select("user_id").distinct().withColumn("duration", F.lit(MONTH[1] - MONTH[0]))
    w = schedule.analysis_windows(spans, "user_id", "duration", 30 * HOUR, 26 * HOUR)
    last = F.floor(F.col("o") / (26 * HOUR))
    inside = e.withColumn("window", F.explode(F.array((last - 1).cast("int"), last.cast("int"))))
    return schedule.owned_frames(w, inside, "user_id", "o").groupBy("user_id", F.col("window").cast("bigint").alias("window")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM ev) SELECT user_id, event_id, event_type FROM p WHERE (b IS NULL OR b <> event_type) AND event_type <> 'error'")
def collapse_repeats(spark, d):
    return series.collapse_repeats(events(spark, d), "user_id", "event_id", "event_type", "error").select("user_id", "event_id", "event_type")


@query(f"""WITH {EV}, i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM ev)
    SELECT a.user_id, a.event_id, list_sort(list(b.value))[4] AS filtered FROM i a CROSS JOIN (SELECT unnest(range(-3, 4)) AS o) JOIN i b ON b.user_id = a.user_id AND b.k = least(a.n, greatest(1, a.k + o)) GROUP BY 1, 2""")
def rank_filter(spark, d):
    return series.rank_filter(events(spark, d), "user_id", "event_id", "value", 3, 3, 4).select("user_id", "event_id", "filtered")


_DAY = f"dy AS (SELECT event_type, (t - {MONTH[0]}) // {24 * HOUR} AS day, count(*) AS n, round(sum(value), 4) AS v FROM ev GROUP BY 1, 2)"


def _daily(spark, d):
    day = F.expr(f"(t - {MONTH[0]}) div {24 * HOUR}")
    return events(spark, d).groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))


@query(f"""WITH {EV}, {_DAY}, c AS (SELECT *, avg(n) OVER (PARTITION BY event_type) AS m FROM dy), x AS (SELECT event_type, day AS t1, n - m AS v1, lag(day) OVER w AS t0, lag(n - m) OVER w AS v0 FROM c WINDOW w AS (PARTITION BY event_type ORDER BY day))
    SELECT event_type, arg_min(t0, t1) AS t0, min(t1) AS t1, round(arg_min(t0 + (0 - v0) / (v1 - v0) * (t1 - t0), t1), 6) AS crossing FROM x WHERE v0 < 0 AND v1 >= 0 GROUP BY 1""")
def crossings(spark, d):
    rows = _daily(spark, d).withColumn("c", F.col("n") - F.avg("n").over(Window.partitionBy("event_type")))
    return series.crossings(rows, "event_type", "day", "c", 0.0).select("event_type", "t0", "t1", F.round("crossing", 6).alias("crossing"))


@query(f"""WITH {EV}, {_DAY}, o AS (SELECT event_type, day, CASE WHEN day - lag(day) OVER (PARTITION BY event_type ORDER BY day) - 1 > 1 THEN 1 ELSE 0 END AS new FROM (SELECT *, avg(n) OVER (PARTITION BY event_type) AS m FROM dy) WHERE n >= m)
    SELECT event_type, min(day) AS "first", max(day) AS "last" FROM (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM o) GROUP BY event_type, g HAVING max(day) - min(day) + 1 >= 2""")
def short_run_bridging(spark, d):
    rows = _daily(spark, d).withColumn("on", F.col("n") >= F.avg("n").over(Window.partitionBy("event_type")))
    return series.bridge_runs(rows, "event_type", "day", "on", 1, 2)


@query(f"""WITH {EV}, {_DAY}, s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER (PARTITION BY event_type) AS a FROM dy)
    SELECT event_type, CAST(max(a) AS BIGINT) AS whole, min(CASE WHEN c >= 0.5 * a THEN day END) AS t50, min(CASE WHEN c >= 0.9 * a THEN day END) AS t90 FROM s GROUP BY 1""")
def displacement_quantiles(spark, d):
    return series.displacement_quantiles(_daily(spark, d), "event_type", "day", "n")


@query(f"""WITH {EV}, {_DAY}, w AS (SELECT *, max(n) OVER q AS hi, min(n) OVER q AS lo FROM dy WINDOW q AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT event_type, day, n FROM w WHERE n = hi AND n - lo >= 5""")
def peaks(spark, d):
    return series.peaks(_daily(spark, d), "event_type", "day", "n", 2, 5).select("event_type", "day", "n")


@query(f"""WITH {EV}, h AS (SELECT event_type, (t - {MONTH[0]}) // {HOUR} AS h, count(*) AS n FROM ev GROUP BY 1, 2), z AS (SELECT *, n - avg(n) OVER (PARTITION BY event_type) AS z FROM h), l AS (SELECT *, lag(z, 24) OVER (PARTITION BY event_type ORDER BY h) AS zl FROM z)
    SELECT event_type, count(*) AS n, round(sum(z * zl) / sum(z * z), 6) AS r FROM l GROUP BY 1""")
def autocorrelation(spark, d):
    rows = events(spark, d).groupBy("event_type", F.expr(f"(t - {MONTH[0]}) div {HOUR}").alias("h")).agg(F.count("*").alias("n"))
    return series.autocorrelation(rows.withColumnRenamed("n", "v"), "event_type", "h", "v", 24).withColumn("r", F.round("r", 6))


@query(f"""WITH {EV}, s AS (SELECT user_id, t // {HOUR} - lag(t // {HOUR}) OVER (PARTITION BY user_id ORDER BY t, event_id) AS step FROM ev) SELECT user_id, step, count(*) AS n FROM s WHERE step IS NOT NULL GROUP BY 1, 2""")
def interval_histogram(spark, d):
    return series.interval_histogram(events(spark, d).select("user_id", F.expr(f"t div {HOUR}").alias("hour")), "user_id", "hour")


@query("""WITH e AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings),
    s AS (SELECT vec_id, o, (SELECT avg(abs(CAST(a[i + 1] AS FLOAT) - CAST(b[i - o + 1] AS FLOAT))::DOUBLE) FROM (SELECT unnest(range(greatest(0, o), least(len(a), len(a) + o))) AS i)) AS mad FROM e CROSS JOIN (SELECT unnest(range(-3, 4)) AS o) WHERE b IS NOT NULL)
    SELECT vec_id, CAST(arg_min(o, (round(mad, 9), abs(o), o)) AS BIGINT) AS shift FROM s GROUP BY 1""")
def best_shift(spark, d):
    # Neighbours by id: the next id is one more, so a self-join needs no order over the whole table.
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return series.best_shift(pairs, "a", "b", 3).select("vec_id", F.col("shift").cast("bigint").alias("shift"))


@query("""WITH p AS (SELECT vec_id, i, embedding[i] > 0 AS s FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), l AS (SELECT vec_id, i FROM p WHERE s), r AS (SELECT vec_id - 1 AS vec_id, i FROM p WHERE s),
    m AS (SELECT l.vec_id, o AS shift, count(*) AS both_ FROM l CROSS JOIN (SELECT unnest(range(-2, 3)) AS o) JOIN r ON l.vec_id = r.vec_id AND l.i + o = r.i GROUP BY 1, 2),
    u AS (SELECT m.vec_id, shift, both_ / (nl + nr - both_) AS iou FROM m JOIN (SELECT vec_id, count(*) AS nl FROM l GROUP BY 1) USING (vec_id) JOIN (SELECT vec_id, count(*) AS nr FROM r GROUP BY 1) USING (vec_id))
    SELECT vec_id, CAST(arg_min(shift, (-iou, abs(shift), shift)) AS BIGINT) AS shift, round(max(iou), 6) AS iou FROM u GROUP BY 1""")
def shifted_overlap(spark, d):
    on = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where("v > 0").select("vec_id", "i")
    out = series.shifted_overlap(on, on.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], "i", 2)
    return out.select("vec_id", F.col("shift").cast("bigint").alias("shift"), F.round("iou", 6).alias("iou"))


@query(f"""WITH {EV}, g AS (SELECT user_id, unnest(range({MONTH[0]}, {MONTH[1]} + 1, {HOUR})) AS t FROM (SELECT DISTINCT user_id FROM ev)),
    u AS (SELECT user_id, t, 1 AS side, NULL AS event_id, NULL AS value, NULL AS tie FROM g UNION ALL SELECT user_id, t, 0, event_id, value, event_id FROM ev),
    j AS (SELECT user_id, t, side, last_value(CASE WHEN side = 0 THEN t END IGNORE NULLS) OVER w AS entry_t, last_value(event_id IGNORE NULLS) OVER w AS event_id FROM u WINDOW w AS (PARTITION BY user_id ORDER BY t, side, tie ROWS UNBOUNDED PRECEDING))
    SELECT user_id, t, CASE WHEN t < entry_t + {12 * HOUR} THEN event_id END AS event_id, round(CASE WHEN t < entry_t + {12 * HOUR} THEN (least(1, (t - entry_t) / {HOUR}.0) ** 2) * (3 - 2 * least(1, (t - entry_t) / {HOUR}.0)) END, 6) AS eased FROM j WHERE side = 1""")
def focus_grid(spark, d):
    from versewise.functions.times import smoothstep

    e = events(spark, d).withColumn("stop", F.col("t") + 12 * HOUR)
    spans = e.select("user_id").distinct().select("user_id", F.lit(MONTH[0]).alias("begin"), F.lit(MONTH[1]).alias("end"))
    rows = schedule.sample_grid(e.select("user_id", "t", "event_id", "stop", F.col("event_id").alias("tie")), spans, "user_id", HOUR, "t", ["event_id", "stop"], "stop", ("tie",))
    return rows.select("user_id", "t", "event_id", F.round(smoothstep((F.col("t") - F.col("entry_t")) / HOUR), 6).alias("eased"))


@query(f"""WITH {EV}, {IV}, o AS (SELECT *, lag("begin") OVER w AS lb, max("end") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up FROM iv WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT CAST(user_id AS VARCHAR) AS recording_id, CAST(event_id AS VARCHAR) AS "row", rule_id FROM (SELECT user_id, event_id, unnest([CASE WHEN "begin" >= "end" THEN 'empty_interval' END, CASE WHEN "begin" < 0 OR "end" > {MONTH[1]} THEN 'out_of_bounds' END, CASE WHEN "begin" < lb THEN 'not_monotonic' END, CASE WHEN "begin" < up THEN 'overlap' END]) AS rule_id FROM o) WHERE rule_id IS NOT NULL""")
def violations(spark, d):
    from versewise.operators.quality import timed_line_violations

    rows = intervals(events(spark, d)).withColumn("duration", F.lit(MONTH[1]))
    return timed_line_violations(rows, "user_id", "event_id", "begin", "end", "duration").withColumn("recording_id", F.col("recording_id").cast("string"))


@query(f"""WITH {EV}, {IV}, o AS (SELECT user_id, event_id, "begin", "end", CAST(("begin" // {24 * HOUR} + 1) * {24 * HOUR} AS BIGINT) AS deadline, "begin" // {24 * HOUR} AS day, row_number() OVER (PARTITION BY user_id, "begin" // {24 * HOUR} ORDER BY "begin", event_id) AS i FROM iv),
    s AS (SELECT *, least(min(CASE WHEN "end" > deadline THEN i END) OVER w, coalesce(max(CASE WHEN "begin" < deadline THEN i END) OVER w, min(CASE WHEN "end" > deadline THEN i END) OVER w)) AS s FROM o WINDOW w AS (PARTITION BY user_id, day)),
    n AS (SELECT *, sum(CASE WHEN i >= s THEN 1 ELSE 0 END) OVER w AS n, min(CASE WHEN i >= s THEN "begin" END) OVER w AS f FROM s WINDOW w AS (PARTITION BY user_id, day))
    SELECT user_id, event_id, CASE WHEN i >= s THEN f + CAST(((deadline - f) * (i - s)) // n AS BIGINT) ELSE "begin" END AS new_begin, CASE WHEN i >= s THEN f + CAST(((deadline - f) * (i - s + 1)) // n AS BIGINT) ELSE "end" END AS new_end FROM n""")
def deadline_compression(spark, d):
    day = F.expr(f"begin div {24 * HOUR}")
    rows = intervals(events(spark, d)).withColumn("day", day).withColumn("deadline", (F.col("day") + 1) * 24 * HOUR)
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("user_id", "day").orderBy("begin", "event_id")))
    return schedule.compress_to_deadline(rows, ["user_id", "day"], "i", "begin", "end", "deadline").select("user_id", "event_id", "new_begin", "new_end")


@query(f"""WITH RECURSIVE {EV}, s AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, value) AS i FROM ev),
    g AS (SELECT user_id, i, t AS first, t AS last, value AS lo, value AS hi, CAST(1 AS BIGINT) AS n FROM s WHERE i = 1
    UNION ALL SELECT user_id, i, CASE WHEN new THEN t ELSE first END, t, CASE WHEN new THEN value ELSE least(lo, value) END, CASE WHEN new THEN value ELSE greatest(hi, value) END, CASE WHEN new THEN 1 ELSE n + 1 END
    FROM (SELECT s.user_id, s.i, s.t, s.value, first, lo, hi, n, greatest(hi, value) - least(lo, value) > 40.0 OR s.t - last > {24 * HOUR} AS new FROM g JOIN s ON s.user_id = g.user_id AND s.i = g.i + 1))
    SELECT user_id, first, last, n FROM (SELECT *, lead(n) OVER (PARTITION BY user_id ORDER BY i) AS more FROM g) WHERE coalesce(more, 1) = 1 AND last - first >= {HOUR}""")
def stable_runs(spark, d):
    rows = events(spark, d).select("user_id", "t", "value")
    return series.stable_intervals(rows, "user_id", "t", "value", 40.0, HOUR, 24 * HOUR)
