"""Streams (J1, J2, J4, J5) and daily observations (A19, J3) over events that arrive late, against batch SQL.

An event arrives ``value`` hours after its time, in files of ten days. The SQL follows the steps: ``top`` is the watermark that
the files before a step have set.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from versewise.plans.registry import EV, HOUR, MONTH, events, query
from versewise.sources import sinks
from versewise.streaming import replay as rp, streams

_DAY, _STEP, _STEPS = 24 * HOUR, 240 * HOUR, 6
_LATE = 36
_ARRIVED = f"{EV}, ar AS (SELECT *, CAST((t + CAST(floor(value * {HOUR}) AS BIGINT) - {MONTH[0]}) // {_STEP} AS INTEGER) AS step FROM ev)"
#: Milliseconds, as the watermark has; none before the first step.
_TOPS = f"tops AS (SELECT s AS step, (SELECT max(t) // 1000 - {_LATE * 3600000} FROM ar WHERE ar.step < s) AS top FROM range(0, {_STEPS + 1}) AS r(s))"


def _arriving(spark, d):
    e = events(spark, d)
    step = F.floor((F.col("t") + F.floor(F.col("value") * HOUR) - MONTH[0]) / _STEP).cast("int")
    return e.select("*", F.timestamp_micros("t").alias("ts"), step.alias("step"))


@query(f"""WITH {_ARRIVED}, {_TOPS},
    w AS (SELECT event_type, b, value FROM (SELECT ar.*, top, unnest([t // {_DAY} * {_DAY}, t // {_DAY} * {_DAY} - {_DAY}]) AS b FROM ar JOIN tops USING (step)) WHERE top IS NULL OR b + {2 * _DAY} > top * 1000)
    SELECT event_type, b AS "begin", b + {2 * _DAY} AS "end", count(*) AS n, round(sum(value), 3) AS total FROM w WHERE b + {2 * _DAY} <= (SELECT max(top) * 1000 FROM tops) GROUP BY event_type, b""")
def streamed_windows(spark, d):
    """Two-day windows, one a day (J1): a window is written once the watermark has passed it, rows later than that are not in it."""
    build = lambda rows: streams.hopping_counts(rows, "ts", "event_type", "2 days", "1 day", f"{_LATE} hours")
    out = rp.replayed(_arriving(spark, d), "step", "windows", build)
    return out.select("event_type", F.unix_micros("begin").alias("begin"), F.unix_micros("end").alias("end"), "n", F.round("total", 3).alias("total"))


def _sessions_sql(gap: int) -> str:
    """Sessions step by step: those still open meet the rows that are not late; what the next watermark has passed is written."""
    parts, done = [], []
    for s in range(_STEPS + 1):
        new = f"SELECT user_id, t AS b, t + {gap} AS e, 1 AS n FROM ar JOIN tops USING (step) WHERE step = {s} AND (top IS NULL OR t + {gap} > top * 1000)"
        parts.append(f"i{s} AS ({new}{f' UNION ALL SELECT * FROM o{s - 1}' if s else ''})")
        parts.append(f"m{s} AS (SELECT user_id, min(b) AS b, max(e) AS e, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY user_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i{s})) GROUP BY user_id, g)")
        passed = f"e <= coalesce((SELECT max(top) * 1000 FROM tops WHERE step <= {s + 1}), 0)" if s < _STEPS else "e <= (SELECT max(top) * 1000 FROM tops)"
        parts.append(f"o{s} AS (SELECT * FROM m{s} WHERE NOT {passed})")
        done.append(f"SELECT * FROM m{s} WHERE {passed}")
    return f'WITH {_ARRIVED}, {_TOPS}, {", ".join(parts)} SELECT user_id, b AS "begin", e AS "end", n FROM ({" UNION ALL ".join(done)})'


@query(_sessions_sql(6 * HOUR))
def streamed_sessions(spark, d):
    """Activity runs that a gap of six hours closes (J2), written once the watermark has passed their end."""
    out = rp.replayed(_arriving(spark, d), "step", "sessions", lambda rows: streams.session_runs(rows, "ts", "user_id", "6 hours", f"{_LATE} hours"))
    return out.select("user_id", F.unix_micros("begin").alias("begin"), F.unix_micros("end").alias("end"), "n")


def _focus_sql(hold: int) -> str:
    """The focus of each user step by step: (t, what) held, and when it expires, in milliseconds."""
    parts, done = ["h0 AS (SELECT CAST(NULL AS BIGINT) AS user_id, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS what, CAST(NULL AS BIGINT) AS wake WHERE false)"], []
    for s in range(_STEPS + 1):
        parts.append(f"n{s} AS (SELECT ar.user_id, ar.t, event_type AS what, h.t AS held, h.what AS held_what, coalesce(top, 0) AS top FROM ar JOIN tops USING (step) LEFT JOIN h{s} h USING (user_id) WHERE step = {s} AND (top IS NULL OR ar.t > top * 1000))")
        done.append(f"SELECT user_id, t, what, 'focused' AS state FROM n{s} WHERE held IS NULL OR t >= held")
        parts.append(f"k{s} AS (SELECT user_id, m['t'] AS t, m['what'] AS what, greatest(m['t'] // 1000 + {hold * 1000}, top + 1) AS wake FROM (SELECT user_id, max(top) AS top, greatest(max({{'t': t, 'what': what}}), coalesce(max({{'t': held, 'what': held_what}}) FILTER (held IS NOT NULL), {{'t': CAST(0 AS BIGINT), 'what': ''}})) AS m FROM n{s} GROUP BY user_id) UNION ALL SELECT * FROM h{s} WHERE user_id NOT IN (SELECT user_id FROM n{s}))")
        wm = f"(SELECT max(top) FROM tops WHERE step <= {s + 1})"
        done.append(f"SELECT user_id, t, what, 'expired' FROM k{s} WHERE wake < {wm}")
        parts.append(f"h{s + 1} AS (SELECT * FROM k{s} WHERE NOT wake < {wm})")
    return f"WITH {_ARRIVED}, {_TOPS}, {', '.join(parts)} SELECT user_id, t, what, state FROM ({' UNION ALL '.join(done)})"


@query(_focus_sql(172800))
def streamed_focus(spark, d):
    """The last event of each user, for two days unless a later one comes (J4): state by key that expires in event time."""
    out = rp.replayed(_arriving(spark, d), "step", "focus", lambda rows: streams.live_focus(rows, "user_id", "ts", "event_type", 172800, f"{_LATE} hours"))
    return out.select(F.col("key").alias("user_id"), F.unix_micros("at").alias("t"), F.col("text").alias("what"), "state")


@query(f"""WITH {_ARRIVED}, {_TOPS} SELECT event_id, user_id, t, CASE WHEN t < (top + {_LATE * 3600000}) * 1000 + (SELECT coalesce(max(t) % 1000, 0) FROM ar b WHERE b.step < ar.step) - {_LATE * HOUR} THEN 'late' ELSE 'ok' END AS side FROM ar JOIN tops USING (step)""")
def streamed_late_rows(spark, d):
    """Rows behind the watermark go to a table beside the others (J5); a batch that comes again is stored once."""
    folder = rp.shared_folder(spark, "late")
    apply = streams.split_late(f"{folder}/sides", "ts", _LATE * 3600)

    def start(stream):
        def twice(batch, number):
            apply(batch, number)
            apply(batch, number)

        return stream.writeStream.foreachBatch(twice)

    rows = _arriving(spark, d)
    rp.replay(rows, "step", folder, start)
    side = lambda name: spark.read.schema(rows.drop("step").schema).parquet(f"{folder}/sides/{name}/*").withColumn("side", F.lit(name))
    return side("ok").unionByName(side("late")).select("event_id", "user_id", "t", "side")


@query(f"""WITH {_ARRIVED}, o AS (SELECT (t - {MONTH[0]}) // {_DAY} AS day, step, count(*) AS n, round(sum(value), 3) AS total FROM ar GROUP BY ALL)
    SELECT CAST(day AS INTEGER) AS day, step AS observed_at, n, total FROM o QUALIFY row_number() OVER (PARTITION BY day ORDER BY step DESC) = 1""")
def streamed_observations(spark, d):
    """The last observation of each day (J3): every batch replaces the days that it has, and one is applied twice."""
    rows = _arriving(spark, d)
    day = F.floor((F.col("t") - MONTH[0]) / _DAY).cast("int").alias("day")
    seen = rows.groupBy(day, F.col("step").alias("observed_at")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).withColumn("step", F.col("observed_at"))
    folder = rp.shared_folder(spark, "observations")
    apply = sinks.replace_days(f"{folder}/days", "day")

    def start(stream):
        def twice(batch, number):
            apply(batch, number)
            apply(batch, number)

        return stream.writeStream.foreachBatch(twice)

    rp.replay(seen, "step", folder, start)
    return spark.read.schema(seen.drop("step").schema).parquet(f"{folder}/days").select("day", "observed_at", "n", "total")


@query(f"""WITH {_ARRIVED}, o AS (SELECT (t - {MONTH[0]}) // {_DAY} AS day, step, count(*) AS n FROM ar WHERE step < 3 GROUP BY ALL)
    SELECT day, step AS observed_at, n FROM o QUALIFY row_number() OVER (PARTITION BY day ORDER BY step DESC) = 1""")
def upserted_days(spark, d):
    """Daily counts upserted twice, the second time with the same rows again."""
    rows = _arriving(spark, d).where("step < 3")
    seen = rows.groupBy(F.floor((F.col("t") - MONTH[0]) / _DAY).alias("day"), F.col("step").alias("observed_at")).agg(F.count("*").alias("n"))
    first = sinks.upsert_daily(seen.where("observed_at = 0"), seen.where("observed_at = 1"))
    return sinks.upsert_daily(sinks.upsert_daily(first, seen.where("observed_at = 2")), seen.where("observed_at = 2"))
