"""Annotation records (M7) and their reviews (M8), built from orders and events: a user is a recording."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators import quality
from versewise.plans.registry import EV, events, query, table

_N = "user_id"
#: The record of each user: an excerpt of 40 s and more, with faults by number.
_REC = f"""u AS (SELECT DISTINCT user_id FROM ev), rec AS (SELECT user_id, CASE WHEN {_N} % 17 = 3 THEN ' ' ELSE 's' || user_id END AS source_id, CASE WHEN {_N} % 19 = 4 THEN 'x' ELSE sha256('a' || user_id) END AS audio, 'p' || user_id % 5 AS annotator, CASE WHEN {_N} % 7 = 0 THEN 'p' || user_id % 5 ELSE 'q' END AS reviewer,
    CASE WHEN {_N} % 23 = 5 THEN 'de' ELSE 'en' END AS language, CASE WHEN {_N} % 29 = 6 THEN 0 ELSE 44100 END AS rate, 44100 * (CASE WHEN {_N} % 13 = 1 THEN 61 ELSE 40 END) AS size, CASE WHEN {_N} % 13 = 1 THEN 61000000 ELSE 40000000 END + CASE WHEN {_N} % 11 = 2 THEN 2 ELSE 0 END AS duration, CASE WHEN {_N} % 31 = 7 THEN 0 ELSE 1000 END AS resolution,
    CASE WHEN {_N} % 3 = 0 THEN 'reviewed' WHEN {_N} % 37 = 8 THEN 'draft' ELSE 'independent_pass' END AS status, CASE WHEN {_N} % 3 = 0 THEN (CASE WHEN {_N} % 4 = 0 THEN 1 ELSE 2 END) WHEN {_N} % 41 = 9 THEN 1 ELSE 0 END AS passes FROM u)"""
_KIND = "CASE WHEN value > 200 THEN 'noise' WHEN event_type = 'click' THEN 'lead_singing' WHEN event_type = 'view' THEN 'humming' WHEN event_type = 'purchase' THEN 'instrumental' WHEN event_type = 'error' THEN 'breath' ELSE 'silence' END"
_ROW = f"""iv0 AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS seq, value, event_type FROM ev),
    ro AS (SELECT user_id, seq, {_KIND} AS kind, (seq - 1) * 600000 AS a, (seq - 1) * 600000 + 1000 * (CAST(floor(value) AS BIGINT) % 120) AS b, (seq - 1) * 600000 + 100000 + 900 * (CAST(floor(value) AS BIGINT) % 300) AS c, (seq - 1) * 600000 + 300000 + 1000 * CAST(floor(value) AS BIGINT) * (CASE WHEN value > 150 THEN 4 ELSE 1 END) AS d, value % 9 < 1 AS on_, seq % 50 = 1 AS off_ FROM iv0)"""
_VOCAL, _KNOWN = "('lead_singing', 'humming')", "('lead_singing', 'humming', 'instrumental', 'breath', 'silence')"
_RULES = [
    ("trim(source_id) = ''", "identity"), ("length(audio) <> 64", "audio_digest"), ("language <> 'en'", "language"), ("rate < 1", "sample_rate"), ("size > rate * 60", "excerpt"),
    ("abs(CAST(duration AS BIGINT) * rate - CAST(size AS BIGINT) * 1000000) > rate", "duration"), ("resolution < 1", "resolution"), ("status = 'draft'", "review_status"), ("status = 'reviewed' AND reviewer = annotator", "reviewer"),
    ("(status = 'reviewed' AND passes <> 2) OR (status = 'independent_pass' AND passes > 0)", "initial_passes"),
]
_EACH = [
    (f"kind NOT IN {_KNOWN}", "unknown_kind"), (f"kind IN {_VOCAL} AND NOT (a <= b AND b <= c AND c <= d AND a < d)", "band_order"), (f"kind IN {_KNOWN} AND kind NOT IN {_VOCAL} AND a >= d", "empty_interval"),
    (f"kind IN {_VOCAL} AND ((on_ AND a <> 0) OR (off_ AND d <> duration))", "censored_edge"), ("a < upto", "envelope_order"), ("d > duration", "outside_excerpt"),
]


def _records(spark, d):
    u = events(spark, d).select("user_id").distinct()
    n = F.col("user_id")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    size = 44_100 * F.when(n % 13 == 1, 61).otherwise(40)
    hashes = lambda k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.sha2(F.concat(F.lit("pass"), i.cast("string"), n.cast("string")), 256))
    passes = F.when((n % 3 == 0) & (n % 4 == 0), hashes(1)).when(n % 3 == 0, hashes(2)).when(n % 41 == 9, hashes(1))
    return u.select(
        n.alias("recording_id"), F.when(n % 17 == 3, F.lit(" ")).otherwise(text("s", n)).alias("source_id"), F.when(n % 19 == 4, F.lit("x")).otherwise(F.sha2(text("a", n), 256)).alias("audio_sha256"), text("p", n % 5).alias("annotator"), F.when(n % 7 == 0, text("p", n % 5)).otherwise(F.lit("q")).alias("reviewer"),
        F.when(n % 23 == 5, "de").otherwise("en").alias("language"), F.when(n % 29 == 6, 0).otherwise(44_100).cast("bigint").alias("sample_rate_hz"), (size + 100).cast("bigint").alias("source_total_samples"), F.lit(100).cast("bigint").alias("source_start_sample"), (size + 100).cast("bigint").alias("source_end_sample"),
        (F.when(n % 13 == 1, 61_000_000).otherwise(40_000_000) + F.when(n % 11 == 2, 2).otherwise(0)).cast("bigint").alias("duration_us"), F.when(n % 31 == 7, 0).otherwise(1000).cast("bigint").alias("resolution_us"), F.when(n % 3 == 0, "reviewed").when(n % 37 == 8, "draft").otherwise("independent_pass").alias("review_status"), passes.alias("initial_passes"),
    )


def _rows(spark, d):
    e = events(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).cast("bigint"))
    at, v = (F.col("seq") - 1) * 600_000, F.floor("value")
    return e.select(F.col("user_id").alias("recording_id"), "seq", F.expr(_KIND).alias("kind"), at.alias("onset_earliest_us"), (at + 1000 * (v % 120)).alias("onset_latest_us"), (at + 100_000 + 900 * (v % 300)).alias("offset_earliest_us"), (at + 300_000 + 1000 * v * F.when(F.col("value") > 150, 4).otherwise(1)).alias("offset_latest_us"), (F.col("value") % 9 < 1).alias("censored_onset"), (F.col("seq") % 50 == 1).alias("censored_offset"))


@query(f"WITH {EV}, {_REC}, {_ROW}, pl AS (SELECT ro.*, duration, coalesce(lag(d) OVER (PARTITION BY user_id ORDER BY seq), 0) AS upto FROM ro JOIN rec USING (user_id)) " + " UNION ALL ".join([f"SELECT user_id AS recording_id, 'record' AS row, '{r}' AS rule_id FROM rec WHERE {c}" for c, r in _RULES] + [f"SELECT user_id, CAST(seq AS VARCHAR), '{r}' FROM pl WHERE {c}" for c, r in _EACH]))
def annotation_records(spark, d):
    """Faults of records and of their intervals (M7)."""
    return quality.annotation_record_violations(_records(spark, d), _rows(spark, d))


@query(f"""WITH {EV}, {_REC}, {_ROW}, un AS (SELECT user_id, a AS x, d AS y FROM ro WHERE kind = 'breath' OR (kind IN {_VOCAL} AND b = c) UNION ALL SELECT user_id, a, b FROM ro WHERE kind IN {_VOCAL} AND b <> c UNION ALL SELECT user_id, c, d FROM ro WHERE kind IN {_VOCAL} AND b <> c),
    cov AS (SELECT user_id, a AS x, d AS y FROM ro WHERE a < d), m AS (SELECT user_id, x, y, max(y) OVER (PARTITION BY user_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cov),
    free AS (SELECT user_id, coalesce(p, 0) AS x, least(x, duration) AS y FROM m JOIN rec USING (user_id) WHERE coalesce(p, 0) < least(x, duration) UNION ALL SELECT user_id, max(y), any_value(duration) FROM cov JOIN rec USING (user_id) GROUP BY user_id HAVING max(y) < any_value(duration)),
    every AS (SELECT * FROM un WHERE x < y UNION ALL SELECT * FROM free), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN x <= max(y) OVER (PARTITION BY user_id ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM every)),
    z AS (SELECT user_id, count(*) AS unknowns, CAST(sum(y - x) AS BIGINT) AS unknown_us FROM (SELECT user_id, g, min(x) AS x, max(y) AS y FROM g GROUP BY ALL) GROUP BY 1),
    c AS (SELECT user_id, count(*) FILTER (kind IN {_VOCAL} AND b < c AND NOT (on_ OR off_)) AS pairs, count(*) FILTER (kind IN ('instrumental', 'silence')) AS gaps, count(*) FILTER (kind = 'instrumental') AS instrumental FROM ro GROUP BY 1)
    SELECT user_id AS recording_id, pairs, gaps, instrumental, unknowns, unknown_us FROM c JOIN z USING (user_id)""")
def annotation_summaries(spark, d):
    """Unknown complement and class counts of records."""
    unknown, counts = quality.annotation_summary(_records(spark, d), _rows(spark, d))
    sums = unknown.groupBy("recording_id").agg(F.count("*").alias("unknowns"), F.sum(F.col("end") - F.col("begin")).alias("unknown_us"))
    return counts.join(sums, "recording_id").select("recording_id", "pairs", "gaps", "instrumental", "unknowns", "unknown_us")


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey % 4 AS who, CASE WHEN o_orderkey % 9 = 0 THEN 'ja' ELSE 'en' END AS lang, CAST(floor(o_totalprice) AS BIGINT) % 3 AS digest FROM orders),
    m AS (SELECT k, count(*) AS n, count(DISTINCT who) AS people, bool_and(who IN (0, 1)) AS declared, bool_and(lang = 'en') AS same, count(DISTINCT digest) AS versions FROM p WHERE i <= 2 GROUP BY 1)
    SELECT k AS recording_id, 'review' AS row, 'missing_pass' AS rule_id FROM m WHERE n <> 2 UNION ALL SELECT k, 'review', 'not_the_declared_people' FROM m WHERE people < 2 OR NOT declared
    UNION ALL SELECT k, 'review', 'different_identity' FROM m WHERE NOT same UNION ALL SELECT k, 'review', 'disagreement_missing' FROM m WHERE versions > 1 AND k % 2 = 1""")
def review_faults(spark, d):
    """Reviewed records of customers against their first two orders as passes (M8)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    p = table(spark, d, "orders").withColumn("i", F.row_number().over(w)).where("i <= 2")
    sha = lambda k, i: F.sha2(F.concat_ws("/", k.cast("string"), i.cast("string")), 256)
    fixed = {"audio_sha256": F.lit("a"), "sample_rate_hz": F.lit(1), "source_start_sample": F.lit(0), "source_end_sample": F.lit(9)}
    passes = p.select((-F.col("o_orderkey")).alias("recording_id"), F.col("o_custkey").cast("string").alias("source_id"), (F.col("o_orderkey") % 4).cast("string").alias("annotator"), F.lit(None).cast("string").alias("reviewer"), F.when(F.col("o_orderkey") % 9 == 0, "ja").otherwise("en").alias("language"), F.lit("independent_pass").alias("review_status"), F.lit(None).cast("array<string>").alias("initial_passes"), sha(F.col("o_custkey"), F.col("i")).alias("sha256"), (F.floor(F.col("o_totalprice").cast("double")) % 3).cast("string").alias("digest"))
    own = p.select("o_custkey").distinct().select(F.col("o_custkey").alias("recording_id"), F.col("o_custkey").cast("string").alias("source_id"), F.lit("0").alias("annotator"), F.lit("1").alias("reviewer"), F.lit("en").alias("language"), F.lit("reviewed").alias("review_status"), F.array(sha(F.col("o_custkey"), F.lit(1)), sha(F.col("o_custkey"), F.lit(2))).alias("initial_passes"), F.lit("r").alias("sha256"))
    every = own.unionByName(passes.drop("digest")).withColumns(fixed)
    return quality.review_violations(every, passes.select("recording_id", "digest"), own.where("recording_id % 2 = 0").select("recording_id"))
