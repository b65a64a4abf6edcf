"""Statistics, fits and comparisons over orders, events, labels and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators import stats
from versewise.plans.registry import EV, HOUR, MONTH, events, query, table

_ERR = "err AS (SELECT l_returnflag, l_linestatus, l_orderkey, l_extendedprice / l_quantity - p_retailprice AS e FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _errors(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return rows.join(part, rows.l_partkey == part.p_partkey).withColumn("e", F.col("unit") - F.col("p_retailprice"))


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query(f"WITH {_ERR} SELECT l_returnflag, count(e) AS n, round(quantile_cont(abs(e), 0.5), 6) AS median, round(quantile_cont(abs(e), 0.95), 6) AS p95, round(avg(abs(e)), 6) AS mae, round(max(abs(e)), 6) AS worst, round(avg(CASE WHEN abs(e) > 500 THEN 1 ELSE 0 END), 6) AS late_share FROM err GROUP BY 1")
def line_error_summary_interp(spark, d):
    return _rounded(stats.error_summaries(_errors(spark, d), ["l_returnflag"], "e"), "median", "p95", "mae", "worst", "late_share")


@query(f"WITH {_ERR}, r AS (SELECT l_returnflag, abs(e) AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(e)) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM err) SELECT l_returnflag, count(*) AS n, round(quantile_cont(e, 0.5), 6) AS median, round(max(CASE WHEN r = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1 THEN e END), 6) AS p95 FROM r GROUP BY 1")
def line_error_summary_nearest(spark, d):
    return _rounded(stats.nearest_rank_summary(_errors(spark, d), ["l_returnflag"], "e"), "median", "p95")


@query(f"WITH {_ERR}, r AS (SELECT l_returnflag, e AS s, abs(e) AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(e)) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM err) SELECT l_returnflag, count(*) AS n, round(quantile_cont(s, 0.5), 6) AS signed_median, round(max(CASE WHEN r = least(n, CAST(floor(0.9 * n) AS BIGINT) + 1) THEN e END), 6) AS p90, round(max(CASE WHEN r = least(n, CAST(floor(0.95 * n) AS BIGINT) + 1) THEN e END), 6) AS p95, round(avg(CASE WHEN e <= 100 THEN 1 ELSE 0 END), 6) AS within_100, round(avg(CASE WHEN e <= 200 THEN 1 ELSE 0 END), 6) AS within_200 FROM r GROUP BY 1")
def line_error_summary_floor(spark, d):
    return _rounded(stats.floor_rank_summary(_errors(spark, d), ["l_returnflag"], "e"), "signed_median", "p90", "p95", "within_100", "within_200")


@query(f"WITH {_ERR}, p AS (SELECT l_orderkey, count(*) AS n, quantile_cont(abs(e), 0.5) AS median FROM err GROUP BY 1) SELECT round(sum(median * n) / sum(n), 6) AS weighted_median FROM p")
def weighted_median_of_orders(spark, d):
    per = _errors(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.percentile(F.abs("e"), 0.5).alias("median"))
    return _rounded(stats.weighted_mean_of_medians(per), "weighted_median")


@query("SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS kind, count(*) AS lines, count(CASE WHEN l_quantity >= 10 THEN 1 END) AS placed, count(CASE WHEN l_discount > 0.08 THEN 1 END) AS wrong, round(count(CASE WHEN l_quantity >= 10 THEN 1 END) / count(*), 6) AS rate FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def pooled_and_by_kind(spark, d):
    placed, wrong = F.count_if(F.col("l_quantity") >= 10), F.count_if(F.col("l_discount") > 0.08)
    rows = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "kind")
    return stats.pooled_and_by_kind(rows, "kind", [F.count("*").alias("lines"), placed.alias("placed"), wrong.alias("wrong"), F.round(placed / F.count("*"), 6).alias("rate")])


_COND = "c AS (SELECT o_custkey, coalesce(count(*) >= 5, false) AS enough, coalesce(max(o_totalprice) > 300000, false) AS large, coalesce(bool_and(o_orderstatus <> 'P'), false) AS settled FROM orders GROUP BY 1)"


def _conditions(spark, d):
    checks = {"enough": F.count("*") >= 5, "large": F.max("o_totalprice") > 300000, "settled": F.every(F.col("o_orderstatus") != "P")}
    return stats.conditions(table(spark, d, "orders"), "o_custkey", checks)


@query(f"WITH {_COND} SELECT * FROM c")
def conditions_per_recording(spark, d):
    return _conditions(spark, d)


@query(f"WITH {_COND}, u AS (SELECT 'enough' AS condition, enough AS p FROM c UNION ALL SELECT 'large', large FROM c UNION ALL SELECT 'settled', settled FROM c) SELECT condition, count(CASE WHEN p THEN 1 END) AS passes, count(*) AS n FROM u GROUP BY 1")
def condition_passes(spark, d):
    return stats.condition_passes(_conditions(spark, d), ["enough", "large", "settled"])


# Scores of documents: the share of short words, and words by line; matched is quality 1.
_SCORE = "sc AS (SELECT doc_id, source, lang, quality = 1 AS matched, toxic = 1 AS legacy, round(len(list_filter(w, lambda x: length(x) <= 3)) / greatest(1, len(w)), 6) AS short_share, round(1.0 / greatest(1, n_lines), 6) AS line_share FROM (SELECT l.doc_id, source, lang, quality, toxic, string_split(text, ' ') AS w, len(string_split(text, chr(10))) AS n_lines FROM labels l JOIN documents d ON l.doc_id = d.doc_id))"


def _scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.split("text", " ").alias("w"), F.size(F.split("text", "\n")).alias("n_lines"))
    rows = table(spark, d, "labels").join(docs, "doc_id")
    short = F.size(F.filter("w", lambda x: F.length(x) <= 3)) / F.greatest(F.lit(1), F.size("w"))
    return rows.select("doc_id", "source", "lang", (F.col("quality") == 1).alias("matched"), (F.col("toxic") == 1).alias("legacy"), F.round(short, 6).alias("short_share"), F.round(1.0 / F.greatest(F.lit(1), F.col("n_lines")), 6).alias("line_share"))


_WILSON = "CASE WHEN {n} > 0 THEN round((({s} / {n}) + {z2} / (2 * {n}) {sign} 1.959963984540054 * sqrt(({s} / {n}) * (1 - {s} / {n}) / {n} + {z2} / (4.0 * {n} * {n}))) / (1 + {z2} / {n}), 6) END"


def _wilson_sql(s, n, sign):
    return _WILSON.format(s=s, n=n, sign=sign, z2=1.959963984540054**2)


@query(f"WITH {_SCORE}, c AS (SELECT lang, count(CASE WHEN matched AND short_share > 0.4 THEN 1 END) AS tp, count(CASE WHEN NOT matched AND short_share > 0.4 THEN 1 END) AS fp, count(CASE WHEN NOT matched AND short_share <= 0.4 THEN 1 END) AS tn, count(CASE WHEN matched AND short_share <= 0.4 THEN 1 END) AS fn, count(CASE WHEN short_share IS NULL THEN 1 END) AS unavailable FROM sc GROUP BY 1) SELECT *, {_wilson_sql('tp', '(tp + fn)', '-')} AS recall_low, {_wilson_sql('tp', '(tp + fn)', '+')} AS recall_high FROM c")
def confusion_wilson(spark, d):
    c = _scores(spark, d).groupBy("lang").agg(*stats.confusion(F.col("matched"), F.col("short_share") > 0.4))
    w = stats.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"recall_low": F.round(w["low"], 6), "recall_high": F.round(w["high"], 6)})


@query(f"WITH {_SCORE}, g AS (SELECT lang, max(CASE WHEN matched THEN short_share END) AS good FROM sc GROUP BY 1), b AS (SELECT sc.lang, max(good) AS good, min(CASE WHEN NOT matched AND short_share > good THEN short_share END) AS bad FROM sc JOIN g ON sc.lang = g.lang GROUP BY 1) SELECT lang, round(CASE WHEN good IS NOT NULL THEN coalesce((good + bad) / 2, 1.0) END, 6) AS threshold FROM b")
def fit_threshold_high(spark, d):
    return _rounded(stats.fit_threshold_high(_scores(spark, d), ["lang"], "short_share", "matched"), "threshold")


@query(f"WITH {_SCORE}, g AS (SELECT lang, min(CASE WHEN matched THEN short_share END) AS pos, min(short_share) AS least FROM sc GROUP BY 1), b AS (SELECT sc.lang, max(pos) AS pos, max(least) AS least, max(CASE WHEN NOT matched AND short_share < pos THEN short_share END) AS neg FROM sc JOIN g ON sc.lang = g.lang GROUP BY 1) SELECT lang, round(coalesce((pos + neg) / 2, least - 1), 6) AS threshold FROM b")
def fit_threshold_low(spark, d):
    return _rounded(stats.fit_threshold_low(_scores(spark, d), ["lang"], "short_share", "matched"), "threshold")


_FLAG = "(CASE feature WHEN 'short_share' THEN score > 0.4 ELSE score > 0.3 END)"


@query(f"""WITH {_SCORE}, f AS (SELECT lang, matched, legacy, 'short_share' AS feature, short_share AS score FROM sc UNION ALL SELECT lang, matched, legacy, 'line_share', line_share FROM sc),
    r AS (SELECT *, 'alone' AS rule, {_FLAG} AS flag FROM f UNION ALL SELECT *, 'with_legacy', CASE WHEN legacy THEN true ELSE {_FLAG} END FROM f)
    SELECT feature, rule, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, count(CASE WHEN matched AND flag THEN 1 END) AS tp, count(CASE WHEN NOT matched AND flag THEN 1 END) AS fp, count(CASE WHEN NOT matched AND NOT flag THEN 1 END) AS tn, count(CASE WHEN matched AND NOT flag THEN 1 END) AS fn, count(CASE WHEN flag IS NULL THEN 1 END) AS unavailable FROM r GROUP BY GROUPING SETS ((feature, rule, lang), (feature, rule))""")
def freeze_score_matrix(spark, d):
    return stats.score_matrix(_scores(spark, d), ["short_share", "line_share"], {"short_share": 0.4, "line_share": 0.3}, "matched", "legacy", ["lang"])


@query(f"""WITH {_SCORE}, g AS (SELECT a * 5 + b AS cell, a / 10.0 AS ga, b / 10.0 AS gb FROM (SELECT unnest(range(1, 6)) AS a), (SELECT unnest(range(0, 5)) AS b)),
    s AS (SELECT source, cell, sum(CASE WHEN short_share <= ga AND line_share >= gb THEN CASE WHEN matched THEN 1.0 ELSE -25.0 END ELSE 0.0 END)::DOUBLE AS score FROM sc, g GROUP BY 1, 2),
    r AS (SELECT source, cell, sum(score) OVER (PARTITION BY cell) - score AS rest FROM s) SELECT source, cell, rest FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rest DESC, cell) AS k FROM r) WHERE k = 1""")
def loo_gate_selection(spark, d):
    a, b = spark.range(1, 6).withColumnRenamed("id", "a"), spark.range(0, 5).withColumnRenamed("id", "b")
    grid = a.crossJoin(b).select((F.col("a") * 5 + F.col("b")).alias("cell"), (F.col("a") / 10).alias("ga"), (F.col("b") / 10).alias("gb"))
    # 25 cells, whatever the data: the grid is broadcast and only sums leave the aggregation.
    met = _scores(spark, d).crossJoin(F.broadcast(grid))
    inside = (F.col("short_share") <= F.col("ga")) & (F.col("line_share") >= F.col("gb"))
    per = met.groupBy("source", "cell").agg(F.coalesce(stats.gate_utility(F.when(inside, F.col("matched"))), F.lit(0.0)).alias("score"))
    return stats.leave_one_out(per, "source", "cell", "score", "cell").select("source", "cell", "rest")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem GROUP BY 1")
def ols_by_group(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.ols(F.col("l_quantity"), F.col("l_extendedprice")))
    return out.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""WITH f AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, avg(l_extendedprice - l_quantity) AS o FROM lineitem GROUP BY 1)
    SELECT l.l_returnflag, count(*) AS n, round(sqrt(avg(power(l_extendedprice - s * l_quantity - i, 2))), 4) AS rmse, round(sqrt(avg(power(l_extendedprice - l_quantity - o, 2))), 4) AS offset_rmse FROM lineitem l JOIN f USING (l_returnflag) GROUP BY 1""")
def affine_residuals(spark, d):
    out = stats.affine_fit(table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("rmse", 4).alias("rmse"), F.round("offset_rmse", 4).alias("offset_rmse"))


@query("""WITH w AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, 1.0 / count(*) OVER (PARTITION BY l_returnflag, l_orderkey) AS w FROM lineitem), s AS (SELECT l_returnflag, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM w GROUP BY 1)
    SELECT l_returnflag, round((w * xy - x * y) / (w * xx - x * x), 4) AS slope, round((y - (w * xy - x * y) / (w * xx - x * x) * x) / w, 2) AS intercept FROM s""")
def weighted_ols(spark, d):
    out = stats.balanced_fit(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"))


@query("""WITH s AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_tax) AS ab, sum(l_tax * l_tax) AS bb, sum(l_quantity * l_extendedprice) AS ay, sum(l_tax * l_extendedprice) AS by_, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem GROUP BY 1),
    c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS c1, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS c2 FROM s) SELECT l_returnflag, n, round(c1, 4) AS c1, round(c2, 2) AS c2, round(sqrt((yy - c1 * ay - c2 * by_) / n), 2) AS rmse FROM c""")
def two_feature_fit(spark, d):
    out = stats.two_feature_fit(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_tax", "l_extendedprice")
    return out.select("l_returnflag", "n", F.round("c1", 4).alias("c1"), F.round("c2", 2).alias("c2"), F.round("rmse", 2).alias("rmse"))


_GRID = f"""dy AS (SELECT event_type, CAST((t - {MONTH[0]}) // {24 * HOUR} AS DOUBLE) AS day, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY 1, 2), g AS (SELECT o * 4 + k AS cell, o * 5.0 AS onset, (k + 1) * 5.0 AS width FROM (SELECT unnest(range(0, 5)) AS o), (SELECT unnest(range(0, 4)) AS k)),
    x AS (SELECT event_type, cell, onset, width, n, power(least(1.0, greatest(0.0, (day - onset) / width)), 2) * (3 - 2 * least(1.0, greatest(0.0, (day - onset) / width))) AS x FROM dy, g)"""


@query(f"""WITH {EV}, {_GRID}, f AS (SELECT event_type, cell, onset, width, round(sqrt(greatest(0, regr_syy(n, x) - coalesce(regr_slope(n, x) * regr_sxy(n, x), 0)) / count(*)), 9) AS rmse FROM x GROUP BY 1, 2, 3, 4)
    SELECT event_type, cell, CAST(onset AS DOUBLE) AS onset, CAST(width AS DOUBLE) AS width, round(rmse, 6) AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rmse, cell) AS k FROM f) WHERE k = 1""")
def grid_fit(spark, d):
    from versewise.functions.times import smoothstep

    days = events(spark, d).groupBy("event_type", F.expr(f"cast((t - {MONTH[0]}) div {24 * HOUR} as double)").alias("day")).agg(F.count("*").cast("double").alias("n_events"))
    o, k = spark.range(5).withColumnRenamed("id", "o"), spark.range(4).withColumnRenamed("id", "k")
    grid = o.crossJoin(k).select((F.col("o") * 4 + F.col("k")).alias("cell"), (F.col("o") * 5.0).alias("onset"), ((F.col("k") + 1) * 5.0).alias("width"))
    out = stats.grid_fit(days, grid, ["event_type"], smoothstep((F.col("day") - F.col("onset")) / F.col("width")), "n_events", ["onset", "width"])
    return out.select("event_type", "cell", "onset", "width", F.round("rmse", 6).alias("rmse"))


@query("""WITH s AS (SELECT c_mktsegment AS fold, c_nationkey AS candidate, round(avg(c_acctbal), 6) AS m FROM customer GROUP BY 1, 2), r AS (SELECT fold, CAST(candidate AS BIGINT) AS candidate, round(sum(m) OVER (PARTITION BY candidate) - m, 9) AS rest FROM s)
    SELECT fold, candidate, round(rest, 6) AS rest FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY rest DESC, candidate) AS k FROM r) WHERE k = 1""")
def loo_spacing(spark, d):
    per = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("fold"), F.col("c_nationkey").cast("bigint").alias("candidate")).agg(F.round(F.avg("c_acctbal"), 6).alias("m"))
    return stats.leave_one_out(per, "fold", "candidate", "m", "candidate").select("fold", "candidate", F.round("rest", 6).alias("rest"))


@query("""WITH l AS (SELECT p_brand AS candidate, p_size % 5 AS case_, avg(p_retailprice) AS loss, bool_and(p_retailprice > 0) AS ok FROM part GROUP BY 1, 2), p AS (SELECT candidate, avg(loss) AS m, bool_and(ok) AS ok, count(DISTINCT case_) AS n FROM l GROUP BY 1)
    SELECT candidate, round(m, 6) AS mean_loss FROM p WHERE ok AND n = (SELECT count(DISTINCT case_) FROM l) AND m - (SELECT min(m) FROM p WHERE ok AND n = (SELECT count(DISTINCT case_) FROM l)) < 1e-12""")
def candidate_selection(spark, d):
    losses = table(spark, d, "part").groupBy(F.col("p_brand").alias("candidate"), (F.col("p_size") % 5).alias("case_")).agg(F.avg("p_retailprice").alias("loss"), F.every(F.col("p_retailprice") > 0).alias("ok"))
    return _rounded(stats.select_candidates(losses, "candidate", "case_", "loss", "ok"), "mean_loss")


@query("""WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_discount <= 0.05), b AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_discount <= 0.07 AND l_quantity >= 3)
    SELECT l_returnflag, count(CASE WHEN x AND y THEN 1 END) AS retained, count(CASE WHEN y AND x IS NULL THEN 1 END) AS recovered, count(CASE WHEN x AND y IS NULL THEN 1 END) AS lost FROM (SELECT *, true AS x FROM a) FULL JOIN (SELECT *, true AS y FROM b) USING (l_orderkey, l_linenumber, l_returnflag) GROUP BY 1""")
def set_deltas(spark, d):
    rows = table(spark, d, "lineitem")
    return stats.set_deltas(rows.where("l_discount <= 0.05"), rows.where("l_discount <= 0.07 and l_quantity >= 3"), ["l_orderkey", "l_linenumber", "l_returnflag"], ["l_returnflag"])


@query("""WITH k AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1), a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v, l_linestatus AS u FROM lineitem SEMI JOIN k USING (l_orderkey, l_linenumber) WHERE l_quantity <= 40),
    b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.06 THEN 'X' ELSE l_returnflag END AS v, l_linestatus AS u FROM lineitem SEMI JOIN k USING (l_orderkey, l_linenumber) WHERE l_quantity >= 5)
    SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, CAST(coalesce(a.l_linenumber, b.l_linenumber) AS BIGINT) AS l_linenumber, CASE WHEN a.l_orderkey IS NULL THEN 'new row' WHEN b.l_orderkey IS NULL THEN 'missing row' ELSE 'v' END AS differs
    FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_orderkey IS NULL OR b.l_orderkey IS NULL OR a.v IS DISTINCT FROM b.v""")
def version_comparison(spark, d):
    rows = table(spark, d, "lineitem").withColumn("_c", F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber"))).where("_c = 1")
    rows = rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity", "l_tax", F.col("l_returnflag").alias("v"), F.col("l_linestatus").alias("u"))
    stored, computed = rows.where("l_quantity <= 40"), rows.where("l_quantity >= 5").withColumn("v", F.when(F.col("l_tax") > 0.06, F.lit("X")).otherwise(F.col("v")))
    return stats.table_differences(stored, computed, ["l_orderkey", "l_linenumber"], ["v", "u"]).withColumn("differs", F.array_join("differs", ","))


@query("WITH ev AS (SELECT event_id, event_type, epoch_us(ts) AS t, value FROM events) SELECT event_type, t // 86400000000 AS day, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t // 86400000000 ORDER BY t DESC, event_id DESC) AS k FROM ev) WHERE k = 1")
def latest_per_day(spark, d):
    rows = events(spark, d).withColumn("day", F.expr("t div 86400000000"))
    return rows.groupBy("event_type", "day").agg(F.max_by("value", F.struct("t", "event_id")).alias("value"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS least, max(value) AS most, round(max(value) - min(value), 6) AS span FROM events GROUP BY 1")
def moments(spark, d):
    return _rounded(events(spark, d).groupBy("event_type").agg(*stats.moments(F.col("value"))), "mean", "sd", "span")


@query("SELECT event_type, CAST(floor((value - 8) / 16) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def value_histogram(spark, d):
    return events(spark, d).groupBy("event_type", stats.histogram(F.col("value"), 8, 16).alias("bin")).agg(F.count("*").alias("n"))


@query(f"WITH {EV}, e AS (SELECT event_type, (t // 1000000) % 3600 + 1800.0 AS e FROM ev) SELECT event_type, round(sqrt(avg(power((e - floor(e / 3600) * 3600) - 1800, 2))), 4) AS rms FROM e GROUP BY 1")
def cyclic_rms(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(stats.cyclic_rms(F.expr("t div 1000000").cast("double"), 3600.0), 4).alias("rms"))


@query("""WITH f AS (SELECT l_orderkey, unnest([CASE WHEN l_discount > 0.08 THEN 'steep' END, CASE WHEN l_tax > 0.06 THEN 'taxed' END, CASE WHEN l_quantity < 5 THEN 'small' END]) AS flag FROM lineitem) SELECT flag, count(*) AS n FROM f WHERE flag IS NOT NULL GROUP BY 1""")
def flag_histogram(spark, d):
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.08, F.lit("steep")), F.when(F.col("l_tax") > 0.06, F.lit("taxed")), F.when(F.col("l_quantity") < 5, F.lit("small"))))
    return stats.flag_histogram(table(spark, d, "lineitem").select(flags.alias("flags")))


@query("""WITH p AS (SELECT vec_id, i, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)), q AS (SELECT a.vec_id, CAST(b.v AS DOUBLE) - CAST(a.v AS DOUBLE) AS d FROM p a JOIN p b ON b.vec_id = a.vec_id + 1 AND a.i = b.i)
    SELECT vec_id, round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(10 * log10(65025.0 / avg(d * d)), 4) AS psnr FROM q GROUP BY 1""")
def array_difference(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    out = stats.array_difference(e, e.withColumn("vec_id", F.col("vec_id") - 1), ["vec_id"], "i", "v")
    return out.select("vec_id", F.round("mae", 6).alias("mae"), F.round("mse", 6).alias("mse"), F.round("psnr", 4).alias("psnr"))


@query(f"""WITH {EV}, s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, value / 100.0 AS x FROM ev) SELECT user_id, CAST(i // 8 AS BIGINT) AS frame_idx, round(20 * log10(sqrt(avg(x * x) + 1e-12)), 6) AS level_db FROM s GROUP BY 1, 2 HAVING count(*) = 8""")
def level_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, d).select("user_id", (F.row_number().over(w) - 1).alias("i"), (F.col("value") / 100).alias("x"))
    return stats.level_db(rows, "user_id", "i", "x", 8).withColumn("level_db", F.round("level_db", 6))


@query("SELECT lang, source, count(*) AS n, round(greatest(0.0, least(1.0, sum(length(text) * 1.0 * n_chars) / sum(length(text) * 1.0 * length(text)))), 6) AS ratio FROM documents GROUP BY 1, 2")
def bounded_ratio(spark, d):
    n = F.length("text").cast("double")
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(stats.bounded_ratio(n, F.col("n_chars")), 6).alias("ratio"))
