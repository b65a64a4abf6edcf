"""Error summaries, confusion, threshold fits and least-squares fits as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.operators import selection


def error_summary(error: Column, late: float = 500.0) -> list[Column]:
    """Interpolated percentiles of absolute errors: count, median, p95, mean, max, share above ``late``.

    For groups of bounded size, such as a recording's lines; see ``error_summaries`` for others.
    """
    e = F.abs(error)
    return [F.count(error).alias("n"), F.percentile(e, 0.5).alias("median"), F.percentile(e, 0.95).alias("p95"), F.avg(e).alias("mae"), F.max(e).alias("worst"), F.avg((e > late).cast("int")).alias("late_share")]


def error_summaries(rows: DataFrame, key: Sequence[str], error: str, late: float = 500.0, **how) -> DataFrame:
    """The measures of ``error_summary`` for groups of any size: percentiles by ``selection.values_at``."""
    k = list(key)
    e = rows.withColumn("_e", F.abs(error))
    sums = e.groupBy(*k).agg(F.count("_e").alias("_n"), F.avg("_e").alias("mae"), F.max("_e").alias("worst"), F.avg((F.col("_e") > late).cast("int")).alias("late_share"))
    found = selection.percentiles(e, k, "_e", {"median": 0.5, "p95": 0.95}, **how)
    return sums.join(found, k, "left").select(*k, F.col("_n").alias("n"), "median", "p95", "mae", "worst", "late_share")


def nearest_rank_summary(rows: DataFrame, key: Sequence[str], error: str, q: float = 0.95, **how) -> DataFrame:
    """Nearest-rank percentile of absolute errors at ``round(q * (n - 1))``, ties to even, and the median."""
    ranks = lambda n: [*selection.interpolated(n, 0.5), F.bround(F.lit(q) * (n - 1), 0)]
    found = selection.values_at(rows.withColumn("_e", F.abs(error)), key, "_e", ranks, **how)
    return found.select(*key, "n", selection.between(F.col("at"), 0, F.col("n"), 0.5).alias("median"), F.get("at", F.lit(2)).alias("p95"))


def floor_rank_summary(rows: DataFrame, key: Sequence[str], error: str, **how) -> DataFrame:
    """Floor-rank p90 and p95 at ``int(q * n)``, signed median, shares within 100 and 200 (D3)."""
    k = list(key)
    e = rows.where(F.col(error).isNotNull()).withColumn("_e", F.abs(error))
    pick = lambda n, q: F.least(n - 1, F.floor(F.lit(q) * n))
    within = lambda v: F.avg((F.col("_e") <= v).cast("int"))
    sums = e.groupBy(*k).agg(F.count("*").alias("n"), within(100).alias("within_100"), within(200).alias("within_200"))
    high = selection.values_at(e, k, "_e", lambda n: [pick(n, 0.9), pick(n, 0.95)], **how)
    signed = selection.percentiles(e, k, error, {"signed_median": 0.5}, **how)
    both = sums.join(high.select(*k, F.get("at", F.lit(0)).alias("p90"), F.get("at", F.lit(1)).alias("p95")), k).join(signed.drop("n"), k)
    return both.select(*k, "n", "signed_median", "p90", "p95", "within_100", "within_200")


def pooled_and_by_kind(rows: DataFrame, kind: str, measures: Sequence[Column], pooled: str = "all") -> DataFrame:
    """The measures over everything and by kind, in one pass of grouping sets."""
    out = rows.rollup(kind).agg(F.grouping(kind).alias("_g"), *measures)
    return out.withColumn(kind, F.when(F.col("_g") == 1, F.lit(pooled)).otherwise(F.col(kind))).drop("_g")


def conditions(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Whether each named condition holds for each key, and nulls counted as failures."""
    return rows.groupBy(key).agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])


def condition_passes(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(condition, passes, n)`` over all keys."""
    long = wide.unpivot([], list(names), "condition", "passed")
    return long.groupBy("condition").agg(F.count_if("passed").alias("passes"), F.count("*").alias("n"))


def flag_histogram(rows: DataFrame, flags: str = "flags") -> DataFrame:
    """How often each flag occurs."""
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def confusion(truth: Column, flagged: Column) -> list[Column]:
    """True and false positives and negatives, and rows without a decision."""
    return [F.count_if(truth & flagged).alias("tp"), F.count_if(~truth & flagged).alias("fp"), F.count_if(~truth & ~flagged).alias("tn"), F.count_if(truth & ~flagged).alias("fn"), F.count_if(flagged.isNull()).alias("unavailable")]


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Wilson 95 % interval; null for no trials."""
    p, d = successes / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.when(n > 0, F.struct((mid - half).alias("low"), (mid + half).alias("high")))


def _join_back(rows: DataFrame, facts: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(facts, key) if key else rows.crossJoin(facts)  # one row of facts where there is no key


def fit_threshold_high(rows: DataFrame, key: Sequence[str], score: str, matched: str) -> DataFrame:
    """A flag for high scores: midway between the highest matched and the lowest mismatched above it, else 1."""
    k = list(key)
    good = rows.groupBy(*k).agg(F.max(F.when(F.col(matched), F.col(score))).alias("good"))
    bad = _join_back(rows, good, k).groupBy(*k).agg(F.max("good").alias("good"), F.min(F.when(~F.col(matched) & (F.col(score) > F.col("good")), F.col(score))).alias("bad"))
    return bad.select(*k, F.when(F.col("good").isNotNull(), F.coalesce((F.col("good") + F.col("bad")) / 2, F.lit(1.0))).alias("threshold"))


def fit_threshold_low(rows: DataFrame, key: Sequence[str], score: str, positive: str) -> DataFrame:
    """A flag for low scores: midway between the lowest positive and the highest negative below it, else least - 1."""
    k = list(key)
    low = rows.groupBy(*k).agg(F.min(F.when(F.col(positive), F.col(score))).alias("pos"), F.min(score).alias("least"))
    neg = _join_back(rows, low, k).groupBy(*k).agg(F.max("pos").alias("pos"), F.max("least").alias("least"), F.max(F.when(~F.col(positive) & (F.col(score) < F.col("pos")), F.col(score))).alias("neg"))
    return neg.select(*k, F.coalesce((F.col("pos") + F.col("neg")) / 2, F.col("least") - 1).alias("threshold"))


def either(legacy: Column, new: Column) -> Column:
    """Union of evidence: a legacy flag wins, else the new one, which may be unknown."""
    return F.when(legacy, F.lit(True)).otherwise(new)


def flagged(score: Column, threshold: Column) -> Column:
    """A score above its threshold; unknown where either is."""
    return score > threshold


def score_matrix(rows: DataFrame, features: Sequence[str], thresholds: dict[str, float] | DataFrame, truth: str, legacy: str, by: Sequence[str]) -> DataFrame:
    """Confusion of every feature's flag, alone and with the legacy flag, by the given columns and in total.

    ``thresholds`` by feature, or a small table of them: (feature, threshold) and any of the columns ``by``.
    """
    long = rows.unpivot([*by, truth, legacy], list(features), "feature", "score")
    if isinstance(thresholds, dict):
        limit = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])
        long = long.withColumn("threshold", F.element_at(limit, F.col("feature")))
    else:
        on = ["feature", *[c for c in by if c in thresholds.columns]]
        long = long.join(thresholds.select(*on, "threshold"), on, "left")
    flag = flagged(F.col("score"), F.col("threshold"))
    both = long.withColumn("flag", F.explode(F.array(F.struct(F.lit("alone").alias("rule"), flag.alias("on")), F.struct(F.lit("with_legacy").alias("rule"), either(F.col(legacy), flag).alias("on"))))).select("*", "flag.*")
    out = both.groupingSets([["feature", "rule", *by], ["feature", "rule"]], "feature", "rule", *by).agg(*confusion(F.col(truth), F.col("on")), *[F.grouping(b).alias(f"_{b}") for b in by])
    for b in by:
        out = out.withColumn(b, F.when(F.col(f"_{b}") == 1, F.lit("all")).otherwise(F.col(b))).drop(f"_{b}")
    return out


def fit_features(rows: DataFrame, key: Sequence[str], features: Sequence[str], matched: str) -> DataFrame:
    """High-score thresholds of several features: (key..., feature, threshold)."""
    long = rows.unpivot([*key, matched], list(features), "feature", "score").where("score is not null")
    return fit_threshold_high(long, [*key, "feature"], "score", matched)


def held_out_spacing(rows: DataFrame, recording: str, x: str, y: str) -> DataFrame:
    """Every recording judged by the mean scale of the others: (recording, scale, offset, rmse, worst, n).

    The scale of each is its least-squares slope; the others' mean is the total less its own, so all are fitted in one pass.
    Only the offset is taken from the recording itself. Recordings without a slope (no spread of x) are in no mean and judge by
    the mean of all others; one recording alone has nulls.
    """
    own = rows.groupBy(recording).agg(F.regr_slope(y, x).alias("_own"), F.avg(x).alias("_x"), F.avg(y).alias("_y"), F.count("*").alias("n"))
    total = own.agg(F.sum("_own").alias("_sum"), F.count("_own").alias("_of"))  # one row
    scale = (F.col("_sum") - F.coalesce("_own", F.lit(0.0))) / F.nullif(F.col("_of") - F.col("_own").isNotNull().cast("int"), F.lit(0))
    facts = own.crossJoin(F.broadcast(total)).withColumn("scale", scale).withColumn("offset", F.col("_y") - F.col("scale") * F.col("_x")).select(recording, "scale", "offset", "n")
    r = F.col(y) - F.col("offset") - F.col("scale") * F.col(x)
    return rows.join(facts, recording).groupBy(recording, "scale", "offset", "n").agg(F.sqrt(F.avg(r * r)).alias("rmse"), F.max(F.abs(r)).alias("worst"))


def ols(x: Column, y: Column) -> list[Column]:
    """Slope and intercept."""
    return [F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")]


def affine_fit(rows: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    """Scale and offset with their residual RMSE, and the RMSE of an offset alone."""
    k = list(key)
    fit = rows.groupBy(*k).agg(*ols(F.col(x), F.col(y)), F.avg(F.col(y) - F.col(x)).alias("offset"))
    r, t = F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")), F.col(y) - F.col(x) - F.col("offset")
    return _join_back(rows, fit, k).groupBy(*k, "slope", "intercept", "offset").agg(F.count("*").alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.sqrt(F.avg(t * t)).alias("offset_rmse"))


def fixed_slope_fit(rows: DataFrame, key: Sequence[str], x: str, y: str, scale: float) -> DataFrame:
    """The offset for a given scale, and its residuals."""
    k = list(key)
    d = F.col(y) - F.lit(scale) * F.col(x)
    return rows.groupBy(*k).agg(F.avg(d).alias("offset"), F.stddev_pop(d).alias("rmse"), F.count("*").alias("n"))


def baseline_fit(rows: DataFrame, key: Sequence[str], idx: str, value: str) -> DataFrame:
    """Start and spacing of baselines by index; one baseline has no spacing."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"), *ols(F.col(idx), F.col(value)), F.avg(value).alias("_v")).withColumn("intercept", F.when(F.col("n") == 1, F.col("_v")).otherwise(F.col("intercept"))).withColumn("slope", F.when(F.col("n") > 1, F.col("slope"))).drop("_v")


def balanced_fit(rows: DataFrame, case: str, x: str, y: str, key: Sequence[str] = ()) -> DataFrame:
    """Least squares with every case weighing the same whatever its rows."""
    w = 1 / F.count("*").over(Window.partitionBy(*key, case))
    sums = rows.withColumn("_w", w).groupBy(*key).agg(*[F.sum(F.col("_w") * e).alias(n) for n, e in {"w": F.lit(1.0), "x": F.col(x), "y": F.col(y), "xx": F.col(x) * F.col(x), "xy": F.col(x) * F.col(y)}.items()])
    slope = (F.col("w") * F.col("xy") - F.col("x") * F.col("y")) / F.nullif(F.col("w") * F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0))
    return sums.withColumn("slope", slope).select(*key, "slope", ((F.col("y") - F.col("slope") * F.col("x")) / F.col("w")).alias("intercept"))


def bounded_ratio(x: Column, y: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Coefficient without an intercept, clamped."""
    return F.least(F.lit(high), F.greatest(F.lit(low), F.sum(x * y) / F.nullif(F.sum(x * x), F.lit(0.0))))


def two_feature_fit(rows: DataFrame, key: Sequence[str], x1: str, x2: str, y: str) -> DataFrame:
    """Two coefficients without intercept by the normal equations, and the RMSE."""
    names = {"aa": (x1, x1), "ab": (x1, x2), "bb": (x2, x2), "ay": (x1, y), "by": (x2, y), "yy": (y, y)}
    s = rows.groupBy(*key).agg(F.count("*").alias("n"), *[F.sum(F.col(p) * F.col(q)).alias(n) for n, (p, q) in names.items()])
    c = F.col
    det = F.nullif(c("aa") * c("bb") - c("ab") * c("ab"), F.lit(0.0))
    s = s.withColumns({"c1": (c("ay") * c("bb") - c("by") * c("ab")) / det, "c2": (c("by") * c("aa") - c("ay") * c("ab")) / det})
    sse = c("yy") - c("c1") * c("ay") - c("c2") * c("by")
    return s.select(*key, "n", "c1", "c2", F.sqrt(F.greatest(F.lit(0.0), sse / c("n"))).alias("rmse"))


def grid_fit(samples: DataFrame, grid: DataFrame, key: Sequence[str], response: Column, y: str, grid_cols: Sequence[str]) -> DataFrame:
    """Best cell of a grid of response curves, each with its own least-squares scale and offset.

    ``grid`` is a bounded table of parameters with an ordinal ``cell``; ``response`` is an expression of sample and
    grid columns. Only sums leave the first aggregation: RMSE comes from the same sums as the fit. Ties go to the
    first cell.
    """
    k = list(key)
    met = samples.crossJoin(F.broadcast(grid)).withColumn("_x", response)
    s = met.groupBy(*k, "cell", *grid_cols).agg(F.count("*").alias("n"), *ols(F.col("_x"), F.col(y)), F.regr_syy(F.col(y), F.col("_x")).alias("_yy"), F.regr_sxy(F.col(y), F.col("_x")).alias("_xy"))
    sse = F.col("_yy") - F.coalesce(F.col("slope") * F.col("_xy"), F.lit(0.0))
    s = s.withColumn("rmse", F.round(F.sqrt(F.greatest(F.lit(0.0), sse) / F.col("n")), 9)).drop("_yy", "_xy")
    best = F.row_number().over(Window.partitionBy(*k).orderBy("rmse", "cell")) if k else F.row_number().over(Window.orderBy("rmse", "cell"))
    return s.withColumn("_b", best).where("_b = 1").drop("_b")


def residual_errors(residual: Column) -> list[Column]:
    """RMSE and worst absolute residual."""
    return [F.sqrt(F.avg(residual * residual)).alias("rmse"), F.max(F.abs(residual)).alias("worst")]


def centred_bias(rows: DataFrame, frame: str, line: str, value: str) -> DataFrame:
    """Values less their frame's median, and the mean of that by line."""
    centre = F.percentile(value, 0.5).over(Window.partitionBy(frame))
    return rows.withColumn("_d", F.col(value) - centre).groupBy(line).agg(F.avg("_d").alias("bias"), F.count("*").alias("n"))


def select_candidates(losses: DataFrame, candidate: str, case: str, loss: str, ok: str, tolerance: float = 1e-12) -> DataFrame:
    """Candidates with the least mean loss over all cases; those that fail in a case or miss one are out."""
    n = losses.agg(F.count_distinct(case).alias("_all"))
    per = losses.groupBy(candidate).agg(F.avg(loss).alias("mean_loss"), F.every(ok).alias("_ok"), F.count_distinct(case).alias("_n")).crossJoin(n).where("_ok and _n = _all")
    least = per.agg(F.min("mean_loss").alias("_least"))
    return per.crossJoin(least).where(F.col("mean_loss") - F.col("_least") < tolerance).select(candidate, "mean_loss")


def gate_utility(hit: Column, wrong: float = 25.0) -> Column:
    """Correct less ``wrong`` times wrong."""
    return F.sum(F.when(hit, F.lit(1.0)).when(~hit, F.lit(-wrong)))


def leave_one_out(scores: DataFrame, fold: str, candidate: str, score: str, order: str) -> DataFrame:
    """For each fold the candidate that is best on all others: total less own, one shuffle."""
    total = F.sum(score).over(Window.partitionBy(candidate))
    rest = scores.withColumn("rest", F.round(total - F.coalesce(F.col(score), F.lit(0.0)), 9))
    w = Window.partitionBy(fold).orderBy(F.col("rest").desc(), order)
    return rest.withColumn("_b", F.row_number().over(w)).where("_b = 1").drop("_b")


def weighted_mean_of_medians(per: DataFrame, median: str = "median", n: str = "n") -> DataFrame:
    """Mean of medians weighed by their rows; not a pooled median."""
    return per.agg((F.sum(F.col(median) * F.col(n)) / F.sum(n)).alias("weighted_median"))


def set_deltas(before: DataFrame, after: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows recovered, lost and retained between two versions of a set."""
    a, b = before.select(*key).distinct().withColumn("_a", F.lit(1)), after.select(*key).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(key), "full")
    has = lambda c: F.col(c).isNotNull()
    return both.groupBy(*by).agg(F.count_if(has("_a") & has("_b")).alias("retained"), F.count_if(has("_b") & ~has("_a")).alias("recovered"), F.count_if(has("_a") & ~has("_b")).alias("lost"))


def table_differences(stored: DataFrame, computed: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows and columns in which a recomputed table differs from a stored one, nulls compared as values."""
    a, b = stored.select(*key, F.struct(*values).alias("_a")), computed.select(*key, F.struct(*values).alias("_b"))
    rows = a.join(b, list(key), "full")
    which = F.array_compact(F.array(F.when(F.col("_a").isNull(), F.lit("new row")), F.when(F.col("_b").isNull(), F.lit("missing row")), *[F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col(f"_a.{v}").eqNullSafe(F.col(f"_b.{v}")), F.lit(v)) for v in values]))
    return rows.select(*key, which.alias("differs")).where(F.size("differs") > 0)


def array_difference(left: DataFrame, right: DataFrame, key: Sequence[str], idx: str, value: str) -> DataFrame:
    """MAE, MSE and PSNR of two arrays in long form, matched by index."""
    d = F.col("_r") - F.col(value)
    return left.join(right.withColumnRenamed(value, "_r"), [*key, idx]).groupBy(*key).agg(F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse")).withColumn("psnr", F.when(F.col("mse") > 0, 10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse"))))


def cyclic_rms(error: Column, period: float) -> Column:
    """RMS of errors modulo the period, centred."""
    e = F.pmod(error + period / 2, F.lit(period)) - period / 2
    return F.sqrt(F.avg(e * e))


def moments(value: Column) -> list[Column]:
    """Mean, population deviation, least, greatest, span."""
    return [F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), (F.max(value) - F.min(value)).alias("span")]


def histogram(value: Column, start: float, width: float) -> Column:
    """Number of the fixed-width bin."""
    return F.floor((value - start) / width).cast("bigint")


def level_db(samples: DataFrame, key: str, idx: str, value: str, frame: int) -> DataFrame:
    """RMS level of whole frames in dB, floored at -120."""
    out = samples.groupBy(key, F.floor(F.col(idx) / frame).alias("frame_idx")).agg(F.count("*").alias("_n"), (20 * F.log10(F.sqrt(F.avg(F.col(value) * F.col(value)) + 1e-12))).alias("level_db"))
    return out.where(F.col("_n") == frame).drop("_n")


def relative_shift(early: DataFrame, late: DataFrame, key: str, line: str, value: str) -> DataFrame:
    """The shift common to a paragraph's lines, and each line's own beyond it."""
    both = early.select(key, line, F.col(value).alias("_a")).join(late.select(key, line, F.col(value).alias("_b")), [key, line])
    return common_shift(both, key, line, "_a", "_b")


def common_shift(lines: DataFrame, key: str, line: str, early: str, late: str) -> DataFrame:
    """``relative_shift`` of lines that hold both times already: no join."""
    shifts = lines.select(key, line, (F.col(late) - F.col(early)).alias("_d"))
    common = F.avg("_d").over(Window.partitionBy(key))
    return shifts.select(key, line, common.alias("common"), (F.col("_d") - common).alias("own"))


def paired_medians(rows: DataFrame, measure: str, ours: str, theirs: str, tolerance: float = 0.25) -> DataFrame:
    """Medians of two sides by measure, their difference, and the share of pairs within the tolerance."""
    d = F.col(ours) - F.col(theirs)
    return rows.groupBy(measure).agg(F.count(d).alias("n"), F.percentile(ours, 0.5).alias("ours"), F.percentile(theirs, 0.5).alias("theirs"), F.percentile(d, 0.5).alias("difference"), F.avg((F.abs(d) <= tolerance).cast("int")).alias("within"))


def delay_errors(actual: Column, model: Column) -> list[Column]:
    """Worst and mean error of a delay model."""
    return [F.max(F.abs(actual - model)).alias("worst"), F.avg(actual - model).alias("mean"), F.count(actual - model).alias("n")]


def swap_validation(rows: DataFrame, variants: DataFrame, half: str, key: Sequence[str], x: Column, y: str) -> DataFrame:
    """Fit on either half, test on the other, for every variant.

    ``variants`` is a bounded table whose columns ``x`` may use (a shift, a threshold, a border).
    """
    met = rows.crossJoin(F.broadcast(variants)).withColumn("_x", x)
    names = [*key, *variants.columns]
    fit = met.groupBy(*names, F.col(half).alias("_train")).agg(*ols(F.col("_x"), F.col(y)))
    tested = met.join(fit, names).where(F.col(half) != F.col("_train"))
    return tested.groupBy(*names, "_train").agg(*residual_errors(F.col(y) - F.col("slope") * F.col("_x") - F.col("intercept"))).withColumnRenamed("_train", "trained_on")


def crossing_widths(low: DataFrame, high: DataFrame, key: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Durations between two crossings with their brackets, missing ones counted.

    ``low`` and ``high`` are rows of ``series.crossings`` at the two levels.
    """
    k = list(key)
    name = lambda rows, p: rows.select(*k, *[F.col(c).alias(f"{p}_{c}") for c in ("t0", "t1", "crossing")])
    both = name(low, "a").join(name(high, "b"), k, "full").withColumn("width", F.col("b_crossing") - F.col("a_crossing"))
    return both.groupBy(*group).agg(F.count("width").alias("n"), F.count_if(F.col("width").isNull()).alias("missing"), F.min("width").alias("least"), F.percentile("width", 0.5).alias("median"), F.max("width").alias("most"), F.min(F.col("b_t0") - F.col("a_t1")).alias("bracket_low"), F.max(F.col("b_t1") - F.col("a_t0")).alias("bracket_high"))


def boundary_summary(on: Column, off: Column, hit: Column) -> list[Column]:
    """Medians, 95th percentiles and shares of late bounds of signed errors in ms, and misses."""
    out = [F.count("*").alias("n")]
    for name, error in (("onset", F.abs(on)), ("offset", F.abs(off))):
        out += [F.percentile(error, 0.5).alias(f"{name}_median"), F.percentile(error, 0.95).alias(f"{name}_p95"), F.avg((error > 500).cast("int")).alias(f"{name}_late")]
    return [*out, (F.count_if(F.abs(on) > 2000) + F.count_if(F.abs(off) > 2000)).alias("far"), F.count_if(~hit).alias("misses")]


def state_counts(rows: DataFrame, key: Sequence[str], state: str, states: Sequence[str]) -> DataFrame:
    """How many rows of a key are in each of the known states, and in any other."""
    known = [F.count_if(F.col(state) == s).alias(s) for s in states]
    return rows.groupBy(*key).agg(*known, F.count_if(~F.col(state).isin(*states) | F.col(state).isNull()).alias("other"))


def common_choices(rows: DataFrame, choice: str) -> DataFrame:
    """Choices with their counts and ranks, the most common first; ties go by the choice."""
    counts = rows.groupBy(choice).agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), choice)))


def pooled(*tables: DataFrame) -> DataFrame:
    """The rows of all tables, each once for every table that holds it; columns that one lacks are null (G1)."""
    out = tables[0]
    for other in tables[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def event_order(rows: DataFrame, key: Sequence[str], t: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``position`` by time and order, keys whose orders are not unique)."""
    doubled = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct(order).alias("orders")).where("n <> orders")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy(t, order))), doubled
