"""Exact order statistics of groups of any size: values are sorted over ranges, never a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.streaming.replay import shared_folder

#: Equal values count once. Rows of a range of the sorted table at most, about; ranges at least, where there is more than one.
SORTED, PARTS = 200_000, 256


def values_at(rows: DataFrame, key: Sequence[str], value: str, ranks: Callable[[Column], list[Column]], most: int = SORTED, parts: int = PARTS) -> DataFrame:
    """``(key..., n, at)``: ``at`` holds the values at ``ranks(n)`` (from 0) of each group in ascending order; nulls are left out.

    Different values of all groups, with their counts, are sorted once over ranges of about ``most`` rows (``parts`` ranges at
    least beyond one), so a large group lies over many. Ranges are counted, and only those that hold a wanted rank are read again.
    Counting combines before the shuffle; of equal values only the number is kept. Ranks outside 0..n-1 give null.
    """
    spark, named, k = rows.sparkSession, list(key), "_k"  # one struct, so that null keys are keys too
    held = rows.where(F.col(value).isNotNull()).select(F.struct(*named).alias(k) if named else F.lit(0).alias(k), F.col(value).alias("_v"))
    folder = shared_folder(spark, "values")
    counts = _stored(held.groupBy(k, "_v").agg(F.count("*").alias("_c")), f"{folder}/counts")
    different = counts.count()
    ranges = 1 if different <= most else max(parts, -(-different // most))
    ranged = _stored(counts.repartitionByRange(ranges, k, "_v").withColumn("_part", F.spark_partition_id()), f"{folder}/ranges")
    sums = ranged.groupBy(k, "_part").agg(F.sum("_c").alias("_of"))
    all_of = Window.partitionBy(k)
    sums = sums.withColumns({"_before": F.sum("_of").over(all_of.orderBy("_part")) - F.col("_of"), "n": F.sum("_of").over(all_of)})
    wanted = sums.groupBy(k).agg(F.max("n").alias("n")).select(k, "n", F.posexplode(F.array(*[r.cast("long") for r in ranks(F.col("n"))])).alias("_i", "_rank"))
    inside = wanted.select(k, "_rank").distinct().join(sums.drop("n"), k).where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_of")))
    inside = inside.select(k, "_part", "_rank", (F.col("_rank") - F.col("_before")).alias("_left"))
    upto = F.sum("_c").over(Window.partitionBy("_part", k).orderBy("_v"))
    read = ranged.join(inside.select(k, "_part").distinct(), [k, "_part"], "left_semi").withColumn("_upto", upto)
    found = inside.join(read, [k, "_part"]).where((F.col("_left") >= F.col("_upto") - F.col("_c")) & (F.col("_left") < F.col("_upto"))).select(k, "_rank", "_v")
    return wanted.join(found, [k, "_rank"], "left").groupBy(k, "n").agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("at")).select(*[f"{k}.{c}" for c in named], "n", F.transform("at", lambda x: x["_v"]).alias("at"))


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """Rows written to the shared folder and read back, so that no use of them computes them again."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def interpolated(n: Column, q: float) -> list[Column]:
    """The two ranks between which the interpolated percentile of n values lies."""
    at = F.lit(q) * (n - 1)
    return [F.floor(at), F.ceil(at)]


def between(at: Column, first: int, n: Column, q: float) -> Column:
    """The interpolated percentile from the values at ``interpolated`` ranks, which begin at ``first`` of ``at``."""
    place = F.lit(q) * (n - 1)
    low, high = F.get(at, F.lit(first)).cast("double"), F.get(at, F.lit(first + 1)).cast("double")
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


def percentiles(rows: DataFrame, key: Sequence[str], value: str, qs: dict[str, float], **how) -> DataFrame:
    """``(key..., n, a column a percentile)``: exact interpolated percentiles (D18 and the medians of the summaries)."""
    found = values_at(rows, key, value, lambda n: [r for q in qs.values() for r in interpolated(n, q)], **how)
    return found.select(*key, "n", *[between(F.col("at"), 2 * i, F.col("n"), q).alias(name) for i, (name, q) in enumerate(qs.items())])
