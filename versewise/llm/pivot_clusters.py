"""Centroid clustering of integer vectors with a pivot table (LAESA), in exact arithmetic.

Distances of every vector to a few fixed pivots are computed once and stored beside it. In each round |d(v, p) - d(c, p)| over
the pivots p is a lower bound of d(v, c); centroids whose bound exceeds the distance to one that is already known are left
out, the others get their exact integer distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewise.llm.scratch import bound_batches, cut
from versewise.llm.whitening import _rows, finite, whole_entries

DIMS, SCALE, CENTROIDS, ROUNDS, PIVOTS, SEED = 64, 64, 16, 3, 8, 1
#: Entries below this have squared distances that fit in 64 bits (of up to 512 dimensions); others are counted in Python integers.
SAFE = 1 << 26
#: Relative room for rounding of the stored distances, which are doubles: bounds are taken this much lower.
ROOM = 1e-9


def squared_distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one vector: 64-bit integers, or Python integers where entries are large."""
    if x.size and max(abs(int(x.max())), abs(int(x.min())), abs(int(to.max())), abs(int(to.min()))) >= SAFE:
        x, to = x.astype(object), to.astype(object)
    apart = x - to
    return (apart * apart).sum(1)


def _with_pivots(pivots: list[list[int]]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = _rows(b["x"], len(pivots[0]))
            far = np.stack([np.sqrt(squared_distances(x, np.array(p)).astype(float)) for p in pivots], 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.FixedSizeListArray.from_arrays(pa.array(far.ravel()), len(pivots)).cast(pa.list_(pa.float64()))], names=[*b.schema.names, "far"])

    return run


def nearest_centroids(x: np.ndarray, far: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, the smaller of equals; exact squared distance; distances that were computed)."""
    apart = np.sqrt(np.stack([squared_distances(centroids, p).astype(float) for p in pivots], 1))  # centroid x pivot
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(far[:, p : p + 1] - apart[None, :, p]) - ROOM * (far[:, p : p + 1] + apart[None, :, p]), out=bound)
    best, which, known, done = None, np.full(len(x), -1), np.full(len(x), np.inf), 0
    rows = np.arange(len(x))
    order = np.argsort(bound, 1, kind="stable")
    for k in range(len(centroids)):  # each row in the order of its bounds
        rows = rows[bound[rows, order[rows, k]] <= known[rows]]
        if not len(rows):
            break
        at = order[rows, k]
        for c in np.unique(at):
            of = rows[at == c]
            d = squared_distances(x[of], centroids[c])
            done += len(of)
            if best is None:
                best = np.zeros(len(x), d.dtype)
            elif d.dtype == object and best.dtype != object:
                best = best.astype(object)
            nearer = (which[of] < 0) | (d < best[of]) | ((d == best[of]) & (c < which[of]))
            won = of[nearer]
            best[won], which[won] = d[nearer], c
            known[won] = np.sqrt(d[nearer].astype(float)) * (1 + ROOM)
    return which, best if best is not None else np.zeros(0, np.int64), done


def _sums(centroids: list[list[int]], pivots: list[list[int]]):
    """Vectors -> per cluster: rows, sum of each component (list of decimals)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c, p = np.array(centroids), np.array(pivots)
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, object)
        for b in batches:
            x = _rows(b["x"], c.shape[1])
            which, _, _ = nearest_centroids(x, _rows(b["far"], len(p)), c, p)
            big = len(x) and max(abs(int(x.max())), abs(int(x.min()))) >= SAFE
            for k in np.unique(which):
                mine = x[which == k]
                count[k] += len(mine)
                total[k] += (mine.astype(object) if big else mine).sum(0).astype(object)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array([[Decimal(int(v)) for v in total[k]] for k in some], pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: list[list[int]], pivots: list[list[int]]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        c, p = np.array(centroids), np.array(pivots)
        for b in batches:
            which, best, _ = nearest_centroids(_rows(b["x"], c.shape[1]), _rows(b["far"], len(p)), c, p)
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(which.astype(np.int32)), pa.array([Decimal(int(d)) if d < 10**38 else None for d in best], pa.decimal128(38, 0))], names=["key", "cluster", "d"])

    return run


def pivot_table(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", dims: int = DIMS, scale: int = SCALE, pivots: int = PIVOTS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """Usable vectors as rows (key, x, far: distances to the pivots), written once, and the pivots.

    Pivots are the vectors at the end of the order in which centroids are chosen (see ``choose``): any set of vectors is right.
    """
    rows = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).where((F.size("v") == dims) & finite(F.col("v"))).select("key", whole_entries(F.col("v"), scale).alias("x"))
    fixed = [list(r.x) for r in choose(rows, pivots, seed, last=True)] or [[0] * dims]
    kind = rows.schema["key"].dataType.simpleString()
    return cut(rows.mapInArrow(_with_pivots(fixed), f"key {kind}, x array<bigint>, far array<double>"), "pivot-table"), fixed


def choose(rows: DataFrame, n: int, seed: int, last: bool = False) -> list:
    """The n rows with the smallest (or largest) sha256 of ``seed:key``; equal keys in order of their vectors."""
    mark = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), F.lit("null"))), 256)
    return rows.withColumn("mark", mark).orderBy(F.desc("mark") if last else "mark", "x").limit(n).collect()


def cluster_centroids(table: DataFrame, pivots: list[list[int]], k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> list[list[int]]:
    """Centroids after ``rounds`` of nearest assignment and componentwise floor(sum / count); k vectors are seen by the driver."""
    centroids = [list(r.x) for r in choose(table.select("key", "x"), k, seed)]
    for _ in range(rounds if centroids else 0):
        parts = table.mapInArrow(_sums(centroids, pivots), "cluster int, n long, sums array<decimal(38,0)>")
        each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        for r in each.collect():
            centroids[r.cluster][r.i] = int(r.s) // r.n
    return centroids


def pivot_clusters(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", dims: int = DIMS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS, seed: int = SEED) -> DataFrame:
    """A row a usable vector: key, cluster, distance (squared), cluster_inertia, inertia, centroid (array of integers).

    Vectors that are null, of another length, or have null or non-finite entries are left out; components become floor(scale * x).
    The first k vectors by sha256 of ``seed:key`` are the first centroids (fewer vectors: fewer centroids; equal keys in order of
    their vectors). Distances tie to the smaller number; empty clusters keep their centroid; repeated rows count as often as they
    come. An empty table gives no rows; further columns do not matter. Distances and sums beyond 64 bits are null.
    """
    bound_batches(vectors.sparkSession)
    table, fixed = pivot_table(vectors, vector, key, dims, scale, pivots, seed)
    centroids = cluster_centroids(table, fixed, k, rounds, seed) or [[0] * dims]
    kind = table.schema["key"].dataType.simpleString()
    rows = cut(table.mapInArrow(_assigned(centroids, fixed), f"key {kind}, cluster int, d decimal(38,0)"), "assigned")
    long = lambda c: F.when(c < F.lit(Decimal(1 << 63)), c).cast("long")
    # a distance of more than 38 digits makes its sums null
    sums = F.when(F.count("d") == F.count("*"), F.sum("d"))
    each = {r.cluster: r.s for r in rows.groupBy("cluster").agg(sums.alias("s")).collect()}
    whole = None if None in each.values() else sum(each.values(), Decimal(0))
    spark = vectors.sparkSession
    known = F.broadcast(spark.createDataFrame([(c, each.get(c), whole, v) for c, v in enumerate(centroids)], "cluster int, ci decimal(38,0), i decimal(38,0), centroid array<bigint>"))
    return rows.join(known, "cluster").select(F.col("key").alias(key), "cluster", long(F.col("d")).alias("distance"), long(F.col("ci")).alias("cluster_inertia"), long(F.col("i")).alias("inertia"), "centroid")
