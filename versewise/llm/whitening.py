"""Whitening of embeddings from an exact covariance, found by polarisation.

The square of a sum is (a + b)^2 = a^2 + 2ab + b^2, so cross-covariances are halves of differences of variances: those of every
dimension and of every sum of two dimensions. Entries are integers, so the squares are added up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versewise.llm.scratch import bound_batches, cut

#: Entries are multiples of 1 / SCALE; components that are returned; share of the trace below which an eigenvalue is none.
SCALE, COMPONENTS, LEAST_SHARE = 256, 4, 1e-12
#: Rows that are squared at a time, and the largest entry for which 64-bit halves of squares cannot overflow within them.
ROWS, SAFE = 1 << 10, 1 << 61


def finite(vector: Column) -> Column:
    """Neither the vector nor an entry is null, infinite or not a number."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))


def whole_entries(vector: Column, scale: int) -> Column:
    """Every entry c as the integer floor(scale * c), c as double."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def _rows(column, dims: int) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as 64-bit integers where those cannot overflow, else as Python integers."""
    most = n * (max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0) + max((abs(s) for s in sums), default=0)
    if most < SAFE:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def sum_of_squares(y: np.ndarray) -> list[int]:
    """Exact sums of squares down the columns of at most ``ROWS`` rows."""
    if y.dtype == object:
        return [int(v) for v in (y * y).sum(0)] if len(y) else [0] * y.shape[1]
    low, high = y & np.int64((1 << 26) - 1), y >> np.int64(26)  # y = high * 2^26 + low; high is below 2^36
    lowest, top = high & np.int64((1 << 18) - 1), high >> np.int64(18)  # high = top * 2^18 + lowest; top is below 2^18
    parts = [((low * low).sum(0), 0), ((low * lowest).sum(0), 27), ((low * top).sum(0), 45), ((lowest * lowest).sum(0), 52), ((lowest * top).sum(0), 71), ((top * top).sum(0), 88)]
    return [sum(int(p[j]) << k for p, k in parts) for j in range(y.shape[1])]


def _polarised(dims: int, n: int, sums: list[int]):
    """Vectors -> exact sums of (n x_i - S_i)^2 as pair (i, i) and of ((n x_i - S_i) + (n x_j - S_j))^2 as pair (i, j)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: dict[tuple[int, int], int] = {}
        for b in batches:
            x = _rows(b["x"], dims)
            for at in range(0, len(x), ROWS):
                y = centred(x[at : at + ROWS], n, sums)
                for i in range(dims):
                    sums_of = np.concatenate((y[:, i : i + 1], y[:, i : i + 1] + y[:, i + 1 :]), 1)
                    for j, q in enumerate(sum_of_squares(sums_of), i):
                        total[i, j] = total.get((i, j), 0) + q
        pairs = sorted(total)
        # exact sums exceed 64 bits: three decimal limbs, summed apart
        limbs = [[total[p] // 10**30 for p in pairs], [total[p] // 10**15 % 10**15 for p in pairs], [total[p] % 10**15 for p in pairs]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.int32()), *[pa.array([Decimal(v) for v in limb], pa.decimal128(38, 0)) for limb in limbs]], names=["i", "j", "q2", "q1", "q0"])

    return run


def polarised_covariance(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """``fit(x: array<bigint>)`` -> n, per-dimension sums S, and the integers n^3 * V of the covariance V (divisor n), exact."""
    sums = fit.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n, s = sums[0].n, [int(r.s) for r in sorted(sums, key=lambda r: r.d)]
    parts = fit.mapInArrow(_polarised(dims, n, s), "i int, j int, q2 decimal(38,0), q1 decimal(38,0), q0 decimal(38,0)")
    q = {(r.i, r.j): int(r.q2) * 10**30 + int(r.q1) * 10**15 + int(r.q0) for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("q2", "q1", "q0")]).collect()}
    return n, s, [[q[i, i] if i == j else (q[min(i, j), max(i, j)] - q[i, i] - q[j, j]) // 2 for j in range(dims)] for i in range(dims)]


def principal_components(n: int, cubed: list[list[int]], most: int = COMPONENTS) -> tuple[list[float], np.ndarray, float]:
    """Falling eigenvalues, unit eigenvectors (columns; the largest entry of each is positive) and the trace, from n^3 * V."""
    v = np.array([[float(Fraction(c, n**3)) for c in row] for row in cubed])
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    return [float(e) for e in values], vectors, float(np.trace(v))


def _projected(dims: int, n: int, sums: list[int], values: list[float], vectors: np.ndarray, least: float):
    """Adds to vectors: dev (exact, decimal, null beyond 38 digits) and w (whitened coordinates, null for null components)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = _rows(b["x"], dims)
            y = centred(x, n, sums)
            dev = [sum(d) for d in zip(*(sum_of_squares(y[:, at : at + ROWS].T) for at in range(0, dims, ROWS)))]
            w = (y.astype(float) / n) @ vectors
            good = [e > least for e in values]
            rows = [[float(v) / e**0.5 if ok else None for v, e, ok in zip(row, values, good)] for row in w]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([Decimal(d) if d < 10**38 else None for d in dev], pa.decimal128(38, 0)), pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names, "dev", "w"])

    return run


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or has a null or non-finite entry are left out, and those whose length is not the commonest one
    (of equally common ones the longest). Entries become integers (``SCALE``); each different vector counts once in the fit (n of
    them), however often it is repeated; repeated rows are returned as often as they come. ``deviation`` is the sum over dimensions
    of (n x - S)^2, exact; null where it does not fit in 64 bits, ``deviation_exact`` has up to 38 digits. Components whose
    eigenvalue is no more than ``LEAST_SHARE`` of the trace have whitened null and are not in ``identity_error``, the largest entry
    of the covariance of the whitened fit vectors minus the identity (null without components). Empty tables give no rows; columns
    other than key and vector do not matter.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    schema = "key " + vectors.select(F.col(f"`{key}`")).schema[0].dataType.simpleString() + ", x array<bigint>"
    rows = cut(vectors.where(finite(F.col(f"`{vector}`"))).select(F.col(f"`{key}`").alias("key"), whole_entries(F.col(f"`{vector}`"), SCALE).alias("x")), "whole-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = lengths.d if lengths else 0
    out = f"{vectors.select(F.col(f'`{key}`')).schema.simpleString()[7:-1].replace(':', ' ', 1)}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if not dims:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("x") == dims)
    fit = cut(rows.select("x").distinct(), "fit-vectors")
    n, sums, cubed = polarised_covariance(fit, dims)
    values, axes, trace = principal_components(n, cubed, min(components, dims))
    least = LEAST_SHARE * trace
    project = _projected(dims, n, sums, values, axes, least)
    k = sum(e > least for e in values)
    error = None
    if k:
        white = fit.mapInArrow(project, "x array<bigint>, dev decimal(38,0), w array<double>")
        w = [F.col("w")[i] for i in range(k)]
        means = white.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        cov = white.agg(*[F.avg((w[i] - means[i]) * (w[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    found = rows.mapInArrow(project, schema + ", dev decimal(38,0), w array<double>")
    share = F.array(*[F.lit(e / trace if trace else 0.0) for e in values])
    each = found.select("key", "dev", F.posexplode("w").alias("c", "whitened"))
    fits = F.when(F.col("dev") < Decimal(1 << 63), F.col("dev")).cast("long")
    return each.select(F.col("key").alias(key), (F.col("c") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), fits.alias("deviation"), "whitened", share[F.col("c")].alias("explained"), F.lit(error).cast("double").alias("identity_error"), F.col("dev").alias("deviation_exact"))
