"""Mixing sources to target weights by the cube method of balanced sampling."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from versewise.llm.scratch import cut

#: The sources' table is broadcast up to this many rows; beyond, the join on the source shuffles.
BROADCAST_SOURCES = 100_000


def word_count(text: str = "text"):
    """Number of maximal runs of characters other than space, tab, LF, VT, FF and CR; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)``, or ``(source, size, n)`` where n rows are equal.

    Sources by code point, null last, take the weights in turn. All sizes are shared by weight; a target stops at
    ``most`` times its source's size and the excess is shared by weight among the others until none is above.
    That is one level ``x`` with target = min(cap, weight * x): with sources by cap / weight, the capped ones are
    a prefix, found with running sums over the table of sources (one row each).
    """
    many = F.col("n") if "n" in sized.columns else F.lit(1)
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * many).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    named = totals.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    running = named.withColumns({
        "capped_sum": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "whole": F.sum("source_size").over(everything),
    })
    level = running.withColumn("level", (F.col("whole") - F.col("capped_sum")) / F.col("weight_left"))
    open_ = F.col("cap") >= F.col("weight") * F.col("level")
    level = level.withColumn("x", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    target = F.when(F.col("x").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("x")))
    return level.select("source", "source_size", target.alias("target"))


def flight(chances: list[float], sizes: list[float], rng: random.Random, eps: float = 1e-9) -> list[float]:
    """The flight phase for two balancing variables, documents and tokens.

    Three units with open chances are moved at a time along the direction that leaves the sums of ``x`` and of
    ``x * size`` unchanged (the null space of the 2 x 3 constraints), up or down with the odds that keep every
    unit's expectation, until one of them reaches 0 or 1. At most two units stay open.
    """
    x = list(chances)
    waiting = [i for i in range(len(x)) if eps < x[i] < 1 - eps]
    for i in range(len(x)):
        if not eps < x[i] < 1 - eps:
            x[i] = float(round(x[i]))
    waiting.reverse()
    held: list[int] = []
    while True:
        while len(held) < 3 and waiting:
            held.append(waiting.pop())
        if len(held) < 3:
            if len(held) == 2 and sizes[held[0]] == sizes[held[1]]:
                step = (1.0, -1.0)
            else:
                return x
        else:
            a, b, c = (sizes[i] for i in held)
            step = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        up = min(((1 - x[i]) if u > 0 else x[i]) / abs(u) for i, u in zip(held, step) if u)
        down = min((x[i] if u > 0 else (1 - x[i])) / abs(u) for i, u in zip(held, step) if u)
        move = up if rng.random() * (up + down) < down else -down
        for i, u in zip(held, step):
            x[i] += move * u
            if x[i] <= eps or x[i] >= 1 - eps:
                x[i] = float(round(x[i]))
        held = [i for i in held if 0.0 < x[i] < 1.0]


#: Units of the landing problem that are kept out of the last flight, spread over the sizes.
RESERVE = 14


def landing(x: list[float], sizes: list[float]) -> list[float]:
    """Settle the open units (at most RESERVE and two more) in the way that keeps both sums nearest.

    All ways are weighed: the miss in tokens, then the miss in documents at a tenth of the mean size.
    """
    left = [i for i, v in enumerate(x) if 0.0 < v < 1.0]
    if not left:
        return x
    chance, size = np.array([x[i] for i in left]), np.array([sizes[i] for i in left])
    ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    miss = np.abs((ways - chance) @ size) + 0.1 * size.mean() * np.abs((ways - chance).sum(axis=1))
    out = list(x)
    for i, v in zip(left, ways[int(miss.argmin())]):
        out[i] = float(v)
    return out


def reserve(x: list[float], sizes: list[float]) -> list[int]:
    """The open units, evenly spread over the order of sizes, that wait for the landing."""
    open_ = sorted((i for i, v in enumerate(x) if 0.0 < v < 1.0), key=lambda i: sizes[i])
    n = min(RESERVE, len(open_))
    return [open_[(2 * k + 1) * len(open_) // (2 * n)] for k in range(n)]


def _order(names: Sequence[str]) -> list[str]:
    """What tells units apart: rows that agree in it are alike."""
    return [c for c in ("doc_id", "text_key", "size") if c in names]


def _settler(seed: int, turn: int):
    """The grouped function of one round: a block's flight, and the landing where a source is one block."""

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_order(rows.columns), kind="stable", na_position="last").reset_index(drop=True)
        rng = random.Random(f"{seed}/{turn}/{key[0]}/{key[1]}")
        order = list(range(len(rows)))
        rng.shuffle(order)
        size = [float(rows["size"].iat[i]) for i in order]
        x = [float(rows["x"].iat[i]) for i in order]
        if int(rows["parts"].iat[0]) > 1:
            x = flight(x, size, rng)
        else:
            kept = set(reserve(x, size))
            flown = [i for i in range(len(x)) if i not in kept]
            for i, v in zip(flown, flight([x[i] for i in flown], [size[i] for i in flown], rng)):
                x[i] = v
            x = landing(x, size)
        out = rows["x"].to_numpy().copy()
        out[order] = x
        return rows.assign(x=out)

    return settle


def cube_sample(units: DataFrame, seed: int = 7, block: int = 4000, max_rounds: int = 12) -> DataFrame:
    """Balanced sample of ``units(doc_id, source, size, chance, ...)``: adds ``picked`` (0 or 1).

    Every source is dealt by a hash over blocks of about ``block`` units; a flight in each block leaves at most two
    open units, which go on to the next round, until one block a source holds all that is open and the landing
    settles it. A block's sums are kept by its flight, so a source's are kept by all. Blocks are bounded
    whatever a source's share of the rows; each round is cut to the shared folder. Reruns agree: the draws are
    seeded by source, block and round, over units in the order of doc_id, ``text_key`` (if there is one) and size, so units
    should differ in those: see ``mix_sources``, which combines equal rows.
    """
    names = units.columns
    settled, open_ = None, units.withColumn("x", F.col("chance"))
    for turn in range(max_rounds):
        per = open_.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("open_n"))
        open_ = open_.join(F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per, open_.source.eqNullSafe(per.s)).drop("s")
        parts = F.ceil(F.col("open_n") / F.lit(block)).cast("long")
        open_ = open_.withColumns({"parts": parts, "block": F.pmod(F.xxhash64(F.lit(seed + turn), *_order(names)), parts)}).drop("open_n")

        moved = cut(open_.groupBy("source", "block").applyInPandas(_settler(seed, turn), open_.schema), "cube").drop("parts", "block")
        done = moved.where("x <= 0 or x >= 1")
        settled = done if settled is None else settled.union(done)
        open_ = moved.where("x > 0 and x < 1")
        if not open_.take(1):
            return settled.select(*names, F.col("x").cast("int").alias("picked"))
    raise RuntimeError("the landing did not end")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, text_key, source, size, source_size, target, copies, taken)``: one row per input row.

    A source whose target is m times its size takes every document floor(m) times and, with chance m - floor(m),
    once more; the extra copies are a balanced sample. No document is taken more than ``most`` (rounded up)
    times. ``text_key`` is a hash of the text, to join back by. Null text has size 0; a source of size 0 takes
    nothing; an empty table gives an empty result. Rows that agree in id, text and source are one unit, however many there
    are: n of them take n times the chance, its whole part surely, and the first of them have the copies.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    sized = cut(sized.groupBy("doc_id", "text_key", "source", "size").agg(F.count("*").alias("n")), "sized")
    targets = cut(source_targets(sized, weights, most), "targets").withColumnRenamed("source", "s")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    each = F.col("times") - F.floor("times")
    units = sized.join(targets, sized.source.eqNullSafe(F.col("s"))).drop("s").withColumn("times", times).withColumns({"whole": F.floor("times").cast("int"), "sure": F.floor(each * F.col("n")).cast("long")})
    picked = cube_sample(units.withColumn("chance", each * F.col("n") - F.col("sure")), seed)
    rows = picked.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.col("whole") + (F.col("k") <= F.col("sure") + F.col("picked")).cast("int")
    return rows.select("doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
