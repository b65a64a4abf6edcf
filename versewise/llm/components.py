"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versewise.llm.scratch import cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the least of u and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its lower neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    onto = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onto.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``; component is the least node of the connected set.

    Nodes without an edge to another node do not appear. Self-loops and repeated edges are ignored; nulls are
    dropped. A hub is never gathered: minima are combined before the shuffle and the joins can be split by AQE.
    Each round is cut to the shared folder. Raises if ``max_rounds`` does not suffice.
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state:
            break
        state = (seen.n, seen.h)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def linked_to(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, label)``: nodes with equal labels are connected; others may be so too.

    The least node within two steps: enough where most of a class is linked to one of its nodes. Not the whole
    work of ``connected_components``. A node without a row has itself as its label.
    """
    near = cut(_both_ways(edges.select("u", "v").where("u <> v").distinct()), "both")
    one = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return near.join(one.select(F.col("u").alias("v"), "m"), "v").groupBy(F.col("u").alias("node")).agg(F.min("m").alias("label"))
