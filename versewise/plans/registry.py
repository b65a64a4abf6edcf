"""Registry of queries over the driver's tables, each with the SQL that states its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(spark, sf_dir)`` under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str):
    """Microseconds since 1970 of a timestamp's wall-clock fields, whatever the session's time zone."""
    return F.expr(f"datediff({ts}, date'1970-01-01') * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + cast(extract(second from {ts}) * 1000000 as bigint)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("t"), "value")


def intervals(rows: DataFrame, *types: str) -> DataFrame:
    """``[t, t + value minutes)`` of events of the given types."""
    rows = rows.where(F.col("event_type").isin(*types)) if types else rows
    return rows.select("user_id", "event_id", "event_type", F.col("t").alias("begin"), (F.col("t") + F.floor(F.col("value") * 60000000)).alias("end")).where("begin < end")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, line_no, line)`` of documents, line numbers from 1."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "line")


EV = "ev AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, value FROM events)"
IV = 'iv AS (SELECT user_id, event_id, event_type, t AS "begin", t + CAST(floor(value * 60000000) AS BIGINT) AS "end" FROM ev WHERE floor(value * 60000000) > 0)'
LINES = "ln AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, s[i] AS line FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))"
HOUR = 3_600_000_000
MONTH = (1_704_067_200_000_000, 1_706_745_600_000_000)


def merged_sql(source: str, name: str, where: str = "true") -> str:
    """SQL of the union of intervals of ``source(user_id, begin, end)``."""
    return f'''{name} AS (SELECT user_id, min("begin") AS "begin", max("end") AS "end" FROM (
        SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY "begin", "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
        SELECT *, CASE WHEN "begin" <= max("end") OVER (PARTITION BY user_id ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
        FROM {source} WHERE {where})) GROUP BY user_id, g)'''


def sweep_sql(left: str, right: str, name: str, keep: str) -> str:
    """SQL of the pieces of two interval sets where ``keep`` holds of the depths l and r, merged."""
    at = f'''SELECT user_id, t, sum(l) AS l, sum(r) AS r FROM (SELECT user_id, "begin" AS t, 1 AS l, 0 AS r FROM {left} UNION ALL SELECT user_id, "end", -1, 0 FROM {left}
        UNION ALL SELECT user_id, "begin", 0, 1 FROM {right} UNION ALL SELECT user_id, "end", 0, -1 FROM {right}) GROUP BY user_id, t'''
    pieces = f'''{name}_p AS (SELECT * FROM (SELECT user_id, t AS "begin", lead(t) OVER w AS "end", sum(l) OVER w AS l, sum(r) OVER w AS r FROM ({at}) WINDOW w AS (PARTITION BY user_id ORDER BY t)) WHERE {keep} AND "end" IS NOT NULL)'''
    return pieces + ", " + merged_sql(f"{name}_p", name)
