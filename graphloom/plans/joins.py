"""Queries of interval joins: the smallest interval around a point."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import joins as J
from graphloom.plans.registry import query

_SIZE, _STEP = 1600, 777


@query("enclosing_segment", f"""
p AS (SELECT doc_id, unnest(range(0, CAST(length(text) AS BIGINT), {_STEP})) AS spot FROM documents),
s AS (SELECT doc_id, unnest(range(0, CAST(length(text) AS BIGINT), {_SIZE})) AS low, CAST(length(text) AS BIGINT) AS n FROM documents),
i AS (SELECT doc_id, low, least(low + {_SIZE}, n) - 1 AS high, 'segment' AS name FROM s UNION ALL SELECT doc_id, 0, CAST(length(text) AS BIGINT) - 1, 'whole' FROM documents WHERE length(text) > 0),
r AS (SELECT p.doc_id, spot, low, high, name, row_number() OVER (PARTITION BY p.doc_id, spot ORDER BY high - low, low, name) AS k FROM p JOIN i ON i.doc_id = p.doc_id AND spot BETWEEN low AND high);;
SELECT doc_id, spot, low, high, name FROM r WHERE k = 1""")
def enclosing_segment(g):
    """The segment around every 777th character of each document, which stands in an interval over all of it too."""
    d = g.table("documents").select("doc_id", F.length("text").cast("long").alias("n")).filter("n > 0")
    points = d.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_STEP).cast("long"))).alias("spot"))
    cuts = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_SIZE).cast("long"))).alias("low"))
    intervals = cuts.select("doc_id", "low", (F.least(F.col("low") + _SIZE, F.col("n")) - 1).alias("high"), F.lit("segment").alias("name"))
    intervals = intervals.union(d.select("doc_id", F.lit(0).cast("long"), F.col("n") - 1, F.lit("whole")))
    return J.smallest_around(points, intervals, ["doc_id"], [], "spot", "low", "high", "name")


@query("enclosing_order", """
p AS (SELECT event_id, user_id AS custkey, CAST(date_part('doy', ts) AS BIGINT) AS spot FROM events),
i AS (SELECT o_custkey AS custkey, CAST(date_part('doy', o_orderdate) AS BIGINT) AS low, CAST(5 + o_orderkey % 90 AS BIGINT) AS days, o_orderkey AS name FROM orders),
r AS (SELECT p.*, low, low + days AS high, name, row_number() OVER (PARTITION BY event_id ORDER BY days, low, name) AS k FROM p JOIN i ON i.custkey = p.custkey AND spot BETWEEN low AND low + days);;
SELECT custkey, event_id, spot, low, high, name FROM r WHERE k = 1""")
def enclosing_order(g):
    """Of each customer's events, the order with the shortest window (5 to 94 days) around its day of the year."""
    day = lambda c: F.dayofyear(c).cast("long")
    points = g.table("events").select("event_id", F.col("user_id").alias("custkey"), day("ts").alias("spot"))
    o = g.table("orders").select(F.col("o_custkey").alias("custkey"), day("o_orderdate").alias("low"), F.col("o_orderkey").alias("name"))
    intervals = o.select("custkey", "low", (F.col("low") + 5 + F.col("name") % 90).alias("high"), "name")
    return J.smallest_around(points, intervals, ["custkey"], ["event_id"], "spot", "low", "high", "name")
