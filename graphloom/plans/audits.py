"""Queries of integrity audits and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import audits as A
from graphloom.plans.registry import query


@query("relation_audit_duplicates", "SELECT from_id, to_id, count(*) AS n FROM relation_raw GROUP BY from_id, to_id HAVING count(*) > 1")
def relation_audit_duplicates(g):
    return A.duplicate_groups(g.relation_raw, ["from_id", "to_id"])


@query("relation_audit_dangling", """
kept AS (SELECT id FROM entity WHERE id % 10 <> 3);;
SELECT from_id, to_id, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'from+to' WHEN a.id IS NULL THEN 'from' ELSE 'to' END AS missing
FROM relation LEFT JOIN kept a ON a.id = from_id LEFT JOIN kept b ON b.id = to_id WHERE a.id IS NULL OR b.id IS NULL""")
def relation_audit_dangling(g):
    """Audited against a graph that has lost every entity whose id ends in 3."""
    return A.dangling(g.relation, g.entity.filter(F.col("id") % 10 != 3))


@query("relation_audit_drift", """
stored AS (SELECT from_id AS id, count(*) AS n FROM relation_raw GROUP BY from_id), counted AS (SELECT from_id AS id, count(*) AS n FROM relation GROUP BY from_id);;
SELECT id, coalesce(s.n, 0) AS stored, coalesce(c.n, 0) AS counted FROM stored s FULL JOIN counted c USING (id) WHERE coalesce(s.n, 0) <> coalesce(c.n, 0)""")
def relation_audit_drift(g):
    """Degrees counted with repeated rows against those of distinct relations."""
    count = lambda df: df.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return A.counter_drift(count(g.relation_raw), count(g.relation), "id")


@query("relation_repair_keepers", """
SELECT from_id, to_id, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY from_id, to_id ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS place FROM relation_raw) WHERE place = 1""")
def relation_repair_keepers(g):
    kept = A.keepers(g.relation_raw.drop("row_key"), ["from_id", "to_id"], ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return kept.select("from_id", "to_id", "l_orderkey", "l_linenumber")


@query("degree_hubs", "SELECT from_id AS id, count(DISTINCT to_id) AS n FROM relation GROUP BY from_id ORDER BY n DESC, id LIMIT 20")
def degree_hubs(g):
    """Top entities by distinct outgoing neighbours: the input of the search boost."""
    return g.relation.groupBy(F.col("from_id").alias("id")).agg(F.count_distinct("to_id").alias("n")).orderBy(F.desc("n"), "id").limit(20)


