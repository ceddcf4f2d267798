"""Queries of lookups, paging, relation search, export and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import reads as R
from graphloom.plans.registry import also, query

NAMES = ["ASIA", "Part#000000007", "doc:3", "no such name", "Part#000000007", "EUROPE"]
_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES))
_NAMES_SQL = f" names AS (SELECT CAST(pos AS BIGINT) AS pos, name FROM (VALUES {_VALUES}) AS v(pos, name));;"
DESCRIBED = [("entity", "part", "an article"), ("entity", "planet", "unused so far"), ("relation", "bought", "customer bought part")]


def _names(g):
    return R.names_frame(g.spark, NAMES)


@query("type_counts", "SELECT 'entity' AS kind, entity_type AS name, count(*) AS n FROM entity GROUP BY entity_type UNION ALL SELECT 'relation', relation_type, count(*) FROM relation GROUP BY relation_type")
def type_counts(g):
    return R.type_counts(g.entity, g.relation)


@query("type_catalog", """
described AS (SELECT * FROM (VALUES ('entity', 'part', 'an article'), ('entity', 'planet', 'unused so far'), ('relation', 'bought', 'customer bought part')) AS v(kind, name, description)),
counts AS (SELECT 'entity' AS kind, entity_type AS name, count(*) AS n FROM entity GROUP BY entity_type UNION ALL SELECT 'relation', relation_type, count(*) FROM relation GROUP BY relation_type);;
SELECT kind, name, coalesce(n, 0) AS n, description FROM counts FULL JOIN described USING (kind, name)""")
def type_catalog(g):
    return R.type_catalog(R.type_counts(g.entity, g.relation), g.spark.createDataFrame(DESCRIBED, "kind string, name string, description string"))


@query("graph_stats", "SELECT 'entities' AS key, count(*) AS n FROM entity UNION ALL SELECT 'relations', count(*) FROM relation UNION ALL SELECT 'observations', count(*) FROM observation")
def graph_stats(g):
    return R.graph_stats(g.entity, g.relation, g.observation)


@query("degree_in_out", """
ends AS (SELECT from_id AS id, 1 AS o, 0 AS i FROM relation UNION ALL SELECT to_id, 0, 1 FROM relation);;
SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM ends GROUP BY id""")
def degree_in_out(g):
    return R.degrees(g.relation)


@query("read_graph_page_entities", """
p AS (SELECT * FROM entity ORDER BY id LIMIT 200 OFFSET 20), o AS (SELECT entity_id, count(*) AS n FROM observation GROUP BY entity_id);;
SELECT id, name, entity_type, coalesce(n, 0) AS n_observations FROM p LEFT JOIN o ON entity_id = id""")
def read_graph_page_entities(g):
    return R.page_with_sizes(g.entity, g.observation, 20, 200)


@query("read_graph_page_relations", """
p AS (SELECT id FROM entity ORDER BY id LIMIT 500);;
SELECT * FROM relation WHERE from_id IN (SELECT id FROM p) AND to_id IN (SELECT id FROM p)""")
def read_graph_page_relations(g):
    return R.inside(g.relation, R.page(g.entity, 0, 500))


@query("read_graph_typed_page", "SELECT id, name, entity_type FROM entity WHERE entity_type = 'part' ORDER BY id LIMIT 50 OFFSET 10")
def read_graph_typed_page(g):
    return R.page(g.entity, 10, 50, "part")


@query("open_nodes_entities", _NAMES_SQL + "SELECT id, name, entity_type FROM entity WHERE name IN (SELECT name FROM names)")
def open_nodes_entities(g):
    return R.lookup(g.entity_by_name, _names(g)).select("id", "name", "entity_type")


@query("open_nodes_relations", _NAMES_SQL.replace(";;", ", ids AS (SELECT id FROM entity WHERE name IN (SELECT name FROM names));;") + "SELECT DISTINCT * FROM relation WHERE from_id IN (SELECT id FROM ids) OR to_id IN (SELECT id FROM ids)")
def open_nodes_relations(g):
    return R.touching(g.relation, R.lookup(g.entity_by_name, _names(g)), g.relation_in)


@query("entities_exist", _NAMES_SQL + 'SELECT pos, name, name IN (SELECT name FROM entity) AS "exists" FROM names')
def entities_exist(g):
    return R.exists(g.entity_by_name, _names(g))


@query("batch_get_entities", _NAMES_SQL + """
SELECT pos, n.name, e.id, e.entity_type, CASE WHEN e.id IS NOT NULL THEN (SELECT count(*) FROM observation WHERE entity_id = e.id) END AS n_observations
FROM names n LEFT JOIN entity e ON e.name = n.name""")
def batch_get_entities(g):
    return R.batch_get(g.entity_by_name, g.observation, _names(g))


@query("get_entity_observations", "SELECT entity_id, string_agg(body, '|' ORDER BY idx) AS bodies FROM observation GROUP BY entity_id")
def get_entity_observations(g):
    return R.ordered_bodies(g.observation).select("entity_id", R.joined(F.col("bodies")).alias("bodies"))


@query("describe_entity_neighbors", _NAMES_SQL.replace(";;", ", ids AS (SELECT id FROM entity WHERE name IN (SELECT name FROM names)), ends AS (SELECT from_id AS id, to_id AS neighbor_id, 1 AS o, 0 AS i FROM relation UNION ALL SELECT to_id, from_id, 0, 1 FROM relation);;") + """
SELECT id, neighbor_id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM ends WHERE id IN (SELECT id FROM ids) GROUP BY id, neighbor_id""")
def describe_entity_neighbors(g):
    return R.describe(g.relation, R.lookup(g.entity_by_name, _names(g)), g.relation_in)


def _search(name: str, source=None, target=None, relation_type=None, limit=100):
    conditions = ["true"]
    if source:
        conditions.append(f"from_id IN (SELECT id FROM entity WHERE name = '{source}')")
    if target:
        conditions.append(f"to_id IN (SELECT id FROM entity WHERE name = '{target}')")
    if relation_type:
        conditions.append(f"relation_type = '{relation_type}'")
    query(name, f"SELECT * FROM relation WHERE {' AND '.join(conditions)} ORDER BY from_id, to_id, relation_type LIMIT {limit}")(
        lambda g: R.search_relations(g.relation, g.entity_by_name, source, target, relation_type, limit, g.relation_in if target else None))


_search("search_relations_from", source="Customer#000000001")
_search("search_relations_to", target="Part#000000007")
_search("search_relations_type", relation_type="in_nation")
_search("search_relations_from_type", source="Customer#000000001", relation_type="bought")
_search("search_relations_unknown", relation_type="no_such_type")


@query("relation_names", "SELECT a.name AS from_name, b.name AS to_name, relation_type FROM relation JOIN entity a ON a.id = from_id JOIN entity b ON b.id = to_id")
def relation_names(g):
    return R.with_names(g.relation, g.entity)


@query("relation_details", """
o AS (SELECT from_id, to_id, relation_type, string_agg(body, '|' ORDER BY idx) AS bodies FROM relation_observation GROUP BY ALL),
a AS (SELECT from_id, to_id, relation_type, string_agg(key || '=' || value, ',' ORDER BY key) AS attributes FROM relation_attribute GROUP BY ALL);;
SELECT r.from_id, r.to_id, r.relation_type, coalesce(bodies, '') AS bodies, attributes FROM relation r
LEFT JOIN o USING (from_id, to_id, relation_type) LEFT JOIN a USING (from_id, to_id, relation_type)""")
def relation_details(g):
    rows = R.relation_details(g.relation, g.relation_observation, g.relation_attribute)
    pairs = F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("from_id", "to_id", "relation_type", R.joined(F.col("bodies")).alias("bodies"), F.array_join(pairs, ",").alias("attributes"))


@query("relation_by_triple", """
SELECT true AS found, from_id, to_id, relation_type FROM relation WHERE from_id = 3000000001 AND relation_type = 'in_nation'
UNION ALL SELECT false, NULL, NULL, NULL""")
def relation_by_triple(g):
    nation = g.table("customer").filter("c_custkey = 1").join(g.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_name"]
    ask = lambda kind: R.one_relation(g.relation, g.entity_by_name, "Customer#000000001", nation, kind)
    return ask("in_nation").union(ask("no_such_type"))


_ASKED = [("entity", "part"), ("entity", "planet"), ("relation", "bought"), ("relation", "part"), ("relation", "bought")]


@query("types_exist", "SELECT * FROM (VALUES ('entity', 'part', true), ('entity', 'planet', false), ('relation', 'bought', true), ('relation', 'part', false)) AS v(kind, name, \"exists\")")
def types_exist(g):
    return R.types_known(g.entity, g.relation, g.spark.createDataFrame(_ASKED, "kind string, name string"))


@query("viewer_meta", """
t AS (SELECT entity_type, count(*) AS n FROM entity GROUP BY entity_type);;
SELECT (SELECT string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) FROM t) AS legend, (SELECT count(*) FROM entity) AS entities_total, (SELECT count(*) FROM relation) AS relations_total,
       least(greatest((SELECT n FROM t WHERE entity_type = 'part') - 150, 0), 40) AS returned, 190 < (SELECT n FROM t WHERE entity_type = 'part') AS has_more""")
def viewer_meta(g):
    pairs = F.transform(F.map_entries("legend"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return R.page_meta(g.entity, g.relation, 150, 40, "part").select(F.array_join(pairs, ",").alias("legend"), "entities_total", "relations_total", "returned", "has_more")


@query("attributes_map", "SELECT owner_id, string_agg(key || '=' || value, ',' ORDER BY key) AS attributes FROM attribute GROUP BY owner_id")
def attributes_map(g):
    rows = R.attribute_map(g.attribute)
    return rows.select("owner_id", F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attributes"))


@query("export_entities", """
o AS (SELECT entity_id, count(*) AS n, sum(length(body)) AS chars FROM observation GROUP BY entity_id), a AS (SELECT owner_id, count(*) AS n FROM attribute GROUP BY owner_id);;
SELECT id, name, entity_type, coalesce(o.n, 0) AS n_observations, CAST(coalesce(chars, 0) AS BIGINT) AS n_chars, coalesce(a.n, 0) AS n_attributes
FROM entity LEFT JOIN o ON o.entity_id = id LEFT JOIN a ON a.owner_id = id""")
def export_entities(g):
    shape = "struct<name:string,entityType:string,observations:array<string>,attributes:map<string,string>>"
    rows = R.export_entities(g.entity, g.observation, g.attribute).withColumn("e", F.from_json("payload", shape))
    chars = F.aggregate("e.observations", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("id", F.col("e.name").alias("name"), F.col("e.entityType").alias("entity_type"), F.size("e.observations").cast("long").alias("n_observations"), chars.alias("n_chars"), F.coalesce(F.size("e.attributes"), F.lit(0)).cast("long").alias("n_attributes")).withColumn("n_attributes", F.greatest("n_attributes", F.lit(0).cast("long")))


@query("export_relations", """
c AS (SELECT * FROM relation ORDER BY from_id, to_id, relation_type LIMIT 3000),
o AS (SELECT from_id, to_id, relation_type, count(*) AS n, string_agg(body, '|' ORDER BY idx) AS bodies FROM relation_observation GROUP BY ALL);;
SELECT c.from_id, c.to_id, c.relation_type, a.name AS from_name, b.name AS to_name, coalesce(bodies, '') AS bodies, m.value AS market
FROM c JOIN entity a ON a.id = c.from_id JOIN entity b ON b.id = c.to_id LEFT JOIN o USING (from_id, to_id, relation_type) LEFT JOIN relation_attribute m USING (from_id, to_id, relation_type)""")
def export_relations(g):
    shape = "struct<from:string,to:string,relationType:string,observations:array<string>,attributes:map<string,string>>"
    rows = R.export_relations(g.relation, g.entity, g.relation_observation, g.relation_attribute, 3000).withColumn("e", F.from_json("payload", shape))
    return rows.select("from_id", "to_id", "relation_type", F.col("e.from").alias("from_name"), F.col("e.to").alias("to_name"), R.joined(F.col("e.observations")).alias("bodies"), F.col("e.attributes")["market"].alias("market"))


@query("observation_values", "SELECT entity_id, substring(body, 8) AS value FROM observation WHERE starts_with(body, 'brand: ')")
def observation_values(g):
    return R.observation_value(g.observation, "brand")


@query("relation_type_signatures", "SELECT DISTINCT relation_type, a.entity_type AS from_type, b.entity_type AS to_type FROM relation JOIN entity a ON a.id = from_id JOIN entity b ON b.id = to_id")
def relation_type_signatures(g):
    return R.type_signatures(g.relation, g.entity)


also("get_entity_observations_whole", "get_entity_observations")
also("relation_details_whole", "relation_details")
