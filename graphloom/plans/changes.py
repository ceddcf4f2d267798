"""Queries of mutations and the change log."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import changelog as C
from graphloom.operators import mutate as M
from graphloom.operators.log import apply_log
from graphloom.plans.registry import also, query
from graphloom.sources.derived import Graph

_NEW = "new AS (SELECT CAST(c_custkey AS BIGINT) AS pos, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'new:' || CAST(c_custkey % 50 AS VARCHAR) ELSE '' END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS entity_type FROM customer)"


def _new(g):
    c = g.table("customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("new:"), (F.col("c_custkey") % 50).cast("string"))).otherwise("")
    return c.select(F.col("c_custkey").alias("pos"), name.alias("name"), F.when(F.col("c_custkey") % 2 == 0, "even").otherwise("odd").alias("entity_type"))


@query("mut_create_result", _NEW + """,
f AS (SELECT name, min(pos) AS pos FROM new WHERE name <> '' AND name NOT IN (SELECT name FROM entity) GROUP BY name);;
SELECT * FROM entity UNION ALL SELECT 7000000000 + f.pos, f.name, new.entity_type FROM f JOIN new ON new.pos = f.pos""")
def mut_create_result(g):
    return M.create_entities(g.entity, _new(g), 7_000_000_000)


@query("mut_upsert_result", _NEW + ", l AS (SELECT name, arg_max(entity_type, pos) AS t FROM new GROUP BY name);;SELECT id, e.name, coalesce(t, entity_type) AS entity_type FROM entity e LEFT JOIN l USING (name)")
def mut_upsert_result(g):
    return M.upsert_types(g.entity, _new(g))


_GONE = "gone AS (SELECT id, name FROM entity WHERE id % 7 = 2)"


def _deleted(g):
    names = g.entity.filter("id % 7 = 2").select("name")
    chunks = g.attachment.select("attachment_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("chunk_index"))
    return M.delete_entities(g.entity, names, relation=g.relation, observation=g.observation, attribute=g.attribute, relation_observation=g.relation_observation, relation_attribute=g.relation_attribute, attachment=g.attachment, chunk=chunks)


@query("mut_delete_entities", _GONE + ";;SELECT * FROM entity WHERE id NOT IN (SELECT id FROM gone)")
def mut_delete_entities(g):
    return _deleted(g)["entity"]


@query("mut_delete_relations", _GONE + ";;SELECT * FROM relation WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)")
def mut_delete_relations(g):
    return _deleted(g)["relation"]


@query("mut_delete_owned", _GONE + """;;
SELECT 'observation' AS kind, count(*) AS n FROM observation WHERE entity_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'attribute', count(*) FROM attribute WHERE owner_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'relation_observation', count(*) FROM relation_observation WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'relation_attribute', count(*) FROM relation_attribute WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'attachment', count(*) FROM attachment WHERE entity_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'chunk', 2 * count(*) FROM attachment WHERE entity_id NOT IN (SELECT id FROM gone)""")
def mut_delete_owned(g):
    left, out = _deleted(g), None
    for kind in ("observation", "attribute", "relation_observation", "relation_attribute", "attachment", "chunk"):
        n = left[kind].agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.union(n)
    return out


@query("mut_delete_relation_children", """
SELECT 'relation' AS kind, count(*) AS n FROM relation WHERE NOT (relation_type = 'in_nation' AND from_id % 2 = 0)
UNION ALL SELECT 'observation', count(*) FROM relation_observation WHERE from_id % 2 <> 0 UNION ALL SELECT 'attribute', count(*) FROM relation_attribute WHERE from_id % 2 <> 0""")
def mut_delete_relation_children(g):
    gone, out = g.relation.filter("relation_type = 'in_nation' AND from_id % 2 = 0"), None
    for kind, rows in (("relation", g.relation), ("observation", g.relation_observation), ("attribute", g.relation_attribute)):
        n = M.delete_relations(rows, gone).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = n if out is None else out.union(n)
    return out


@query("mut_tombstones", "SELECT from_id, to_id, relation_type, CASE WHEN to_id % 3 = 0 THEN 5 WHEN relation_type = 'in_nation' THEN 6 ELSE 5 END AS revision, to_id % 3 = 0 OR relation_type = 'in_nation' AS deleted FROM relation")
def mut_tombstones(g):
    mirror = g.relation.select("from_id", "to_id", "relation_type", F.lit(5).alias("revision"), (F.col("to_id") % 3 == 0).alias("deleted"))
    return M.tombstones(mirror, g.relation.filter("relation_type = 'in_nation'"))


@query("mut_create_relations", """
new AS (SELECT from_id, to_id + 1 AS to_id, 'near' AS relation_type FROM relation WHERE relation_type = 'bought' UNION ALL SELECT * FROM relation WHERE relation_type = 'in_nation'),
ok AS (SELECT DISTINCT * FROM new WHERE from_id IN (SELECT id FROM entity) AND to_id IN (SELECT id FROM entity));;
SELECT * FROM relation UNION SELECT * FROM ok""")
def mut_create_relations(g):
    r = g.relation
    new = r.filter("relation_type = 'bought'").select("from_id", (F.col("to_id") + 1).alias("to_id"), F.lit("near").alias("relation_type")).union(r.filter("relation_type = 'in_nation'"))
    return M.create_relations(r, g.entity, new)


@query("mut_merge_relations", """
m AS (SELECT CASE WHEN from_id = 4000000001 THEN 4000000002 ELSE from_id END AS from_id, CASE WHEN to_id = 4000000001 THEN 4000000002 ELSE to_id END AS to_id, relation_type FROM relation);;
SELECT DISTINCT CAST(from_id AS BIGINT) AS from_id, CAST(to_id AS BIGINT) AS to_id, relation_type FROM m""")
def mut_merge_relations(g):
    return M.merge_entities(g.entity, g.relation, g.observation, g.attribute, 4_000_000_001, 4_000_000_002)[1]


@query("mut_merge_observations", """
s AS (SELECT body, idx FROM observation WHERE entity_id = 5000000001 AND body NOT IN (SELECT body FROM observation WHERE entity_id = 5000000002)),
x AS (SELECT max(idx) AS last FROM observation WHERE entity_id = 5000000002);;
SELECT entity_id, idx, body FROM observation WHERE entity_id <> 5000000001
UNION ALL SELECT 5000000002, CAST(last + row_number() OVER (ORDER BY idx) AS INTEGER), body FROM s, x""")
def mut_merge_observations(g):
    return M.merge_entities(g.entity, g.relation, g.observation, g.attribute, 5_000_000_001, 5_000_000_002)[2]


@query("mut_merge_origins", """
s AS (SELECT body, idx FROM observation WHERE entity_id = 5000000001 AND body NOT IN (SELECT body FROM observation WHERE entity_id = 5000000002));;
SELECT CAST(5000000002 AS BIGINT) AS entity_id, CAST(2 + row_number() OVER (ORDER BY idx) AS INTEGER) AS idx, 'Part#000000001' AS origin FROM s""")
def mut_merge_origins(g):
    after = M.merge_entities(g.entity, g.relation, g.observation, g.attribute, 5_000_000_001, 5_000_000_002, g.attachment)[2]
    return M.merge_origins(g.observation, after, g.entity, 5_000_000_001, 5_000_000_002)


@query("mut_merge_relation_bodies", "SELECT * FROM relation_observation WHERE from_id <> 4000000001")
def mut_merge_relation_bodies(g):
    """Bodies of re-pointed relations are not carried."""
    relation = M.merge_entities(g.entity, g.relation, g.observation, g.attribute, 4_000_000_001, 4_000_000_002)[1]
    return M.of_live_relations(g.relation_observation, relation)


_RENAMED = """
n AS (SELECT id AS pos, name, CASE WHEN id % 5 = 4 THEN '' WHEN id % 5 = 3 THEN 'ASIA' WHEN id % 5 = 2 THEN 'same' ELSE name || '*' END AS new_name FROM entity WHERE entity_type = 'supplier'),
m AS (SELECT *, CASE WHEN new_name = '' THEN 'empty' WHEN new_name = 'ASIA' OR (new_name = 'same' AND pos > (SELECT min(pos) FROM n WHERE new_name = 'same')) THEN 'taken' ELSE 'renamed' END AS outcome FROM n),
o AS (SELECT * FROM m UNION ALL SELECT pos + 1000000, name, name || '+', CASE outcome WHEN 'renamed' THEN 'unknown' ELSE 'renamed' END FROM m WHERE pos % 2 = 0 UNION ALL SELECT 1, 'no such name', 'free', 'unknown');;"""


def _renames(g):
    """Names that collide, are taken or empty, are given twice or name nothing."""
    s = g.entity.filter("entity_type = 'supplier'")
    k = F.col("id") % 5
    new = F.when(k == 4, "").when(k == 3, "ASIA").when(k == 2, "same").otherwise(F.concat("name", F.lit("*")))
    rows = s.select(F.col("id").alias("pos"), "name", new.alias("new_name")).union(s.filter("id % 2 = 0").select(F.col("id") + 1_000_000, "name", F.concat("name", F.lit("+"))))
    return rows.union(g.spark.createDataFrame([(1, "no such name", "free")], "pos long, name string, new_name string"))


@query("mut_rename_result", _RENAMED + "SELECT id, coalesce(new_name, e.name) AS name, entity_type FROM entity e LEFT JOIN (SELECT name, new_name FROM o WHERE outcome = 'renamed') USING (name)")
def mut_rename_result(g):
    return M.rename_entities(g.entity, _renames(g))


@query("mut_rename_outcome", _RENAMED + "SELECT * FROM o")
def mut_rename_outcome(g):
    return M.rename_outcome(g.entity, _renames(g))


@query("mut_reverse_result", "SELECT CASE WHEN relation_type = 'in_region' THEN to_id ELSE from_id END AS from_id, CASE WHEN relation_type = 'in_region' THEN from_id ELSE to_id END AS to_id, relation_type FROM relation")
def mut_reverse_result(g):
    return M.reverse_relations(g.relation, g.relation.filter("relation_type = 'in_region'"))[0]


@query("mut_retype_result", "SELECT from_id, to_id, CASE WHEN relation_type = 'supplies' AND to_id % 2 = 0 THEN 'sells' ELSE relation_type END AS relation_type FROM relation")
def mut_retype_result(g):
    return M.change_relation_type(g.relation, g.relation.filter("relation_type = 'supplies' AND to_id % 2 = 0"), "sells")[0]


_TURNED = "t AS (SELECT * FROM relation WHERE relation_type = 'in_nation' UNION ALL SELECT to_id, from_id, 'in_nation' FROM relation WHERE relation_type = 'in_nation' AND from_id % 10 = 1);;"


def _turned(g):
    """Relations of which some have a live reverse, and the turns that are asked."""
    r = g.relation.filter("relation_type = 'in_nation'")
    live = r.union(r.filter("from_id % 10 = 1").select("to_id", "from_id", "relation_type"))
    return M.reverse_moves(live, r.filter("from_id % 2 = 1"))


@query("mut_reverse_children", "SELECT CASE WHEN from_id % 2 = 1 AND from_id % 10 <> 1 THEN to_id ELSE from_id END AS from_id, CASE WHEN from_id % 2 = 1 AND from_id % 10 <> 1 THEN from_id ELSE to_id END AS to_id, relation_type, idx, body FROM relation_observation")
def mut_reverse_children(g):
    """Bodies move with their relation; refused turns move nothing."""
    return M.apply_moves(g.relation_observation, _turned(g)[0])


@query("mut_reverse_refused", "SELECT from_id, to_id, relation_type FROM relation WHERE relation_type = 'in_nation' AND from_id % 10 = 1")
def mut_reverse_refused(g):
    return _turned(g)[1]


@query("mut_retype_children", "SELECT from_id, to_id, CASE WHEN from_id % 2 = 0 THEN 'lives_in' ELSE relation_type END AS relation_type, key, value FROM relation_attribute")
def mut_retype_children(g):
    moves, _ = M.retype_moves(g.relation, g.relation.filter("relation_type = 'in_nation' AND from_id % 2 = 0"), "lives_in")
    return M.apply_moves(g.relation_attribute, moves)


_ADDED = "n AS (SELECT CAST(3000000000 + o_custkey AS BIGINT) AS entity_id, o_orderkey AS pos, 'priority: ' || o_orderpriority AS body FROM orders)"


def _added(g):
    o = g.table("orders")
    return o.select((F.lit(3_000_000_000).cast("long") + F.col("o_custkey")).alias("entity_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("priority: "), "o_orderpriority").alias("body"))


@query("mut_add_obs_result", _ADDED + """, l AS (SELECT entity_id, max(idx) AS last FROM observation GROUP BY entity_id);;
SELECT entity_id, idx, body FROM observation UNION ALL SELECT entity_id, CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS INTEGER), body FROM n LEFT JOIN l USING (entity_id)""")
def mut_add_obs_result(g):
    return M.request_observations(g.observation, g.entity, _added(g))


@query("mut_upsert_obs_result", _ADDED + """, f AS (SELECT entity_id, body, min(pos) AS pos FROM n GROUP BY entity_id, body), l AS (SELECT entity_id, max(idx) AS last FROM observation GROUP BY entity_id);;
SELECT entity_id, idx, body FROM observation UNION ALL SELECT entity_id, CAST(coalesce(last, -1) + row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS INTEGER), body FROM f LEFT JOIN l USING (entity_id)""")
def mut_upsert_obs_result(g):
    return M.add_observations(g.observation, _added(g), only_new=True)


@query("mut_add_obs_refused", "SELECT CAST(3000000000 + o_custkey + o_orderkey % 2 * 1000000 AS BIGINT) AS entity_id, o_orderkey AS pos FROM orders WHERE o_orderkey % 2 = 1")
def mut_add_obs_refused(g):
    """Observations of entities that don't exist, for which a request is refused."""
    o = g.table("orders")
    return M.unknown_owners(g.entity, o.select((F.lit(3_000_000_000).cast("long") + F.col("o_custkey") + F.col("o_orderkey") % 2 * 1_000_000).alias("entity_id"), F.col("o_orderkey").alias("pos")))


@query("mut_delete_obs_at", "SELECT * FROM observation WHERE NOT (idx = 1 OR entity_id % 4 = 0)")
def mut_delete_obs_at(g):
    gone = g.observation.filter("idx = 1 OR entity_id % 4 = 0").select("entity_id", "idx")
    return M.delete_observations_at(g.observation, gone.union(gone.withColumn("idx", F.lit(99))))


@query("request_faults", """
SELECT p_partkey AS pos, 'empty name' AS fault FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'long name' FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0
UNION ALL SELECT doc_id, 'long body' FROM documents WHERE strlen(text) > 65536 UNION ALL SELECT doc_id, 'no body' FROM documents WHERE doc_id % 50 = 0 AND strlen(text) <= 65536""")
def request_faults(g):
    p, d = g.table("part"), g.table("documents")
    names = p.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, "").when((F.col("p_partkey") % 3 == 1) & (F.col("p_partkey") % 2 == 0), F.repeat(F.lit("é"), 513)).otherwise(F.repeat(F.lit("é"), 512)).alias("name"))
    return M.request_faults(names, d.select(F.col("doc_id").alias("pos"), F.when((F.col("doc_id") % 50 == 0) & (F.octet_length("text") <= 65536), None).otherwise(F.col("text")).alias("body")))


@query("mut_delete_obs_result", "SELECT entity_id, idx, body FROM observation WHERE NOT (entity_id BETWEEN 5000000000 AND 5999999999 AND starts_with(body, 'brand: ') AND entity_id % 2 = 0)")
def mut_delete_obs_result(g):
    return M.delete_observations(g.observation, g.observation.filter("entity_id BETWEEN 5000000000 AND 5999999999 AND startswith(body, 'brand: ') AND entity_id % 2 = 0"))


@query("mut_set_attr_result", "SELECT owner_kind, owner_id, key, CASE WHEN key = 'lang' AND owner_id % 3 = 0 THEN upper(value) ELSE value END AS value FROM attribute UNION ALL SELECT 'entity', id, 'rank', 'top' FROM entity WHERE entity_type = 'region'")
def mut_set_attr_result(g):
    a = g.attribute.filter("key = 'lang' AND owner_id % 3 = 0")
    new = a.select("owner_kind", "owner_id", "key", F.explode(F.array(F.struct(F.lit("x").alias("value"), F.lit(0).alias("pos")), F.struct(F.upper("value").alias("value"), F.lit(1).alias("pos")))).alias("v")).select("owner_kind", "owner_id", "key", "v.value", "v.pos")
    more = g.entity.filter("entity_type = 'region'").select(F.lit("entity").alias("owner_kind"), F.col("id").alias("owner_id"), F.lit("rank").alias("key"), F.lit("top").alias("value"), F.lit(0).alias("pos"))
    return M.set_attributes(g.attribute, new.union(more))


@query("mut_change_diff", _GONE + """;;
SELECT id, 'delete' AS operation FROM gone UNION ALL SELECT id, 'update' FROM entity WHERE entity_type = 'part' AND id % 7 <> 2
UNION ALL SELECT DISTINCT CAST(8000000000 + r_regionkey AS BIGINT), 'create' FROM region""")
def mut_change_diff(g):
    e = g.entity
    after = e.filter("id % 7 <> 2").withColumn("entity_type", F.when(F.col("entity_type") == "part", "article").otherwise(F.col("entity_type")))
    after = after.union(g.table("region").select((F.lit(8_000_000_000).cast("long") + F.col("r_regionkey")).alias("id"), F.lit("x"), F.lit("y")))
    return M.changes(e, after, "id", ["name", "entity_type"])


@query("mut_counters", _GONE + ";;SELECT entity_type, -count(*) AS delta FROM entity WHERE id IN (SELECT id FROM gone) GROUP BY entity_type")
def mut_counters(g):
    return M.counter_deltas(g.entity, _deleted(g)["entity"], "entity_type")


_REVISED = """
x AS (SELECT *, sum(1 - quiet) OVER (PARTITION BY entity_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s, first_value(quiet) OVER (PARTITION BY entity_id ORDER BY ts, event_id) AS q FROM change),
revised AS (SELECT event_id, entity_id, operation, quiet, CAST(s + q AS BIGINT) AS entity_revision FROM x)"""


@query("event_revisions", _REVISED + ";;SELECT event_id, entity_id, entity_revision FROM revised")
def event_revisions(g):
    return C.event_revisions(g.change).select("event_id", "entity_id", "entity_revision")


@query("event_quiet", _REVISED + ";;SELECT entity_id, count(*) AS n_quiet, max(entity_revision) AS entity_revision FROM revised WHERE quiet = 1 GROUP BY entity_id")
def event_quiet(g):
    rows = C.event_revisions(g.change).filter("quiet = 1")
    return rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_quiet"), F.max("entity_revision").alias("entity_revision"))


_SUBSCRIPTIONS = [("all", [], [], [], "none"), ("creates", ["create"], [], [], "none"), ("deletes", ["delete", "create"], ["customer"], ["app1"], "app2"), ("parts", [], ["part"], [], "none")]


@query("outbox_fanout", """
o AS (SELECT event_id, operation, 'app' || CAST(event_id % 3 AS VARCHAR) AS origin FROM change);;
SELECT event_id, 'all' AS subscription_id FROM o UNION ALL SELECT event_id, 'creates' FROM o WHERE operation = 'create'
UNION ALL SELECT event_id, 'deletes' FROM o WHERE operation IN ('delete', 'create') AND origin NOT IN ('app1', 'app2')""")
def outbox_fanout(g):
    subs = g.spark.createDataFrame(_SUBSCRIPTIONS, "subscription_id string, operations array<string>, types array<string>, ignored_origins array<string>, own_origin string")
    rows = g.change.select("event_id", "operation", F.lit("customer").alias("entity_type"), F.concat(F.lit("app"), (F.col("event_id") % 3).cast("string")).alias("origin"))
    return C.fan_out(rows, subs)


_OUTBOX = """outbox AS (SELECT event_id AS delivery_id, user_id AS subscription_id, CASE WHEN event_id % 5 = 0 THEN 'leased' WHEN event_id % 5 = 1 THEN 'done' ELSE 'pending' END AS state,
  event_id % 97 AS next_attempt, event_id % 61 AS lease_until, event_id % 4 AS epoch FROM events)"""


def _outbox(g):
    e, n = g.table("events"), F.col("event_id")
    state = F.when(n % 5 == 0, "leased").when(n % 5 == 1, "done").otherwise("pending")
    return e.select(n.alias("delivery_id"), F.col("user_id").alias("subscription_id"), state.alias("state"), (n % 97).alias("next_attempt"), (n % 61).alias("lease_until"), (n % 4).alias("epoch"))


@query("outbox_claim", _OUTBOX + """,
d AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY next_attempt, delivery_id) AS place FROM outbox o
  WHERE ((state = 'pending' AND next_attempt <= 58) OR (state = 'leased' AND lease_until <= 58))
    AND subscription_id NOT IN (SELECT subscription_id FROM outbox WHERE state = 'leased' AND lease_until > 58));;
SELECT subscription_id, delivery_id, epoch + 1 AS epoch FROM d WHERE place = 1""")
def outbox_claim(g):
    return C.due_claims(_outbox(g), 58)


@query("outbox_transitions", """
s AS (SELECT event_id AS delivery_id, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 408 ELSE 204 END AS status, event_id % 10 AS attempts FROM events);;
SELECT delivery_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN status IN (408, 429, 503) AND attempts < 8 THEN 'pending' ELSE 'dead' END AS state FROM s""")
def outbox_transitions(g):
    n = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 429, 503, 408, 204)]), (n % 6 + 1).cast("int"))
    return g.table("events").select(n.alias("delivery_id"), C.delivery_outcome(status, n % 10).alias("state"))


@query("outbox_retry_times", """
s AS (SELECT event_id AS delivery_id, CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 408 ELSE 204 END AS status, event_id % 10 AS attempts,
  CASE WHEN event_id % 4 > 0 THEN event_id % 4 * 2500000000 - 2400000000 END AS wait FROM events);;
SELECT delivery_id, CASE WHEN status BETWEEN 200 AND 299 THEN 'done' WHEN status IN (408, 429, 503) AND attempts < 8 THEN 'pending' ELSE 'dead' END AS state,
  CASE WHEN status IN (408, 429, 503) AND attempts < 8 THEN 50 + least(greatest(coalesce(wait, 1000000), 1000000), 3600000000) END AS next_attempt FROM s""")
def outbox_retry_times(g):
    n = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 404, 429, 503, 408, 204)]), (n % 6 + 1).cast("int"))
    state, due = C.delivery_transition(status, n % 10, 50, F.when(n % 4 > 0, n % 4 * 2_500_000_000 - 2_400_000_000))
    return g.table("events").select(n.alias("delivery_id"), state.alias("state"), due.alias("next_attempt"))


@query("jobs_of_profiles", "SELECT event_id, 'p' || event_id % 5 AS profile FROM events WHERE event_id % 5 IN (0, 1, 2)")
def jobs_of_profiles(g):
    """Jobs of the serving profile and of one that is being built; candidates of settled registries don't count."""
    registry = g.spark.createDataFrame([("p0", "p1", "Rebuilding"), ("p2", "p3", "Ready"), (None, None, "Rebuilding")], "serving string, candidate string, state string")
    jobs = g.table("events").select("event_id", F.concat(F.lit("p"), (F.col("event_id") % 5).cast("string")).alias("profile"))
    return jobs.join(C.served_profiles(registry), "profile", "left_semi").select("event_id", "profile")


@query("commit_replaces_chunks", "SELECT owner_id, vec_id, CAST(8 AS BIGINT) AS generation FROM chunk_vector WHERE owner_id % 3 <> 0 UNION ALL SELECT owner_id, vec_id + 1000000, 8 FROM chunk_vector WHERE owner_id % 3 = 0 AND chunk_index = 0")
def commit_replaces_chunks(g):
    chunks = g.chunk_vector.select("owner_id", "vec_id")
    new = g.chunk_vector.filter("chunk_index = 0").select("owner_id", (F.col("vec_id") + 1_000_000).alias("vec_id"))
    after, generation = C.commit_chunks(chunks, chunks.filter("owner_id % 3 = 0").select(F.col("owner_id").alias("entity_id")), new, 7)
    return after.withColumn("generation", F.lit(generation).cast("long"))


_STATE = """
ent AS (SELECT CAST(6000000000 + doc_id AS BIGINT) AS id, doc_id AS k, 2 + doc_id % 2 AS revision, doc_id % 9 <> 0 AS live FROM documents),
mir AS (SELECT s_suppkey AS id, s_suppkey % 10 = 3 AS deleted FROM supplier),
seg AS (SELECT doc_id AS id, 0 AS chunk_index, 'x' AS text FROM documents UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'y' END FROM documents),
ev AS (SELECT id, CASE WHEN k % 11 = 4 THEN 1 ELSE revision END AS revision FROM ent WHERE k % 7 <> 1),
rv AS (SELECT id FROM mir WHERE id % 4 <> 2),
av AS (SELECT doc_id AS id, 0 AS chunk_index, 2 AS revision FROM documents WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, 1, CASE WHEN doc_id % 31 = 8 THEN 1 ELSE 2 END FROM documents WHERE doc_id % 3 <> 1 AND doc_id % 8 <> 5),
aj AS (SELECT doc_id AS id, CASE doc_id % 17 WHEN 3 THEN 'leased' WHEN 4 THEN 'dead' ELSE 'done' END AS state FROM documents WHERE doc_id % 19 <> 7),
rdy AS (SELECT attachment_id AS id FROM attachment JOIN ent ON ent.id = entity_id WHERE status = 'ready' AND live),
nt AS (SELECT id, count(*) FILTER (text <> '') AS t FROM seg GROUP BY id), nv AS (SELECT id, count(*) AS v FROM av GROUP BY id)"""


@query("scan_faults", _STATE + """;;
SELECT 'stale' AS fault, 'entity' AS owner_kind, id AS owner_id FROM ent WHERE live AND k % 13 <> 5 AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.id = ent.id AND ev.revision = ent.revision)
UNION ALL SELECT 'no owner', 'entity', id FROM ev WHERE id NOT IN (SELECT id FROM ent WHERE live)
UNION ALL SELECT 'stale', 'relation', id FROM mir WHERE NOT deleted AND id % 6 <> 4 AND id NOT IN (SELECT id FROM rv)
UNION ALL SELECT 'no owner', 'relation', id FROM rv WHERE id NOT IN (SELECT id FROM mir WHERE NOT deleted)
UNION ALL SELECT 'job or count', 'attachment', r.id FROM rdy r LEFT JOIN aj ON aj.id = r.id LEFT JOIN nt ON nt.id = r.id LEFT JOIN nv ON nv.id = r.id
  WHERE state IS NULL OR (state <> 'dead' AND (state <> 'done' OR coalesce(t, 0) <> coalesce(v, 0))) OR (state = 'dead' AND coalesce(v, 0) > 0)
UNION ALL SELECT DISTINCT 'segment without vector', 'attachment', s.id FROM seg s JOIN rdy USING (id) JOIN aj USING (id) WHERE text <> '' AND state <> 'dead'
  AND NOT EXISTS (SELECT 1 FROM av WHERE av.id = s.id AND av.chunk_index = s.chunk_index AND av.revision = 2)
UNION ALL SELECT DISTINCT 'vector without segment', 'attachment', a.id FROM av a WHERE NOT (a.revision = 2 AND a.id IN (SELECT id FROM rdy) AND EXISTS (SELECT 1 FROM seg s WHERE s.id = a.id AND s.chunk_index = a.chunk_index AND text <> ''))
UNION ALL SELECT 'extracting', 'attachment', doc_id FROM documents WHERE doc_id % 23 = 6
UNION ALL SELECT 'unfinished', 'attachment', id FROM aj WHERE state = 'leased'""")
def scan_faults(g):
    """All nine kinds of faults over a store that has each of them."""
    d, s, k, n = g.table("documents"), g.table("supplier"), F.col("doc_id"), F.col("s_suppkey")
    revision = (2 + k % 2).cast("long")
    ident = F.lit(6_000_000_000).cast("long") + k
    entity = d.select(ident.alias("id"), F.lit("document").alias("entity_type"), revision.alias("revision"), (k % 9 != 0).alias("live"))
    mirror = s.select(n.alias("relation_id"), F.lit(3).cast("long").alias("revision"), (n % 10 == 3).alias("deleted"))
    segment = d.select(k.alias("attachment_id"), F.lit(0).alias("chunk_index"), F.lit("x").alias("text")).union(d.select(k, F.lit(1), F.when(k % 6 == 0, "").otherwise("y")))
    chunk = lambda rows, kind, owner, chunk_kind, at, rev, of: rows.select(F.lit(kind).alias("owner_kind"), owner.alias("owner_id"), F.lit(chunk_kind).alias("kind"), F.lit(at).alias("chunk_index"), rev.cast("long").alias("owner_revision"), F.lit(of).alias("type"))
    chunks = chunk(d.filter(k % 7 != 1), "entity", ident, "identity", 0, F.when(k % 11 == 4, 1).otherwise(revision), "document").union(chunk(s.filter(n % 4 != 2), "relation", n, "relation", 0, F.lit(3), "in_nation"))
    chunks = chunks.union(chunk(d.filter(k % 3 != 1), "attachment", k, "attachment", 0, F.lit(2), "document")).union(chunk(d.filter((k % 3 != 1) & (k % 8 != 5)), "attachment", k, "attachment", 1, F.when(k % 31 == 8, 1).otherwise(2), "document"))
    job = lambda rows, kind, owner, rev, state: rows.select(F.lit(kind).alias("owner_kind"), owner.alias("owner_id"), rev.cast("long").alias("revision"), state.alias("state"))
    jobs = job(d, "entity", ident, revision, F.when(k % 13 == 5, "dead").otherwise("done")).union(job(s, "relation", n, F.lit(3), F.when(n % 6 == 4, "dead").otherwise("done")))
    jobs = jobs.union(job(d.filter(k % 19 != 7), "attachment", k, F.lit(2), F.when(k % 17 == 3, "leased").when(k % 17 == 4, "dead").otherwise("done")))
    attachment_jobs = d.select(k.alias("attachment_id"), F.when(k % 23 == 6, "pending").otherwise("done").alias("state"))
    return C.scan_faults(entity, mirror, g.attachment, segment, chunks, jobs, attachment_jobs)


_SUBJECTS = """
sub AS (SELECT DISTINCT 'entity' AS kind, entity_type AS name, length(entity_type) AS revision FROM entity UNION ALL SELECT DISTINCT 'relation', relation_type, length(relation_type) FROM relation),
vec AS (SELECT kind, name, CASE WHEN name = 'bought' THEN 1 ELSE revision END AS revision FROM sub WHERE name <> 'part' UNION ALL SELECT 'relation', 'gone', 4)"""


def _subjects(g):
    one = lambda rows, kind, column: rows.select(F.lit(kind).alias("kind"), F.col(column).alias("name"), F.length(column).cast("long").alias("revision")).distinct()
    subjects = one(g.entity, "entity", "entity_type").union(one(g.relation, "relation", "relation_type"))
    vectors = subjects.filter("name <> 'part'").withColumn("revision", F.when(F.col("name") == "bought", 1).otherwise(F.col("revision")).cast("long"))
    return subjects, vectors.union(g.spark.createDataFrame([("relation", "gone", 4)], vectors.schema))


@query("type_jobs", _SUBJECTS + ";;SELECT kind, name, revision, 'upsert' AS operation FROM sub WHERE (kind, name, revision) NOT IN (SELECT (kind, name, revision) FROM vec) UNION ALL SELECT kind, name, revision, 'delete' FROM vec WHERE (kind, name) NOT IN (SELECT (kind, name) FROM sub)")
def type_jobs(g):
    return C.type_jobs(*_subjects(g))


@query("type_snapshots", _SUBJECTS + ";;SELECT kind, count(*) AS n, kind = 'entity' AS served FROM vec GROUP BY kind")
def type_snapshots(g):
    """The missing vector of one entity type is excused by its dead job; relations have faults."""
    jobs = g.spark.createDataFrame([("entity", "part", "dead"), ("entity", "region", "done")], "kind string, name string, state string")
    return C.type_snapshots(*_subjects(g), jobs)


@query("job_latest_revision", _REVISED + ";;SELECT entity_id, entity_revision, operation FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY entity_revision DESC, event_id DESC) AS place FROM revised WHERE quiet = 0) WHERE place = 1")
def job_latest_revision(g):
    return C.latest_jobs(C.event_revisions(g.change))


@query("fenced_commit", _REVISED + """,
live AS (SELECT entity_id, max(entity_revision) AS revision FROM revised GROUP BY entity_id);;
SELECT r.event_id FROM revised r JOIN live l ON l.entity_id = r.entity_id AND l.revision = r.entity_revision WHERE r.event_id % 3 = 1 AND r.event_id % 50 > 20""")
def fenced_commit(g):
    rows = C.event_revisions(g.change)
    live = rows.groupBy("entity_id").agg(F.max("entity_revision").alias("revision")).withColumn("epoch", F.lit(1).cast("long"))
    commits = rows.select("event_id", "entity_id", (F.col("event_id") % 3).alias("epoch"), F.col("entity_revision").alias("revision"), (F.col("event_id") % 50).alias("lease_until"))
    return C.fenced(commits, live, 20).select("event_id")


@query("fullscan_gate", "live AS (SELECT id FROM entity WHERE entity_type = 'document' AND id % 2 = 0);;SELECT id AS owner_id, 'no chunk' AS fault FROM live WHERE id NOT IN (SELECT owner_id FROM chunk_vector) UNION ALL SELECT DISTINCT owner_id, 'no owner' FROM chunk_vector WHERE owner_id NOT IN (SELECT id FROM live)")
def fullscan_gate(g):
    return C.missing_chunks(g.entity.filter("entity_type = 'document' AND id % 2 = 0").select(F.col("id").alias("owner_id")), g.chunk_vector)


@query("idempotency_conflicts", """
r AS (SELECT event_id AS request_id, user_id AS principal, event_id % 20 AS key, event_type AS fingerprint FROM events),
f AS (SELECT principal, key, min(request_id) AS first, arg_min(fingerprint, request_id) AS fp FROM r GROUP BY principal, key);;
SELECT request_id, CASE WHEN request_id = first THEN 'apply' WHEN fingerprint = fp THEN 'replay' ELSE 'conflict' END AS outcome FROM r JOIN f USING (principal, key)""")
def idempotency_conflicts(g):
    e = g.table("events")
    return C.idempotency(e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("principal"), (F.col("event_id") % 20).alias("key"), F.col("event_type").alias("fingerprint")))


@query("causation_check", """
e AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id - 1 END AS causation, event_id // 4 AS correlation, CASE WHEN event_id % 40 = 7 THEN 9 ELSE event_id % 4 END AS hop FROM events);;
SELECT a.event_id FROM e a LEFT JOIN e b ON b.event_id = a.causation
WHERE NOT (a.hop <= 15 AND CASE WHEN a.causation IS NULL THEN a.hop = 0 ELSE a.hop > 0 AND b.event_id IS NOT NULL AND coalesce(b.correlation = a.correlation AND a.hop = b.hop + 1, false) END)""")
def causation_check(g):
    n = F.col("event_id")
    rows = g.table("events").select("event_id", F.when(n % 4 > 0, n - 1).alias("causation"), F.floor(n / 4).alias("correlation"), F.when(n % 40 == 7, F.lit(9).cast("long")).otherwise(n % 4).alias("hop"))
    return C.causation_faults(rows)


@query("next_due", _OUTBOX + ";;SELECT min(due) AS due FROM (SELECT next_attempt + 3 AS due FROM outbox WHERE state = 'pending' UNION ALL SELECT lease_until + 2 FROM outbox WHERE state = 'leased' UNION ALL SELECT delivery_id FROM outbox WHERE state = 'done')")
def next_due(g):
    o = _outbox(g)
    return C.next_due(o.filter("state = 'pending'").select((F.col("next_attempt") + 3).alias("due")), o.filter("state = 'leased'").select((F.col("lease_until") + 2).alias("due")), o.filter("state = 'done'").select(F.col("delivery_id").alias("due")))


@query("mut_edit_obs_result", "SELECT entity_id, idx, CASE WHEN (idx = 1 OR entity_id >= 6000000000) AND entity_id % 2 = 1 THEN 'edited: ' || body ELSE body END AS body FROM observation")
def mut_edit_obs_result(g):
    """Every edit is asked twice; the later one holds."""
    rows = g.observation.filter("(idx = 1 OR entity_id >= 6000000000) AND entity_id % 2 = 1")
    edits = rows.select("entity_id", "idx", F.lit(1).alias("pos"), F.concat(F.lit("edited: "), "body").alias("new_body")).union(rows.select("entity_id", "idx", F.lit(0), F.lit("zzz")))
    return M.edit_observations(g.observation, edits)


@query("mut_add_relation_obs", """
n AS (SELECT * FROM relation WHERE relation_type = 'in_nation');;
SELECT * FROM relation_observation UNION ALL SELECT from_id, to_id, relation_type, CASE WHEN from_id >= 4000000000 THEN 1 ELSE 0 END, 'second' FROM n""")
def mut_add_relation_obs(g):
    new = g.relation.filter("relation_type = 'in_nation'").union(g.relation.filter("relation_type = 'in_region'").withColumn("relation_type", F.lit("unknown")))
    return M.add_relation_observations(g.relation_observation, g.relation, new.select("from_id", "to_id", "relation_type", F.lit(0).alias("pos"), F.lit("second").alias("body")))


@query("mut_delete_relation_obs", "SELECT * FROM relation_observation WHERE from_id % 3 <> 0")
def mut_delete_relation_obs(g):
    return M.delete_relation_observations(g.relation_observation, g.relation_observation.filter("from_id % 3 = 0"))


@query("mut_delete_attr_result", "SELECT * FROM attribute WHERE NOT (key = 'source' AND owner_id % 2 = 0)")
def mut_delete_attr_result(g):
    return M.delete_attributes(g.attribute, g.attribute.filter("key = 'source' AND owner_id % 2 = 0"))


@query("mut_purge_names", "SELECT name FROM entity WHERE id = 4000000001 OR id IN (SELECT to_id FROM relation WHERE relation_type = 'supplies' AND from_id = 4000000001)")
def mut_purge_names(g):
    return M.defined_names(g.entity, g.relation, g.entity.filter("id = 4000000001").select("name"), "supplies")


@query("mut_set_descriptions", """
old AS (SELECT DISTINCT 'entity' AS kind, entity_type AS name, 'all of ' || entity_type AS description FROM entity),
new AS (SELECT CAST(c_custkey AS BIGINT) AS pos, 'entity' AS kind, lower(c_mktsegment) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS description FROM customer
  UNION ALL SELECT CAST(s_suppkey AS BIGINT), 'entity', CASE WHEN s_suppkey % 2 = 0 THEN 'part' ELSE 'region' END, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END FROM supplier),
l AS (SELECT kind, name, arg_max(description, pos) AS description FROM new GROUP BY kind, name);;
SELECT * FROM l WHERE description <> '' UNION ALL SELECT * FROM old WHERE name NOT IN (SELECT name FROM l)""")
def mut_set_descriptions(g):
    """Descriptions of types from customers and suppliers: the last of a type holds, an empty one clears."""
    old = g.entity.select(F.lit("entity").alias("kind"), F.col("entity_type").alias("name"), F.concat(F.lit("all of "), "entity_type").alias("description")).distinct()
    c, s = g.table("customer"), g.table("supplier")
    new = c.select(F.col("c_custkey").cast("long").alias("pos"), F.lit("entity").alias("kind"), F.lower("c_mktsegment").alias("name"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("description"))
    even = F.col("s_suppkey") % 2 == 0
    new = new.union(s.select(F.col("s_suppkey").cast("long"), F.lit("entity"), F.when(even, "part").otherwise("region"), F.when(even, F.col("s_name")).otherwise("")))
    return M.set_descriptions(old, new)


_FOLD = """
log AS (SELECT event_id AS pos, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' WHEN 'click' THEN 'rename' WHEN 'purchase' THEN 'unrelate' ELSE CASE WHEN event_id % 2 = 0 THEN 'annotate' ELSE 'relate' END END AS op,
  'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS name, 'Customer#' || lpad(CAST(event_id * 7 % 200 AS VARCHAR), 9, '0') AS other FROM events),
l AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS i, * FROM log),
fold AS (
  SELECT CAST(0 AS BIGINT) AS i, map_from_entries(list({'k': name, 'v': id})) AS m, CAST(0 AS BIGINT) AS pos, '' AS op, '' AS name, '' AS other, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM entity WHERE entity_type = 'customer'
  UNION ALL
  SELECT i, CASE WHEN op = 'create' AND a = -1 THEN map_concat(m, map([name], [8000000000 + pos])) WHEN op = 'delete' AND a <> -1 THEN map_concat(m, map([name], [CAST(-1 AS BIGINT)]))
              WHEN op = 'rename' AND a <> -1 AND b = -1 THEN map_concat(m, map([name, other], [CAST(-1 AS BIGINT), a])) ELSE m END, pos, op, name, other, a, b
  FROM (SELECT l.*, m, coalesce(map_extract(m, l.name)[1], -1) AS a, coalesce(map_extract(m, l.other)[1], -1) AS b FROM fold JOIN l ON l.i = fold.i + 1)),
r AS (SELECT pos, op, name, other, a, b FROM fold WHERE i > 0),
t AS (SELECT pos, op, a, b, coalesce(lag(op) OVER (PARTITION BY a, b ORDER BY pos), 'unrelate') = 'relate' AS live FROM r WHERE op IN ('relate', 'unrelate') AND a <> -1 AND b <> -1),
gone AS (SELECT a AS id FROM r WHERE op = 'delete' AND a <> -1),
ends AS (SELECT (unnest(map_entries(m))).key AS name, (unnest(map_entries(m))).value AS id FROM fold WHERE i = (SELECT max(i) FROM fold)),
after AS (
  SELECT ends.id, ends.name, coalesce(entity_type, 'account') AS entity_type FROM ends LEFT JOIN entity e ON e.id = ends.id WHERE ends.id <> -1
  UNION ALL SELECT id, name, entity_type FROM entity WHERE entity_type <> 'customer'),
stand AS (SELECT a AS from_id, b AS to_id, 'knows' AS relation_type FROM t GROUP BY a, b HAVING arg_max(op, pos) = 'relate'),
left_ AS (SELECT * FROM (SELECT * FROM relation UNION ALL SELECT * FROM stand) WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone));;"""

def _log(g) -> dict:
    """The events as an ordered log of requests on customers, and what came of it."""
    if "mutation_log" not in g.__dict__:
        e, kind = g.table("events"), F.col("event_type")
        op = F.when(kind == "signup", "create").when(kind == "error", "delete").when(kind == "click", "rename").when(kind == "purchase", "unrelate").otherwise(F.when(F.col("event_id") % 2 == 0, "annotate").otherwise("relate"))
        named = lambda n: F.concat(F.lit("Customer#"), F.lpad(n.cast("string"), 9, "0"))
        log = e.select(F.col("event_id").alias("pos"), op.alias("op"), named(F.col("user_id")).alias("name"), named(F.col("event_id") * 7 % 200).alias("other"), F.when(kind == "signup", "account").otherwise("knows").alias("kind"))
        # Entities and relations are read once or not at all, so they needn't be stored first.
        entity, relation = (g.__dict__[t] if t in g.__dict__ else getattr(Graph(g.spark, g.sf_dir), t) for t in ("entity", "relation"))
        g.__dict__["mutation_log"] = apply_log(entity, relation, log, 8_000_000_000)
    return g.__dict__["mutation_log"]


@query("mut_log_outcome", _FOLD + """
SELECT pos, CASE WHEN op = 'create' THEN CASE WHEN a = -1 THEN 'done' ELSE 'known' END WHEN a = -1 THEN 'unknown' WHEN op IN ('delete', 'annotate') THEN 'done' WHEN op = 'rename' THEN CASE WHEN b = -1 THEN 'done' ELSE 'taken' END
  WHEN b = -1 THEN 'unknown' WHEN op = 'relate' THEN CASE WHEN live THEN 'known' ELSE 'done' END ELSE CASE WHEN live THEN 'done' ELSE 'absent' END END AS outcome
FROM r LEFT JOIN (SELECT pos, live FROM t) USING (pos)""")
def mut_log_outcome(g):
    return _log(g)["outcome"]


@query("mut_log_entities", _FOLD + "SELECT * FROM after")
def mut_log_entities(g):
    return _log(g)["entity"]


@query("mut_log_relations", _FOLD + "SELECT * FROM left_")
def mut_log_relations(g):
    return _log(g)["relation"]


@query("mut_log_events", _FOLD + """
SELECT pos, CASE WHEN op = 'create' THEN 8000000000 + pos ELSE a END AS entity_id, CASE WHEN op IN ('create', 'delete') THEN op ELSE 'update' END AS operation, CAST(op = 'annotate' AS INTEGER) AS quiet
FROM r WHERE (op = 'create' AND a = -1) OR (op IN ('delete', 'annotate') AND a <> -1) OR (op = 'rename' AND a <> -1 AND b = -1)
UNION ALL SELECT DISTINCT pos, unnest([a, b]), 'update', 0 FROM t WHERE live <> (op = 'relate')""")
def mut_log_events(g):
    return _log(g)["event"]


@query("mut_log_counters", _FOLD + """
SELECT kind, type, CAST(sum(n) AS BIGINT) AS change FROM (
  SELECT 'entity' AS kind, entity_type AS type, 1 AS n FROM after UNION ALL SELECT 'entity', entity_type, -1 FROM entity
  UNION ALL SELECT 'relation', relation_type, 1 FROM left_ UNION ALL SELECT 'relation', relation_type, -1 FROM relation) GROUP BY kind, type HAVING sum(n) <> 0""")
def mut_log_counters(g):
    return _log(g)["counter"]


@query("mut_relation_deltas", """
g AS (SELECT * FROM relation WHERE relation_type = 'in_nation' AND from_id % 2 = 0), c AS (SELECT from_id, from_id AS to_id, 'self' AS relation_type FROM relation WHERE relation_type = 'in_nation');;
SELECT from_id AS id, *, 'delete' AS operation FROM g UNION ALL SELECT to_id, *, 'delete' FROM g UNION ALL SELECT from_id, *, 'create' FROM c""")
def mut_relation_deltas(g):
    r = g.relation
    after = r.filter("NOT (relation_type = 'in_nation' AND from_id % 2 = 0)").union(r.filter("relation_type = 'in_nation'").select("from_id", F.col("from_id").alias("to_id"), F.lit("self")))
    return M.relation_deltas(r, after)


for _name in ("mut_merge_observations", "mut_add_obs", "mut_upsert_obs", "mut_edit_obs"):
    also(f"{_name}_whole", _name if _name == "mut_merge_observations" else f"{_name}_result")
