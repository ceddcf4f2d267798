"""Queries of leased jobs, attachment and subscription records, machine accounts and type suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import access as W
from graphloom.operators import jobs as J
from graphloom.operators import subscriptions as P
from graphloom.operators import taxonomy as X
from graphloom.plans.registry import query
from graphloom.sources import attachments as T

_JOBS = """job AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'leased' WHEN 1 THEN 'done' ELSE 'pending' END AS state, event_id % 97 AS next_attempt,
  event_id % 5 AS epoch, event_id % 61 AS lease_until, event_id % 9 AS attempts FROM events)"""
_SHOWN = ["event_id", "state", "next_attempt", "epoch", "lease_until", "attempts"]
_KEY = ["event_id"]


def _jobs(g):
    n = F.col("event_id")
    state = F.when(n % 4 == 0, "leased").when(n % 4 == 1, "done").otherwise("pending")
    return g.table("events").select(n, state.alias("state"), (n % 97).alias("next_attempt"), (n % 5).alias("epoch"), (n % 61).alias("lease_until"), (n % 9).alias("attempts"), F.lit(None).cast("string").alias("last_error"))


@query("job_claim", _JOBS + """,
f AS (SELECT event_id FROM job WHERE attempts < 8 AND ((state = 'pending' AND next_attempt <= 30) OR (state = 'leased' AND lease_until <= 30)) ORDER BY next_attempt, event_id LIMIT 200);;
SELECT event_id, CASE WHEN event_id IN (FROM f) THEN 'leased' ELSE state END AS state, next_attempt, epoch + CAST(event_id IN (FROM f) AS INTEGER) AS epoch,
  CASE WHEN event_id IN (FROM f) THEN 50 ELSE lease_until END AS lease_until, attempts + CAST(event_id IN (FROM f) AS INTEGER) AS attempts FROM job""")
def job_claim(g):
    return J.claim(_jobs(g), _KEY, 30, 20, 200, J.ATTEMPTS).select(_SHOWN)


@query("job_renew", _JOBS + ";;SELECT event_id, state, next_attempt, epoch, CASE WHEN state = 'leased' AND epoch = 2 AND lease_until > 30 THEN 50 ELSE lease_until END AS lease_until, attempts FROM job")
def job_renew(g):
    """Every job's worker reports epoch 2."""
    return J.renew(_jobs(g), _jobs(g).select("event_id", F.lit(2).cast("long").alias("epoch")), _KEY, 30, 20).select(_SHOWN)


_HELD = "state = 'leased' AND epoch = 2 AND lease_until > 30"


@query("job_retry", _JOBS + f""";;
SELECT event_id, CASE WHEN {_HELD} THEN CASE WHEN attempts >= 8 OR event_id % 7 = 0 THEN 'dead' ELSE 'pending' END ELSE state END AS state,
  CASE WHEN {_HELD} THEN 99 ELSE next_attempt END AS next_attempt, epoch, lease_until, attempts FROM job""")
def job_retry(g):
    said = _jobs(g).select("event_id", F.lit(2).cast("long").alias("epoch"), F.lit(99).cast("long").alias("next_attempt"), F.lit("late").alias("error"), (F.col("event_id") % 7 == 0).alias("dead"))
    return J.retry(_jobs(g), said, _KEY, 30, J.ATTEMPTS).select(_SHOWN)


@query("job_exhaust", _JOBS + ";;SELECT event_id, CASE WHEN state = 'leased' AND lease_until <= 30 AND attempts >= 8 THEN 'dead' ELSE state END AS state, next_attempt, epoch, lease_until, attempts FROM job")
def job_exhaust(g):
    return J.exhaust(_jobs(g), 30).select(_SHOWN)


_COMPLETED = """d AS (SELECT doc_id, doc_id % 3 = 0 AND doc_id % 4 <> 1 AND doc_id % 5 <> 2 AS ok, text FROM documents)"""


def _completed(g):
    """Documents as attachments: every third is reported, some with a lost lease or an old revision."""
    d, n = g.table("documents"), F.col("doc_id")
    jobs = d.select(n.alias("attachment_id"), F.lit("leased").alias("state"), F.lit(0).alias("next_attempt"), F.lit(1).alias("epoch"), F.when(n % 4 == 1, 5).otherwise(50).alias("lease_until"), F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("last_error"))
    attachments = d.select(n.alias("attachment_id"), F.when(n % 5 == 2, 3).otherwise(2).alias("revision"), F.lit("extracting").alias("status"))
    reports = d.filter(n % 3 == 0).select(n.alias("attachment_id"), F.lit(1).alias("epoch"), F.lit(2).alias("revision"))
    return J.complete(jobs, attachments, reports, 30)


@query("attachment_complete", _COMPLETED + ";;SELECT doc_id AS attachment_id, CASE WHEN ok THEN 3 WHEN doc_id % 5 = 2 THEN 3 ELSE 2 END AS revision, CASE WHEN ok THEN 'ready' ELSE 'extracting' END AS status FROM d")
def attachment_complete(g):
    return _completed(g)[1]


@query("attachment_complete_segments", _COMPLETED + """,
p AS (SELECT doc_id, 1 AS page, substring(text, 1, 2000) AS t FROM d WHERE ok UNION ALL SELECT doc_id, 2, substring(text, 2001) FROM d WHERE ok),
s AS (SELECT *, unnest(range(0, CAST(ceil(length(t) / 1600.0) AS BIGINT))) AS i FROM p);;
SELECT doc_id AS attachment_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS chunk_index, page, i AS segment_index, substring(t, i * 1600 + 1, 1600) AS text FROM s""")
def attachment_complete_segments(g):
    """Each text as two pages, the first of 2,000 characters, cut on completion."""
    d = g.table("documents").select(F.col("doc_id").alias("attachment_id"), "text")
    pages = d.select("attachment_id", F.lit(1).alias("page"), F.substring("text", 1, 2000).alias("text")).union(d.select("attachment_id", F.lit(2), F.expr("substring(text, 2001)")))
    none = g.spark.createDataFrame([], "attachment_id long, chunk_index long, page int, segment_index long, text string")
    return J.replace_segments(none, pages, _completed(g)[2], T.SEGMENT)


def _attachments(g):
    return g.table("documents").select(F.col("doc_id").alias("attachment_id"), (F.lit(6_000_000_000) + F.floor(F.col("doc_id") / 4)).cast("long").alias("entity_id"), F.col("n_chars").alias("bytes"))


@query("attachment_list", "SELECT doc_id AS attachment_id, CAST(6000000003 AS BIGINT) AS entity_id, n_chars AS bytes FROM documents WHERE doc_id // 4 = 3")
def attachment_list(g):
    return T.attachments_of(_attachments(g), g.entity, "doc:3")


@query("attachment_get", "SELECT doc_id AS attachment_id, CAST(6000000003 AS BIGINT) AS entity_id, n_chars AS bytes, 'doc:3' AS entity_name FROM documents WHERE doc_id = 13")
def attachment_get(g):
    return T.get_attachment(_attachments(g), g.entity, 13)


@query("attachment_delete", "s AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 1600.0) AS BIGINT))) AS chunk_index FROM documents);;SELECT doc_id AS attachment_id, chunk_index FROM s WHERE doc_id % 3 <> 0")
def attachment_delete(g):
    chunks = T.segments(g.table("documents").select(F.col("doc_id").alias("id"), "text")).select(F.col("id").alias("attachment_id"), "chunk_index")
    return T.delete_attachments(_attachments(g).filter("attachment_id % 3 = 0"), chunks=chunks)["chunks"]


def _subscriptions(g):
    known = [(f"s{i}", f"https://a.example/{i}", ["create"], [], [], "own", "ref", True, 10 - i, 10 - i) for i in range(3)]
    fields = "endpoint string, operations array<string>, types array<string>, ignored_origins array<string>, own_origin string, secret_ref string, enabled boolean"
    new = [(i, s, f"https://b.example/{i}", [], ["part"], [], "own", "ref", False) for i, s in enumerate(["s1", "s1", "s7"])]
    return g.spark.createDataFrame(known, f"subscription_id string, {fields}, created_at long, updated_at long"), g.spark.createDataFrame(new, f"pos int, subscription_id string, {fields}")


@query("subscription_upsert", "SELECT * FROM (VALUES ('s0', 'https://a.example/0', true, 10, 10), ('s1', 'https://b.example/1', false, 9, 50), ('s2', 'https://a.example/2', true, 8, 8), ('s7', 'https://b.example/2', false, 50, 50)) AS v(subscription_id, endpoint, enabled, created_at, updated_at)")
def subscription_upsert(g):
    return P.oldest_first(P.upsert(*_subscriptions(g), 50)).select("subscription_id", "endpoint", "enabled", "created_at", "updated_at")


@query("subscription_delete", "SELECT * FROM (VALUES ('s1', true), ('s7', false)) AS v(subscription_id, deleted)")
def subscription_delete(g):
    known, new = _subscriptions(g)
    return P.delete(known, new)[1]


@query("observations_plain", "SELECT entity_id, body FROM observation")
def observations_plain(g):
    """Each body as a JSON list of texts, read as observations and given back as texts."""
    raw = g.observation.select("entity_id", F.to_json(F.array("body")).alias("raw"))
    return raw.select("entity_id", F.explode(P.observations_out(P.observations_in(F.col("raw")))).alias("body"))


_MACHINES = """machine AS (SELECT 'machine:' || s_suppkey AS principal_id, s_suppkey % 5 = 0 AS revoked, CASE s_suppkey % 3 WHEN 0 THEN ['code'] WHEN 1 THEN ['graph-read', 'vectors'] ELSE ['graph-write'] END AS scopes, s_suppkey AS k FROM supplier)"""


def _machines(g):
    k = F.col("s_suppkey")
    scopes = F.when(k % 3 == 0, F.array(F.lit("code"))).when(k % 3 == 1, F.array(F.lit("vectors"), F.lit("graph-read"), F.lit("vectors"))).otherwise(F.array(F.lit("graph-write")))
    new = g.table("supplier").select(F.concat(F.lit("machine:"), k.cast("string")).alias("principal_id"), F.col("s_name").alias("name"), scopes.alias("scopes"), F.concat(F.lit("token"), k.cast("string")).alias("token"))
    none = g.spark.createDataFrame([], "principal_id string, name string, scopes array<string>, token_digest string, revoked boolean")
    machines, _ = W.add_machines(none, new)
    return machines.withColumn("revoked", F.substring("principal_id", 9, 20).cast("long") % 5 == 0)


@query("machine_authenticate", _MACHINES + ";;SELECT c_custkey AS request_id, principal_id, array_to_string(scopes, ',') AS scopes FROM customer JOIN machine ON k = c_custkey WHERE NOT revoked")
def machine_authenticate(g):
    requests = g.table("customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("token"), F.col("c_custkey").cast("string")).alias("token"))
    return W.authenticated(requests, _machines(g)).withColumn("scopes", F.array_join("scopes", ","))


@query("machine_revoke", _MACHINES + ";;SELECT principal_id, revoked OR (k % 2 = 0 AND k <> 4) AS revoked FROM machine")
def machine_revoke(g):
    gone = _machines(g).filter("substring(principal_id, 9) % 2 = 0").select("principal_id")
    workspaces = g.spark.createDataFrame([("w", "machine:4")], "workspace_id string, owner string")
    grants = g.spark.createDataFrame([("w", "machine:2", "reader")], "workspace_id string, principal string, role string")
    return W.list_machines(W.revoke_machines(_machines(g), workspaces, grants, gone)[0]).select("principal_id", "revoked")


@query("scope_gate", _MACHINES + """,
c AS (SELECT event_id AS call_id, 'machine:' || user_id AS principal_id, CASE event_type WHEN 'view' THEN 'graph-read' WHEN 'click' THEN 'vectors' WHEN 'purchase' THEN 'graph-write' END AS scope FROM events);;
SELECT call_id, coalesce(list_contains(scopes, scope), false) AS allowed, CASE WHEN NOT coalesce(list_contains(scopes, scope), false) THEN scope END AS missing FROM c LEFT JOIN machine USING (principal_id)""")
def scope_gate(g):
    calls = g.table("events").select(F.col("event_id").alias("call_id"), F.concat(F.lit("machine:"), F.col("user_id").cast("string")).alias("principal_id"), F.col("event_type").alias("tool"))
    tools = g.spark.createDataFrame([("view", "graph-read"), ("click", "vectors"), ("purchase", "graph-write")], "tool string, scope string")
    return W.allowed_calls(calls, _machines(g), tools)


def _similar(g, words, known):
    return X.similar_types(X.unknown_types(g.spark.createDataFrame([(w,) for w in words], "typed string"), known), known)


@query("taxonomy_enrich_entities", """
h AS (SELECT name, entity_type, row_number() OVER (PARTITION BY entity_type ORDER BY id) AS place FROM entity WHERE entity_type = 'customer' OR entity_type = 'supplier');;
SELECT CASE entity_type WHEN 'customer' THEN 'customr' ELSE 'suplier' END AS typed, name, entity_type FROM h WHERE place <= 3""")
def taxonomy_enrich_entities(g):
    known = g.entity.groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return X.example_entities(_similar(g, ["customr", "suplier", "part"], known), g.entity, g.observation)


@query("taxonomy_enrich_relations", """
h AS (SELECT *, row_number() OVER (ORDER BY from_id, to_id) AS place FROM relation WHERE relation_type = 'supplies');;
SELECT 'suplies' AS typed, from_id, relation_type, to_id FROM h WHERE place <= 3""")
def taxonomy_enrich_relations(g):
    known = g.relation.groupBy(F.col("relation_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return X.example_relations(_similar(g, ["suplies", "bought"], known), g.relation)
