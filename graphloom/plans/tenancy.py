"""Queries of attachments, chunk documents and workspaces. A document's source is its workspace."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import access as W
from graphloom.operators import reads as R
from graphloom.plans.registry import query
from graphloom.sources import attachments as T
from graphloom.streaming import events


def _pages(g):
    return g.table("documents").select(F.col("doc_id").alias("id"), "text")


@query("attachment_segments", "p AS (SELECT doc_id AS id, text, unnest(range(0, CAST(ceil(length(text) / 1600.0) AS BIGINT))) AS chunk_index FROM documents);;SELECT id, chunk_index, substring(text, chunk_index * 1600 + 1, 1600) AS segment FROM p")
def attachment_segments(g):
    return T.segments(_pages(g))


@query("attachment_page_window", 'SELECT doc_id AS id, substring(text, 101, 500) AS "window", length(text) <= 600 AS eof FROM documents')
def attachment_page_window(g):
    return T.page_window(_pages(g), 100, 500)


@query("attachment_hashes", "SELECT doc_id AS id, strlen(text) AS n_bytes, sha256(text) AS sha256 FROM documents")
def attachment_hashes(g):
    content = F.encode("text", "utf-8")
    return _pages(g).select("id", F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("sha256"))


@query("upload_budget", "SELECT source AS owner, CAST(sum(n_chars) + coalesce(sum(n_chars) FILTER (doc_id % 7 > 3), 0) AS BIGINT) AS used FROM documents GROUP BY source")
def upload_budget(g):
    """Stored bytes of each source, and as many reserved for documents whose reservation runs past time 3."""
    d = g.table("documents")
    files = d.select(F.col("source").alias("owner"), F.col("n_chars").alias("bytes"))
    return T.storage_used(files, d.select(F.col("source").alias("owner"), F.col("n_chars").alias("bytes"), (F.col("doc_id") % 7).alias("expires")), 3)


@query("upload_complete", """
u AS (SELECT l_orderkey AS upload_id, count(*) AS n FROM lineitem GROUP BY l_orderkey);;
SELECT upload_id, upload_id % 5 <> 0 AND (upload_id % 3 <> 0 OR n = 1) AS complete FROM u""")
def upload_complete(g):
    """Line items as chunks of ten bytes; every fifth upload declares one byte more, every third has a gap."""
    items = g.table("lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").cast("long").alias("n"))
    sizes = items.groupBy("upload_id").agg(F.count(F.lit(1)).alias("n"))
    gap = F.when((F.col("upload_id") % 3 == 0) & (F.col("i") > 0), 10).otherwise(0)
    chunks = sizes.select("upload_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("upload_id", (F.col("i") * 10 + gap).alias("offset"), F.lit(10).cast("long").alias("bytes"))
    declared = sizes.select("upload_id", (F.col("n") * 10 + F.when(F.col("upload_id") % 5 == 0, 1).otherwise(0)).alias("bytes"))
    return T.complete_uploads(chunks.union(chunks.filter("offset = 0")), declared)


@query("chunk_documents", "SELECT id AS owner_id, 'identity' AS kind, 0 AS chunk_index, name || chr(10) || entity_type AS text FROM entity UNION ALL SELECT entity_id, 'observation', idx, body FROM observation")
def chunk_documents(g):
    return T.entity_documents(g.entity, g.observation)


@query("type_documents", """
s AS (SELECT DISTINCT relation_type, a.entity_type AS f, b.entity_type AS t FROM relation JOIN entity a ON a.id = from_id JOIN entity b ON b.id = to_id);;
SELECT relation_type, relation_type || chr(10) || string_agg(f || '>' || t, chr(10) ORDER BY f, t) AS text FROM s GROUP BY relation_type""")
def type_documents(g):
    rows = R.type_signatures(g.relation, g.entity).groupBy("relation_type").agg(F.array_sort(F.collect_list(F.struct("from_type", "to_type"))).alias("s"))
    shapes = F.transform("s", lambda x: F.concat(x["from_type"], F.lit(">"), x["to_type"]))
    return rows.select("relation_type", F.array_join(F.concat(F.array("relation_type"), shapes), "\n").alias("text"))


_GRANTS = [("src1", "ann", "reader"), ("src1", "ann", "writer"), ("src2", "ann", "reader"), ("src3", "bob", "writer")]
_WORKSPACES = "w AS (SELECT source AS workspace_id, CASE WHEN source = 'src0' THEN 'ann' ELSE 'bob' END AS owner, source IN ('src5', 'src6') AS public FROM documents GROUP BY source)"
_ROLES = _WORKSPACES + """, r AS (SELECT workspace_id, CASE WHEN owner = 'ann' THEN 'owner' WHEN workspace_id = 'src1' THEN 'writer' WHEN workspace_id = 'src2' OR public THEN 'reader' END AS role FROM w)"""


def _roles(g):
    w = g.table("documents").groupBy(F.col("source").alias("workspace_id")).agg(F.lit(1).alias("one"))
    w = w.select("workspace_id", F.when(F.col("workspace_id") == "src0", "ann").otherwise("bob").alias("owner"), F.col("workspace_id").isin("src5", "src6").alias("public"))
    return W.access(w, g.spark.createDataFrame(_GRANTS, "workspace_id string, principal string, role string"), "ann")


@query("workspace_acl", _ROLES + ";;SELECT * FROM r WHERE role IS NOT NULL")
def workspace_acl(g):
    return _roles(g)


@query("workspace_writable_documents", _ROLES + ";;SELECT doc_id, source FROM documents WHERE source IN (SELECT workspace_id FROM r WHERE role IN ('owner', 'writer'))")
def workspace_writable_documents(g):
    return W.visible(g.table("documents").select("doc_id", "source"), W.can_write(_roles(g)), "source").select("doc_id", "source")


@query("workspace_page", _ROLES + ";;SELECT * FROM r WHERE role IS NOT NULL AND workspace_id > 'src0' ORDER BY workspace_id LIMIT 3")
def workspace_page(g):
    return W.keyset_page(_roles(g), "workspace_id", "src0", 3)[0]


@query("relation_documents", """
m AS (SELECT s_suppkey AS relation_id, CAST(4000000000 + s_suppkey AS BIGINT) AS from_id, CAST(2000000000 + s_nationkey AS BIGINT) AS to_id FROM supplier WHERE s_suppkey % 4 <> 0);;
SELECT relation_id AS owner_id, 'relation' AS kind, 0 AS chunk_index, a.name || chr(10) || 'in_nation' || chr(10) || b.name || chr(10) || body AS text
FROM m JOIN entity a ON a.id = from_id JOIN entity b ON b.id = to_id JOIN relation_observation USING (from_id, to_id)""")
def relation_documents(g):
    mirror = g.relation_observation.select((F.col("from_id") - 4_000_000_000).alias("relation_id"), "from_id", "to_id", "relation_type", (F.col("from_id") % 4 == 0).alias("deleted"))
    return T.relation_documents(mirror, g.entity, g.relation_observation)


def _stored_files(g):
    content = F.encode("text", "utf-8")
    return g.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length(content).cast("long").alias("length"), content.alias("content"), F.sha2(content, 256).alias("sha256"))


@query("attachment_verified", "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 = 0")
def attachment_verified(g):
    """Every third declaration is right, the others have another length or hash."""
    f, k = _stored_files(g), F.col("path").cast("long") % 3
    declared = f.select("path", (F.col("length") + F.when(k == 1, 1).otherwise(0)).alias("length"), F.when(k == 2, "00").otherwise(F.col("sha256")).alias("sha256"))
    return T.verified(f, declared).select("path")


@query("attachment_bytes", "SELECT CAST(doc_id AS VARCHAR) AS path, lower(hex(encode(text)[8:107])) AS bytes FROM documents")
def attachment_bytes(g):
    return _stored_files(g).select("path", F.lower(F.hex(T.byte_range(F.col("content"), 7, 100))).alias("bytes"))


@query("attachment_text", r"SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 <> 0 THEN replace(text, chr(13) || chr(10), chr(10)) END AS text FROM documents")
def attachment_text(g):
    """Texts with a byte order mark and Windows line ends; every fifth is no UTF-8."""
    mark = F.lit(b"\xef\xbb\xbf")
    raw = F.concat(mark, F.encode(F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("\r\n")), "utf-8"))
    broken = F.when(F.col("doc_id") % 5 == 0, F.concat(raw, F.lit(b"\xff"))).otherwise(raw)
    return g.table("documents").select(F.col("doc_id").cast("string").alias("path"), T.file_text(broken).alias("text"))


@query("attachment_faults", """
n AS (SELECT doc_id AS pos, CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'same' ELSE 'new' || doc_id || '.txt' END AS filename, CASE doc_id % 5 WHEN 0 THEN 'video/mp4' ELSE 'text/plain' END AS mime,
  CASE doc_id % 7 WHEN 0 THEN 1001 WHEN 1 THEN -1 ELSE 1000 END AS bytes, doc_id % 11 <> 4 AS known, doc_id % 13 = 5 AS held FROM documents),
f AS (SELECT *, CASE WHEN filename = ' ' AND NOT held THEN 'filename' WHEN mime <> 'text/plain' THEN 'mime' WHEN bytes NOT BETWEEN 0 AND 1000 THEN 'size' WHEN NOT known THEN 'entity' WHEN held THEN 'duplicate' END AS fault FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY known, held, filename, fault IS NULL, CASE WHEN held OR filename <> 'same' THEN pos END ORDER BY pos) AS turn FROM f);;
SELECT pos, CASE WHEN fault IS NULL THEN 'duplicate' ELSE fault END AS fault FROM t WHERE fault IS NOT NULL OR turn > 1""")
def attachment_faults(g):
    """New files for one entity, some of no name, a wrong type or size, an unknown entity, or a name that is held."""
    d, k = g.table("documents"), F.col("doc_id")
    own = F.concat(F.lit("file"), k.cast("string"), F.lit(".txt"))
    name = F.when(k % 13 == 5, own).when(k % 6 == 0, " ").when(k % 6 == 1, "same").otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit(".txt")))
    entity_id = F.when(k % 11 == 4, F.lit(42).cast("long")).when(k % 13 == 5, F.lit(6_000_000_000).cast("long") + F.floor(k / 4)).otherwise(F.lit(1_000_000_001).cast("long"))
    new = d.select(k.alias("pos"), entity_id.alias("entity_id"), name.alias("filename"), F.when(k % 5 == 0, "video/mp4").otherwise("text/plain").alias("mime"), F.when(k % 7 == 0, 1001).when(k % 7 == 1, -1).otherwise(1000).alias("bytes"))
    return T.upload_faults(new, g.attachment, g.entity, ["text/*", "image/png"], 1000)


@query("upload_sweep", "SELECT event_id AS upload_id, event_id * 10 AS chunk FROM events WHERE event_id % 5 >= 3")
def upload_sweep(g):
    """Sessions whose last chunk is older than an hour go, and their chunks with them."""
    e, n = g.table("events"), F.col("event_id")
    uploads = e.select(n.alias("upload_id"), ((n % 5) * 1_800_000_000).cast("long").alias("touched"))
    return T.live_uploads(uploads, e.select(n.alias("upload_id"), (n * 10).alias("chunk")), 7_200_000_000)[1]


_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in b"key".ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query("delivery_envelopes", f"""
b AS (SELECT event_id AS delivery_id, '{{"version":3,"delivery_id":' || event_id || ',"kind":"' || event_type || '"}}' AS body FROM events WHERE event_id % 10 <> 0);;
SELECT delivery_id, body, sha256(CAST('{_OUTER}' AS BLOB) || unhex(sha256(CAST('{_INNER}' AS BLOB) || encode(body)))) AS signature FROM b""")
def delivery_envelopes(g):
    """Signed envelopes; every tenth is too large and is refused."""
    n = F.col("event_id")
    kind = F.when(n % 10 == 0, F.repeat(F.lit("x"), events.ENVELOPE_BYTES)).otherwise(F.col("event_type"))
    return events.envelopes(g.table("events").select(n.alias("delivery_id"), kind.alias("kind")), "key")


_ASKED = """
w AS (SELECT source AS workspace_id, 'o' || CAST(substr(source, 4) AS INTEGER) % 3 AS owner FROM documents WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT p_partkey AS request_id, 'o' || p_partkey % 3 AS principal, 'src' || p_partkey % 20 AS workspace_id, 's' || p_partkey % 7 AS grantee, CASE p_partkey % 4 WHEN 1 THEN 'writer' WHEN 2 THEN 'owner' ELSE 'reader' END AS role FROM part),
k AS (SELECT r.* FROM r JOIN w USING (workspace_id) WHERE w.owner = principal AND role <> 'owner' AND grantee IN ('s0', 's1', 's2', 's3', 's4')),
n AS (SELECT workspace_id, grantee AS principal, arg_max(role, request_id) AS role FROM k GROUP BY ALL), old AS (SELECT 'src1' AS workspace_id, 's1' AS principal, 'reader' AS role UNION ALL SELECT 'src2', 'zed', 'writer');;"""


@query("workspace_grants", _ASKED + "SELECT * FROM n UNION ALL SELECT * FROM old WHERE (workspace_id, principal) NOT IN (SELECT (workspace_id, principal) FROM n)")
def workspace_grants(g):
    """Roles asked for by many: only owners give valid roles to registered principals, the last one holds."""
    w = g.table("documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("workspace_id")).agg(F.lit(1).alias("one"))
    w = w.select("workspace_id", F.concat(F.lit("o"), (F.expr("substring(workspace_id, 4)").cast("int") % 3).cast("string")).alias("owner"))
    k = F.col("p_partkey")
    text = lambda mark, n: F.concat(F.lit(mark), (k % n).cast("string"))
    requests = g.table("part").select(k.alias("request_id"), text("o", 3).alias("principal"), text("src", 20).alias("workspace_id"), text("s", 7).alias("grantee"), F.when(k % 4 == 1, "writer").when(k % 4 == 2, "owner").otherwise("reader").alias("role"))
    old = g.spark.createDataFrame([("src1", "s1", "reader"), ("src2", "zed", "writer")], "workspace_id string, principal string, role string")
    registered = g.spark.createDataFrame([(f"s{i}",) for i in range(5)], "principal string")
    return W.grant(old, requests, w, registered)[0]
