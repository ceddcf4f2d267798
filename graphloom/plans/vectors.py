"""Queries of vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import fulltext as T
from graphloom.operators import vectors as V
from graphloom.plans.code import embedded_sql
from graphloom.plans.registry import query
from graphloom.plans.search import TOKENS, ranked_sql
from graphloom.sources.attachments import segments

_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1] * x[2]))"
_COS = f"1.0 - {_DOT} / (sqrt({_DOT.format('{0}', '{0}')}) * sqrt({_DOT.format('{1}', '{1}')}))"
_L2 = "list_sum(list_transform(list_zip({0}, {1}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_IP = f"-{_DOT}"
_Q = "q AS (SELECT embedding AS q FROM chunk_vector WHERE vec_id = 0)"
_D = _Q + ", d AS (SELECT c.*, round({0}, 6) + 0.0 AS distance FROM chunk_vector c, q)"


def _query(g, vec_id: int = 0):
    return g.chunk_vector.filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


for _name, _form in (("cosine", _COS), ("l2", _L2), ("ip", _IP)):
    query(f"vec_topk_{_name}", _D.format(_form.format("embedding", "q")) + ";;SELECT vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 50")(
        lambda g, m=_name: V.top_k(V.scored(g.chunk_vector, _query(g), m), 50, "vec_id").select("vec_id", "distance"))

_BEST = _D.format(_COS.format("embedding", "q")) + ", b AS (SELECT owner_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY distance, vec_id) AS place FROM d) WHERE place = 1)"


@query("vec_best_chunk_per_owner", _BEST + ";;SELECT * FROM b")
def vec_best_chunk_per_owner(g):
    return V.best_per_owner(V.scored(g.chunk_vector, _query(g)))


@query("vec_near_entities", _BEST + ";;SELECT * FROM b ORDER BY distance, owner_id LIMIT 25")
def vec_near_entities(g):
    return V.near_entities(g.chunk_vector, _query(g), 25)


@query("vec_filter_type", _D.format(_COS.format("embedding", "q")) + ";;SELECT vec_id, distance FROM d WHERE kind = 'observation' AND label = 3 ORDER BY distance, vec_id LIMIT 20")
def vec_filter_type(g):
    """Filters come before the ranking."""
    rows = g.chunk_vector.filter((F.col("kind") == "observation") & (F.col("label") == 3))
    return V.top_k(V.scored(rows, _query(g)), 20, "vec_id").select("vec_id", "distance")


@query("vec_by_entity", f"""
q AS (SELECT owner_id AS own, embedding AS q FROM chunk_vector WHERE owner_id = 6000000005 AND kind = 'identity'),
d AS (SELECT c.owner_id, vec_id, round({_COS.format('embedding', 'q')}, 6) + 0.0 AS distance FROM chunk_vector c, q WHERE owner_id <> own),
b AS (SELECT owner_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY distance, vec_id) AS place FROM d) WHERE place = 1);;
SELECT * FROM b ORDER BY distance, owner_id LIMIT 10""")
def vec_by_entity(g):
    """Nearest owners to the identity chunk of one, itself left out."""
    own = 6_000_000_005
    q = g.chunk_vector.filter((F.col("owner_id") == own) & (F.col("kind") == "identity")).select(F.col("embedding").alias("q"))
    return V.near_entities(g.chunk_vector.filter(F.col("owner_id") != own), q, 10)


@query("vec_all_pairs_topk", f"""
p AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) + 0.0 AS distance FROM chunk_vector a, chunk_vector b WHERE a.vec_id % 50 = 0);;
SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM p) WHERE place <= 5""")
def vec_all_pairs_topk(g):
    """Every 50th vector as a query against all."""
    queries = g.chunk_vector.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.knn(g.chunk_vector, queries, 5)


@query("vec_ann_topk")
def vec_ann_topk(g):
    """The ten nearest of every 50th vector from as many cells as nine tenths of them need, by measurement."""
    queries = g.chunk_vector.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return g.vector_index.search(queries, 10, g.vector_index.probes_for(queries, 10))


@query("vec_ann_all_cells", f"""
p AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) + 0.0 AS distance FROM chunk_vector a, chunk_vector b WHERE a.vec_id % 50 = 0 AND b.kind = 'observation' AND b.label < 5);;
SELECT query_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM p) WHERE place <= 10""")
def vec_ann_all_cells(g):
    """With all cells probed the index is exact; filters come before the ranking."""
    queries = g.chunk_vector.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return g.vector_index.search(queries, 10, len(g.vector_index.centres), (F.col("kind") == "observation") & (F.col("label") < 5))


_SPOILT = """CASE vec_id % 9 WHEN 1 THEN embedding[1:32] WHEN 4 THEN list_transform(embedding, lambda x: 2 * x) WHEN 7 THEN list_transform(embedding, lambda x: x / 0.0) ELSE embedding END"""


@query("vec_validate", f"""
v AS (SELECT vec_id, {_SPOILT} AS e FROM chunk_vector);;
SELECT vec_id, CASE WHEN len(e) <> 64 THEN 'length' WHEN len(list_filter(e, lambda x: NOT isfinite(x))) > 0 THEN 'finite' ELSE 'norm' END AS fault
FROM v WHERE len(e) <> 64 OR len(list_filter(e, lambda x: NOT isfinite(x))) > 0 OR abs({_DOT.format('e', 'e')} - 1) > 1e-4""")
def vec_validate(g):
    """Of the stored vectors some are cut, stretched or made infinite first."""
    at, e = F.col("vec_id") % 9, F.col("embedding")
    spoilt = F.when(at == 1, F.slice(e, 1, 32)).when(at == 4, F.transform(e, lambda x: x * 2)).when(at == 7, F.transform(e, lambda x: x * float("inf"))).otherwise(e)
    return V.invalid_vectors(g.chunk_vector.withColumn("embedding", spoilt), 64)


@query("vector_store_stats", "SELECT count(*) AS n, count(DISTINCT owner_id) AS n_owners, CAST(max(len(embedding)) AS BIGINT) AS dimensions FROM chunk_vector")
def vector_store_stats(g):
    return g.chunk_vector.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("owner_id").alias("n_owners"), F.max(F.size("embedding")).cast("long").alias("dimensions"))


def _text_list(g, query: str, k: int):
    """Owners of the observations that a query finds, by their best rank."""
    found = T.find_ranked(g.word, query, g.word_totals).groupBy(F.col("owner").alias("owner_id")).agg(F.min("rank").alias("fts"))
    return V.ranked(found, k, "fts", "owner_id")


def _lists(g):
    return _text_list(g, "the that OR name + red", 30), V.ranked(V.best_per_owner(V.scored(g.chunk_vector, _query(g))), 30, "distance", "owner_id")


_FOUND = ranked_sql("observation", TOKENS.format("body"), [(["the"], False), (["that"], False), (["name", "red"], False)], "(len(s0) > 0 AND len(s1) > 0) OR len(s2) > 0", "entity_id, idx")
_TEXT = """tl AS (SELECT owner_id, row_number() OVER (ORDER BY fts, owner_id) - 1 AS rank FROM (SELECT entity_id AS owner_id, min(rank) AS fts FROM r GROUP BY entity_id) ORDER BY fts, owner_id LIMIT {})"""
_LISTS = _BEST + ", " + _FOUND + ", " + _TEXT.format(30) + """,
v AS (SELECT owner_id, row_number() OVER (ORDER BY distance, owner_id) - 1 AS rank FROM (SELECT * FROM b ORDER BY distance, owner_id LIMIT 30)),
f AS (SELECT owner_id, coalesce(CAST(0.5 AS DOUBLE) / (60 + tl.rank), 0.0) AS text_score, coalesce(CAST(0.5 AS DOUBLE) / (60 + v.rank), 0.0) AS vec_score FROM tl FULL JOIN v USING (owner_id))"""


@query("hybrid_rrf", _LISTS + ";;SELECT owner_id, round(text_score, 9) AS text_score, round(vec_score, 9) AS vec_score, round(text_score + vec_score, 9) AS score FROM f")
def hybrid_rrf(g):
    rows = V.reciprocal_rank_fusion(*_lists(g))
    return rows.select("owner_id", *[F.round(c, 9).alias(c) for c in ("text_score", "vec_score", "score")])


@query("hybrid_rrf_boosted", _LISTS + """,
n AS (SELECT CAST(owner_id AS BIGINT) AS id, count(DISTINCT label) AS n FROM chunk_vector GROUP BY owner_id);;
SELECT owner_id, round(text_score + vec_score + CAST(0.1 AS DOUBLE) * coalesce(n, 0) / (coalesce(n, 0) + 5.0), 9) AS score FROM f LEFT JOIN n ON id = owner_id""")
def hybrid_rrf_boosted(g):
    """Boosted by a stand-in for degree: documents have no relations in the derived graph."""
    n = g.chunk_vector.groupBy(F.col("owner_id").alias("id")).agg(F.count_distinct("label").alias("n"))
    return V.boosted(V.reciprocal_rank_fusion(*_lists(g)), n).select("owner_id", F.round("score", 9).alias("score"))


def _mmr_sql(k: int) -> str:
    """Greedy choice by unrolled steps: each takes the best of the pool that is left."""
    out = _D.format(_COS.format("embedding", "q")) + f""", p AS (SELECT vec_id, distance, embedding FROM d ORDER BY distance, vec_id LIMIT 40),
pairs AS (SELECT a.vec_id, b.vec_id AS other, 1.0 - ({_COS.format('a.embedding', 'b.embedding')}) AS near FROM p a, p b),
c0 AS (SELECT CAST(NULL AS BIGINT) AS vec_id, CAST(NULL AS BIGINT) AS place, CAST(NULL AS DOUBLE) AS score WHERE false)"""
    for n in range(1, k + 1):
        out += f""", s{n} AS (SELECT p.vec_id, round(-0.5 * distance - 0.5 * greatest(0, coalesce((SELECT max(near) FROM pairs WHERE pairs.vec_id = p.vec_id AND other IN (SELECT vec_id FROM c{n - 1})), 0)), 6) + 0.0 AS score
FROM p WHERE p.vec_id NOT IN (SELECT vec_id FROM c{n - 1})),
c{n} AS (SELECT * FROM c{n - 1} UNION ALL (SELECT vec_id, {n - 1} AS place, score FROM s{n} ORDER BY score DESC, vec_id LIMIT 1))"""
    return out + f";;SELECT CAST(0 AS BIGINT) AS query_id, CAST(place AS INTEGER) AS place, vec_id, score FROM c{k}"


@query("vec_mmr", _mmr_sql(10))
def vec_mmr(g):
    pool = V.top_k(V.scored(g.chunk_vector, _query(g)), 40, "vec_id").withColumn("query_id", F.lit(0).cast("long"))
    return V.mmr(pool, 10)


_TYPED = "the hand of the thing"


_NEAR = embedded_sql(f"(SELECT doc_id, text FROM documents UNION ALL SELECT -1, '{_TYPED}')", "doc_id", "text") + """,
q AS (SELECT place, x AS y FROM embedded WHERE doc_id = -1),
d AS (SELECT doc_id, round(1 - sum(x * y), 6) + 0.0 AS distance FROM embedded JOIN q USING (place) WHERE doc_id >= 0 GROUP BY doc_id),
n AS (SELECT doc_id AS owner_id, doc_id AS vec_id, coalesce(distance, 1.0) AS distance FROM documents LEFT JOIN d USING (doc_id))"""


def _embedded(g):
    return g.table("documents").select(F.col("doc_id").alias("owner_id"), F.col("doc_id").alias("vec_id"), V.hashed_embedding(F.col("text")).alias("embedding"))


@query("semantic_search", _NEAR + ";;SELECT * FROM n ORDER BY distance, owner_id LIMIT 20")
def semantic_search(g):
    """Documents nearest to a typed text under the hashed embedding."""
    return V.semantic_search(_embedded(g), _TYPED, 20)


@query("semantic_search_fused", _NEAR + ", " + _FOUND + ", " + _TEXT.format(100) + """,
w AS (SELECT owner_id - 6000000000 AS owner_id, rank FROM tl WHERE owner_id >= 6000000000),
v AS (SELECT owner_id, row_number() OVER (ORDER BY distance, owner_id) - 1 AS rank FROM (SELECT * FROM n ORDER BY distance, owner_id LIMIT 100)),
f AS (SELECT owner_id, coalesce(CAST(0.7 AS DOUBLE) / (60 + w.rank), 0.0) AS text_score, coalesce(CAST(0.3 AS DOUBLE) / (60 + v.rank), 0.0) AS vec_score FROM w FULL JOIN v USING (owner_id));;
SELECT owner_id, round(text_score, 9) AS text_score, round(vec_score, 9) AS vec_score, round(text_score + vec_score, 9) AS score FROM f ORDER BY round(text_score + vec_score, 9) DESC, owner_id LIMIT 25""")
def semantic_search_fused(g):
    """The typed text's nearest documents and those that hold its words, by weights of 0.3 and 0.7."""
    text = _text_list(g, "the that OR name + red", 100).filter("owner_id >= 6000000000").select((F.col("owner_id") - 6_000_000_000).alias("owner_id"), "rank")
    rows = V.semantic_search(_embedded(g), _TYPED, 25, text, 0.7, 0.3, pool=100)
    return rows.select("owner_id", *[F.round(c, 9).alias(c) for c in ("text_score", "vec_score", "score")])


@query("degree_boost", """
n AS (SELECT from_id AS id, count(DISTINCT to_id) AS n FROM relation GROUP BY from_id),
a AS (SELECT id AS owner_id, row_number() OVER (ORDER BY id) - 1 AS tr FROM entity WHERE entity_type = 'customer' ORDER BY id LIMIT 50),
b AS (SELECT CAST(3000000000 + c_custkey AS BIGINT) AS owner_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS vr FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50),
f AS (SELECT owner_id, coalesce(CAST(0.5 AS DOUBLE) / (60 + tr), 0.0) + coalesce(CAST(0.5 AS DOUBLE) / (60 + vr), 0.0) AS score FROM a FULL JOIN b USING (owner_id));;
SELECT owner_id, round(score + CAST(0.1 AS DOUBLE) * coalesce(n, 0) / (coalesce(n, 0) + 5.0), 9) AS score FROM f LEFT JOIN n ON id = owner_id""")
def degree_boost(g):
    """Two ranked lists of customers, boosted by their distinct outgoing neighbours."""
    text = V.ranked(g.entity.filter("entity_type = 'customer'").select(F.col("id").alias("owner_id")), 50, "owner_id")
    rows = g.table("customer").select((F.lit(3_000_000_000).cast("long") + F.col("c_custkey")).alias("owner_id"), (-F.col("c_acctbal")).alias("distance"))
    fused = V.reciprocal_rank_fusion(text, V.ranked(rows, 50, "distance", "owner_id"))
    return V.boosted(fused, V.out_neighbors(g.relation)).select("owner_id", F.round("score", 9).alias("score"))


_OWNED = """
mirror AS (SELECT s_suppkey AS relation_id, CAST(4000000000 + s_suppkey AS BIGINT) AS from_id, CAST(2000000000 + s_nationkey AS BIGINT) AS to_id, 'in_nation' AS relation_type, s_suppkey % 10 = 3 AS deleted FROM supplier),
own AS (SELECT vec_id, embedding, chunk_index, CASE vec_id % 5 WHEN 0 THEN 'relation' WHEN 1 THEN 'attachment' ELSE 'entity' END AS owner_kind,
  CAST(CASE vec_id % 5 WHEN 0 THEN vec_id // 5 % 12 WHEN 1 THEN vec_id // 3 ELSE 6000000000 + vec_id // 3 END AS BIGINT) AS owner_id FROM chunk_vector),
typed AS (SELECT 'entity' AS owner_kind, id AS owner_id, entity_type AS type FROM entity UNION ALL SELECT 'relation', relation_id, relation_type FROM mirror WHERE NOT deleted
  UNION ALL SELECT 'attachment', attachment_id, 'document' FROM attachment WHERE status = 'ready' AND entity_id IN (SELECT id FROM entity)),
q AS (SELECT embedding AS q FROM chunk_vector WHERE vec_id = 0), d AS (SELECT own.*, round(""" + _COS.format("embedding", "q") + """, 6) + 0.0 AS distance FROM own, q)"""


def _owned(g):
    """(chunks, mirror): chunks of entities, relations and attachments, and the relations' mirror."""
    s, n = g.table("supplier"), F.col("vec_id")
    mirror = s.select(F.col("s_suppkey").alias("relation_id"), (F.lit(4_000_000_000).cast("long") + F.col("s_suppkey")).alias("from_id"), (F.lit(2_000_000_000).cast("long") + F.col("s_nationkey")).alias("to_id"), F.lit("in_nation").alias("relation_type"), (F.col("s_suppkey") % 10 == 3).alias("deleted"))
    kind = F.when(n % 5 == 0, "relation").when(n % 5 == 1, "attachment").otherwise("entity")
    owner = F.when(n % 5 == 0, F.floor(n / 5) % 12).when(n % 5 == 1, F.floor(n / 3)).otherwise(F.lit(6_000_000_000).cast("long") + F.floor(n / 3)).cast("long")
    return g.chunk_vector.select("vec_id", kind.alias("owner_kind"), owner.alias("owner_id"), "chunk_index", "embedding"), mirror


def _found(g, k: int, **filters):
    chunks, mirror = _owned(g)
    rows = V.filtered(chunks, g.entity, mirror, g.attachment, **filters)
    return V.top_k(V.scored(rows, _query(g)), k, "vec_id").select("vec_id", "owner_kind", "owner_id", "distance")


for _name, _where, _filters in (
    ("consent", "owner_kind <> 'attachment'", {}),
    ("owner_kind", "owner_kind = 'attachment'", {"owner_kind": "attachment", "allow_attachments": True}),
    ("owner_type", "(owner_kind, owner_id) IN (SELECT (owner_kind, owner_id) FROM typed WHERE type = 'in_nation')", {"type_name": "in_nation", "allow_attachments": True}),
    ("triple", "owner_kind = 'entity' OR (owner_kind = 'relation' AND owner_id IN (SELECT relation_id FROM mirror WHERE NOT deleted AND from_id = 4000000005))", {"source": 4_000_000_005, "relation_type": "in_nation"}),
):
    query(f"vec_filter_{_name}", _OWNED + f";;SELECT vec_id, owner_kind, owner_id, distance FROM d WHERE {_where} ORDER BY distance, vec_id LIMIT 60")(lambda g, f=_filters: _found(g, 60, **f))


@query("vec_owners", _OWNED + """,
h AS (SELECT vec_id, owner_kind, owner_id FROM d ORDER BY distance, vec_id LIMIT 90);;
SELECT vec_id, owner_kind, name, entity_type AS type, NULL AS from_name, NULL AS to_name FROM h JOIN entity ON id = owner_id WHERE owner_kind = 'entity'
UNION ALL SELECT vec_id, owner_kind, NULL, relation_type, a.name, b.name FROM h JOIN mirror ON relation_id = owner_id JOIN entity a ON a.id = from_id JOIN entity b ON b.id = to_id WHERE owner_kind = 'relation' AND NOT deleted
UNION ALL SELECT vec_id, owner_kind, filename, entity_type, NULL, NULL FROM h JOIN attachment ON attachment_id = owner_id JOIN entity ON id = entity_id WHERE owner_kind = 'attachment' AND status = 'ready'""")
def vec_owners(g):
    """Hits of every kind with the names of their owners."""
    rows = V.resolved(_found(g, 90, allow_attachments=True), g.entity, _owned(g)[1], g.attachment)
    return rows.select("vec_id", "owner_kind", "name", "type", "from_name", "to_name")


@query("vec_attachment_texts", _OWNED + """,
h AS (SELECT vec_id, owner_id, distance FROM d WHERE owner_kind = 'attachment' ORDER BY distance, vec_id LIMIT 80);;
SELECT vec_id, substring(text, 1, 1600) AS text FROM h JOIN attachment ON attachment_id = owner_id JOIN documents ON doc_id = owner_id WHERE status = 'ready' AND vec_id % 2 = 0 AND text <> ''""")
def vec_attachment_texts(g):
    """First segments; every second hit is of an old revision."""
    hits = _found(g, 80, owner_kind="attachment", allow_attachments=True).withColumns({"chunk_index": F.lit(0).cast("long"), "revision": (2 - F.col("vec_id") % 2).cast("long")})
    cut = segments(g.table("documents").select(F.col("doc_id").alias("id"), "text")).withColumnRenamed("id", "attachment_id")
    return V.attachment_texts(hits, g.attachment, cut).select("vec_id", "text")


@query("vec_near_chunks", _D.format(_COS.format("embedding", "q")) + """,
t AS (SELECT * FROM d ORDER BY distance, vec_id LIMIT 60), b AS (SELECT owner_id, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY distance, vec_id) AS place FROM t) WHERE place = 1);;
SELECT * FROM b ORDER BY distance, owner_id LIMIT 20""")
def vec_near_chunks(g):
    return V.near_chunks(g.chunk_vector, _query(g), 20)


@query("vec_chunk_texts", _D.format(_COS.format("embedding", "q")) + """,
t AS (SELECT owner_id, kind, 0 AS chunk_index, distance FROM d WHERE chunk_index < 2 ORDER BY distance, vec_id LIMIT 40);;
SELECT owner_id, kind, CAST(chunk_index AS BIGINT) AS chunk_index, distance, name || chr(10) || entity_type AS text FROM t JOIN entity ON id = owner_id WHERE kind = 'identity'
UNION ALL SELECT owner_id, kind, CAST(chunk_index AS BIGINT), distance, body FROM t JOIN observation ON entity_id = owner_id AND idx = chunk_index WHERE kind = 'observation'""")
def vec_chunk_texts(g):
    """A document's only observation stands for its second chunk."""
    rows = V.top_k(V.scored(g.chunk_vector.filter("chunk_index < 2"), _query(g)), 40, "vec_id").withColumn("chunk_index", F.lit(0).cast("long"))
    return V.chunk_texts(rows.select("owner_id", "kind", "chunk_index", "distance"), g.entity, g.observation)


@query("vec_near_subjects", _D.format(_COS.format("embedding", "q")) + ";;SELECT kind, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY distance, vec_id) AS place FROM d) WHERE place <= 7")
def vec_near_subjects(g):
    return V.near_subjects(g.chunk_vector, _query(g), 7)
