"""Queries of full-text search and taxonomy suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.text import query_terms
from graphloom.operators import fulltext as T
from graphloom.operators import search as S
from graphloom.operators import taxonomy as X
from graphloom.operators.topk import bm25_topk
from graphloom.plans.code import embedded_sql
from graphloom.plans.registry import query

_FOLD = "strip_accents(lower({0}))"
TOKENS = "regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}]+')"
_OBS = f"obs AS (SELECT entity_id AS owner, idx, {TOKENS.format('body')} AS t FROM observation)"


def _match(name: str, test: str, **terms):
    query(name, f"{_OBS};;SELECT owner, idx FROM obs WHERE {test}")(
        lambda g: S.match_index(g.word, **terms))


_match("fts_obs_match", "list_contains(t, 'the') AND list_contains(t, 'that')", all_of=["the", "that"])
_match("fts_any", "list_has_any(t, ['building', 'der'])", any_of=["building", "der"])
_match("fts_not", "list_contains(t, 'the') AND NOT list_contains(t, 'of')", all_of=["the"], none_of=["of"])
_match("fts_phrase", "contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')", phrase=["of", "the"])
_match("fts_prefix", "list_contains(t, 'name') AND len(list_filter(t, lambda x: starts_with(x, 'wid'))) > 0", all_of=["name"], prefix="wid")


@query("fts_name_and", f"n AS (SELECT id, name, {TOKENS.format('name')} AS t FROM entity);;SELECT id, name FROM n WHERE list_contains(t, 'part') AND len(list_filter(t, lambda x: starts_with(x, '00000001'))) > 0")
def fts_name_and(g):
    terms, prefix = query_terms("Part#00000001")
    hits = S.match_index(g.name_word, terms, prefix=prefix)
    return g.entity.join(hits.select(F.col("owner").alias("id")), "id", "left_semi").select("id", "name")


_BM25 = f"""
d AS (SELECT entity_id AS owner, idx, {TOKENS.format('body')} AS t FROM observation),
s AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM d),
x AS (SELECT owner, idx, len(t) AS n, token, count(*) AS tf FROM (SELECT owner, idx, t, unnest(t) AS token FROM d) WHERE token IN ('the', 'que', 'hend') GROUP BY owner, idx, len(t), token),
f AS (SELECT token, count(*) AS df FROM x GROUP BY token),
r AS (SELECT owner, idx, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM x JOIN f USING (token), s GROUP BY owner, idx)"""


@query("fts_bm25_topk", _BM25 + ";;SELECT owner, idx, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, owner, idx LIMIT 50")
def fts_bm25_topk(g):
    rows = S.bm25_index(g.word, g.word_totals, ["the", "que", "hend"]).withColumn("score", F.round("score", 6))
    return rows.orderBy(F.desc("score"), "owner", "idx").limit(50)


_BLOCK_TERMS = ("the", "ons", "hewh", "widget")
_BLOCK_SQL = _BM25.replace("('the', 'que', 'hend')", str(_BLOCK_TERMS))


@query("fts_bm25_blocks", _BLOCK_SQL + ";;SELECT owner, idx, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, owner, idx LIMIT 20")
def fts_bm25_blocks(g):
    """The best twenty from the blocks whose bounds reach them."""
    blocks, texts = g.word_block
    return bm25_topk(blocks, g.block_totals, _BLOCK_TERMS, 20, texts=texts)[0]


@query("fts_postings", f"{_OBS};;SELECT owner, token, count(*) AS tf FROM (SELECT owner, unnest(t) AS token FROM obs) GROUP BY owner, token")
def fts_postings(g):
    return g.word.groupBy("owner", "token").agg(F.sum("tf").alias("tf"))


def _starts_sql(words: list[str], prefix: bool) -> str:
    """Places at which a phrase begins among the words ``w``."""
    tests = [f"starts_with(w[i + {n + 1}], '{x}')" if prefix and n == len(words) - 1 else f"w[i + {n + 1}] = '{x}'" for n, x in enumerate(words)]
    return f"list_filter(range(len(w) - {len(words) - 1}), lambda i: {' AND '.join(tests)})"


def ranked_sql(texts: str, tokens: str, phrases: list[tuple[list[str], bool]], holds: str, key: str, where: str = "true") -> str:
    """Common table expressions: texts of which ``holds`` is true of the starts s0, s1, ... of phrases, with the rank of a stored full-text table."""
    n = range(len(phrases))
    part = " + ".join(f"greatest(ln((docs - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * len(s{i}) * 2.2 / (len(s{i}) + 1.2 * (0.25 + 0.75 * len(w) / mean))" for i in n)
    return f"""t AS (SELECT {key}, {tokens} AS w FROM {texts}), c AS (SELECT *, {', '.join(f'{_starts_sql(*p)} AS s{i}' for i, p in enumerate(phrases))} FROM t),
z AS (SELECT count(*) AS docs, avg(len(w)) AS mean, {', '.join(f'count(*) FILTER (len(s{i}) > 0) AS d{i}' for i in n)} FROM c),
r AS (SELECT {key}, -round({part}, 9) AS rank FROM c, z WHERE ({holds}) AND {where})"""


def _node_sql(phrases: list[tuple[list[str], bool]], holds: str, kind: str | None, offset: int, limit: int, extra: int = 0) -> str:
    cap = offset + limit + extra
    return ranked_sql("entity", TOKENS.format("name"), phrases, holds, "id") + f""",
n AS (SELECT id AS owner, 0 AS source, rank FROM r ORDER BY rank, owner LIMIT {cap}),
b AS (SELECT DISTINCT owner, 1 AS source, 0.0 AS rank FROM (SELECT *, {', '.join(f'{_starts_sql(*p)} AS s{i}' for i, p in enumerate(phrases))} FROM (SELECT entity_id AS owner, {TOKENS.format('body')} AS w FROM observation)) WHERE {holds} ORDER BY owner LIMIT {cap}),
m AS (SELECT owner, arg_min(source, source) AS source, arg_min(rank, source) AS rank FROM (SELECT * FROM n UNION ALL SELECT * FROM b) GROUP BY owner),
k AS (SELECT row_number() OVER (ORDER BY source, rank, id) - 1 AS place, id, name, entity_type FROM m JOIN entity ON id = owner {f"WHERE entity_type = '{kind}'" if kind else ''});;
SELECT CAST(place AS INTEGER) AS place, id, name, entity_type FROM k WHERE place >= {offset} AND place < {offset + limit}"""


def _nodes(name: str, word: str, kind: str | None, offset: int, limit: int):
    query(name, _node_sql([([word], False)], "len(s0) > 0", kind, offset, limit))(lambda g: S.search_nodes(g.entity, g.name_word, g.word, [word], kind, offset, limit))


_nodes("search_nodes_merged", "machinery", None, 0, 50)
_nodes("search_nodes_names", "part", None, 5, 50)
_nodes("search_nodes_typed_page", "the", "document", 10, 20)


@query("search_nodes_lite", _node_sql([(["machinery"], False)], "len(s0) > 0", None, 0, 10, 1).replace("SELECT CAST(place", "SELECT (SELECT count(*) FROM k) > 10 AS has_more, CAST(place"))
def search_nodes_lite(g):
    rows, more = S.search_nodes_lite(g.entity, g.name_word, g.word, ["machinery"], None, 0, 10)
    return rows.select(F.lit(more).alias("has_more"), "place", "id", "name", "entity_type")


_PAGE = """,
h AS (SELECT * FROM r ORDER BY rank, from_id, to_id, relation_type, idx LIMIT 40), d AS (SELECT from_id, to_id, relation_type, min(rank) AS rank FROM h GROUP BY ALL),
k AS (SELECT CAST(row_number() OVER (ORDER BY rank, from_id, to_id, relation_type) - 1 AS INTEGER) AS place, from_id, to_id, relation_type FROM d);;"""
_AS_RELATION = "SELECT 'relation' AS kind, place, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS name, from_id, to_id, relation_type AS type FROM k"


def _bodies(phrases: list[tuple[list[str], bool]], holds: str, where: str = "true") -> str:
    return ranked_sql("relation_observation", TOKENS.format("body"), phrases, holds, "from_id, to_id, relation_type, idx", where) + _PAGE


@query("search_relations_text", _bodies([(["registered"], False)], "len(s0) > 0") + "SELECT * FROM k")
def search_relations_text(g):
    return S.search_relation_texts(g.relation_observation, g.relation_word, ["registered"], 40)


@query("search_direct_relations", _bodies([(["registered"], False), (["sup"], True)], "len(s0) > 0 AND len(s1) > 0", "to_id % 2 = 0") + _AS_RELATION)
def search_direct_relations(g):
    """A viewer's text over relations: the first word is whole, the last a beginning."""
    return S.direct_search("relations", "Registered, sup", g.entity, g.name_word, g.word, g.relation_observation, g.relation_word, 40, relation=g.relation.filter("to_id % 2 = 0"))


@query("search_direct_nodes", _node_sql([(["part"], False), (["00000001"], True)], "len(s0) > 0 AND len(s1) > 0", None, 0, 30).replace("SELECT CAST(place AS INTEGER) AS place, id, name, entity_type", "SELECT 'entity' AS kind, CAST(place AS INTEGER) AS place, id, name, CAST(NULL AS BIGINT) AS from_id, CAST(NULL AS BIGINT) AS to_id, entity_type AS type"))
def search_direct_nodes(g):
    return S.direct_search("nodes", "Part#00000001", g.entity, g.name_word, g.word, g.relation_observation, g.relation_word, 30)


def _near_sql(phrases: list[list[str]], apart: int) -> str:
    starts = [_starts_sql(p, False) for p in phrases]
    tests = " AND ".join(f"len(list_filter(s{i}, lambda s: s <= m AND s >= m - {len(p) + apart})) > 0" for i, p in enumerate(phrases))
    return f"SELECT owner, idx FROM (SELECT owner, idx, {', '.join(f'{s} AS s{i}' for i, s in enumerate(starts))} FROM (SELECT owner, idx, t AS w FROM obs)) WHERE len(list_filter(list_distinct(flatten([{', '.join(f's{i}' for i in range(len(phrases)))}])), lambda m: {tests})) > 0"


_ROW = "' ' || array_to_string(t, ' ') || ' '"
_ASKED = {
    "nested": ('("of the" OR Widget OR ge*) NOT (small OR de)', f"SELECT owner, idx FROM obs WHERE (contains({_ROW}, ' of the ') OR list_contains(t, 'widget') OR len(list_filter(t, lambda x: starts_with(x, 'ge'))) > 0) AND NOT (list_contains(t, 'small') OR list_contains(t, 'de'))"),
    "near": ('NEAR(the "of a", 4) OR NEAR(to "of the" in, 5)', _near_sql([["the"], ["of", "a"]], 4) + " UNION " + _near_sql([["to"], ["of", "the"], ["in"]], 5)),
    "first": ('^name red OR ^brand + "13"', "SELECT owner, idx FROM obs WHERE (t[1] = 'name' AND list_contains(t, 'red')) OR (t[1] = 'brand' AND t[2] = '13')"),
}
for _name, (_text, _sql) in _ASKED.items():
    query(f"fts_query_{_name}", f"{_OBS};;{_sql}")(lambda g, text=_text: T.find(g.word, text))


@query("fts_query_rank", ranked_sql("observation", TOKENS.format("body"), [(["the"], False), (["th"], True), (["of", "a"], False)], "len(s0) > 0 AND len(s1) > 0 AND len(s2) = 0", "entity_id, idx") + ";;SELECT entity_id AS owner, idx, rank FROM r ORDER BY rank, entity_id, idx LIMIT 60")
def fts_query_rank(g):
    """Beginnings of words and phrases count for the rank."""
    return T.find_ranked(g.word, 'the th* NOT "of a"', g.word_totals).orderBy("rank", "owner", "idx").limit(60)


@query("fts_query_nodes", _node_sql([(["part", "000000001"], False), (["customer"], False), (["0000000"], True), (["machinery"], False)], "len(s0) > 0 OR (len(s1) > 0 AND len(s2) > 0) OR len(s3) > 0", None, 0, 40))
def fts_query_nodes(g):
    return T.query_nodes(g.entity, g.name_word, g.word, '"Part#000000001" OR customer 0000000* OR machinery', None, 0, 40)


@query("fts_query_relations", _bodies([(["supplier", "supplier"], False), (["registered"], False), (["000000003"], False)], "(len(s0) > 0 OR len(s1) > 0) AND len(s2) = 0") + "SELECT * FROM k")
def fts_query_relations(g):
    return T.query_relations(g.relation_observation, g.relation_word, "(supplier + supplier OR registered) NOT 000000003", 40)


_WORDS = ("costumer", "sub_nation", "parts", "document", "reigon")


@query("taxonomy_suggest", """
w AS (SELECT * FROM (VALUES ('costumer'), ('sub_nation'), ('parts'), ('document'), ('reigon')) AS v(typed)),
c AS (SELECT entity_type AS name, count(*) AS n FROM entity GROUP BY entity_type),
p AS (SELECT typed, name, lower(typed) AS a, lower(name) AS b FROM w, c WHERE n > 0 AND lower(typed) <> lower(name)),
t AS (SELECT *, CASE WHEN length(a) >= 3 THEN list_transform(range(1, length(a) - 1), lambda i: substring(a, i, 3)) ELSE [] END AS ta,
             CASE WHEN length(b) >= 3 THEN list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3)) ELSE [] END AS tb FROM p),
s AS (SELECT typed, name, CASE WHEN len(ta) + len(tb) = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * len(list_filter(ta, lambda x: list_contains(tb, x))) / (len(ta) + len(tb)) END * CAST(0.7 AS DOUBLE)
             + (1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)) * CAST(0.3 AS DOUBLE) AS score FROM t);;
SELECT typed, name, round(score, 6) AS score FROM s WHERE score > 0.35""")
def taxonomy_suggest(g):
    """Known types that resemble typed ones."""
    known = g.entity.groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    return X.alike(g.spark.createDataFrame([(w,) for w in _WORDS], "typed string"), known)


@query("similar_part_names", """
x AS (SELECT DISTINCT p_name AS name FROM part),
p AS (SELECT a.name AS typed, b.name AS name, lower(a.name) AS a, lower(b.name) AS b FROM x a, x b WHERE lower(a.name) <> lower(b.name)),
t AS (SELECT *, CASE WHEN length(a) >= 3 THEN list_transform(range(1, length(a) - 1), lambda i: substring(a, i, 3)) ELSE [] END AS ta,
             CASE WHEN length(b) >= 3 THEN list_transform(range(1, length(b) - 1), lambda i: substring(b, i, 3)) ELSE [] END AS tb FROM p),
s AS (SELECT typed, name, CASE WHEN len(ta) + len(tb) = 0 THEN 0.0 ELSE CAST(2.0 AS DOUBLE) * len(list_filter(ta, lambda x: list_contains(tb, x))) / (len(ta) + len(tb)) END * CAST(0.7 AS DOUBLE)
             + (1.0 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE)) * CAST(0.3 AS DOUBLE) AS score FROM t);;
SELECT typed, name, round(score, 6) AS score FROM s WHERE round(score, 6) > 0.35""")
def similar_part_names(g):
    """Names of parts that are like each other, from their trigrams."""
    names = g.table("part").select("p_name")
    return X.alike(names.withColumnRenamed("p_name", "typed"), names.withColumnRenamed("p_name", "name"))


_TYPED = ("sub nation", "region of asia", "costumer", "parts", "document")


@query("taxonomy_suggest_meaning", """
w AS (SELECT * FROM (VALUES ('sub nation'), ('region of asia'), ('costumer'), ('parts'), ('document')) AS v(typed)),
c AS (SELECT DISTINCT entity_type AS name FROM entity), """ + embedded_sql("(SELECT typed AS x, typed AS t FROM w UNION SELECT name, name FROM c)", "x_", "t").replace("SELECT x_, unnest", "SELECT x AS x_, unnest") + """,
m AS (SELECT typed, name, 0 AS source, round(sum(a.x * b.x), 6) AS score FROM w JOIN embedded a ON a.x_ = typed, c JOIN embedded b ON b.x_ = name WHERE a.place = b.place AND typed <> name GROUP BY typed, name),
p AS (SELECT typed, name, CASE WHEN length(typed) >= 3 THEN list_transform(range(1, length(typed) - 1), lambda i: substring(typed, i, 3)) ELSE [] END AS ta,
             CASE WHEN length(name) >= 3 THEN list_transform(range(1, length(name) - 1), lambda i: substring(name, i, 3)) ELSE [] END AS tb FROM w, c WHERE typed <> name),
l AS (SELECT typed, name, 1 AS source, round(CAST(2.0 AS DOUBLE) * len(list_filter(ta, lambda x: list_contains(tb, x))) / (len(ta) + len(tb)) * CAST(0.7 AS DOUBLE)
             + (1.0 - levenshtein(typed, name) / CAST(greatest(length(typed), length(name)) AS DOUBLE)) * CAST(0.3 AS DOUBLE), 6) AS score FROM p),
u AS (SELECT * FROM m WHERE score > 0 UNION ALL SELECT * FROM l WHERE score > 0.35),
b AS (SELECT typed, name, min(source) AS source, arg_min(score, source) AS score FROM u GROUP BY typed, name),
r AS (SELECT *, row_number() OVER (PARTITION BY typed ORDER BY source, score DESC, name) AS place FROM b);;
SELECT typed, name, CASE source WHEN 0 THEN 'meaning' ELSE 'letters' END AS source, score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 3""")
def taxonomy_suggest_meaning(g):
    known = g.entity.groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return X.suggest(g.spark.createDataFrame([(w,) for w in _TYPED], "typed string"), known, 3)
