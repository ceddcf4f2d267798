"""Full-text search: postings, boolean and phrase matches, BM25, merged node search.

An index is a DataFrame (token, owner, idx, tf, n, positions) stored in order of tokens. A query has
few terms, which are a predicate of the scan, so only their postings are read. ``match``
and ``bm25`` do the same on texts that have no index.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import folded, query_terms, tokens
from graphloom.operators.reads import TRIPLE

K1, B = 1.2, 0.75


def occurrences(texts: DataFrame, owner: str = "id", body: str = "body") -> DataFrame:
    """(owner, token): one row for each word of each text."""
    return texts.select(F.col(owner).alias("owner"), F.explode(tokens(F.col(body))).alias("token"))


def postings(texts: DataFrame, owner: str = "id", body: str = "body") -> DataFrame:
    """(owner, token, tf): the inverted index."""
    return occurrences(texts, owner, body).groupBy("owner", "token").agg(F.count(F.lit(1)).alias("tf"))


def match(texts: DataFrame, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = (), prefix: str | None = None, phrase: Sequence[str] = (), owner: str = "id", body: str = "body") -> DataFrame:
    """(owner): texts that hold all of ``all_of``, one of ``any_of``, none of ``none_of``, a word that
    begins with ``prefix`` and the words of ``phrase`` in a row. Terms are folded words; no term at all matches nothing."""
    t = tokens(F.col(body))
    test = F.lit(True)
    for w in all_of:
        test &= F.array_contains(t, w)
    if any_of:
        test &= F.arrays_overlap(t, F.array(*[F.lit(w) for w in any_of]))
    for w in none_of:
        test &= ~F.array_contains(t, w)
    if prefix:
        test &= F.exists(t, lambda x: x.startswith(prefix))
    if phrase:
        test &= F.contains(F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))
    if not (all_of or any_of or prefix or phrase):
        test = F.lit(False)
    # A cheap test on the folded text first: words are only cut where all of them occur in it.
    sure = F.lit(True)
    for w in [*all_of, *phrase, *([prefix] if prefix else [])]:
        sure &= F.contains(folded(F.col(body)), F.lit(w))
    return texts.filter(sure).filter(test).select(F.col(owner).alias("owner"))


def bm25(texts: DataFrame, terms: Sequence[str], owner: str = "id", body: str = "body") -> DataFrame:
    """(owner, score): texts with any of ``terms``, by Okapi BM25; a larger score is better."""
    sized = texts.select(F.col(owner).alias("owner"), tokens(F.col(body)).alias("t")).select("owner", F.size("t").alias("n"), F.filter("t", lambda x: x.isin(*terms)).alias("t"))
    stats = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    hits = sized.filter(F.size("t") > 0).select("owner", "n", F.explode("t").alias("token")).groupBy("owner", "n", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, "token").crossJoin(stats)  # one row a term, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return rows.groupBy("owner").agg(F.sum(part).alias("score"))


def earlier(positions: str, n: int) -> Column:
    """Positions, each ``n`` words before."""
    return F.transform(positions, lambda x: x - n)


def match_index(index: DataFrame, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = (), prefix: str | None = None, phrase: Sequence[str] = ()) -> DataFrame:
    """(owner, idx): as ``match``, from an index sorted by token, of which only the words asked for are read.

    A phrase is told by the positions of its words.
    """
    key = ["owner", "idx"]
    sets = []
    if all_of:
        need = list(dict.fromkeys(all_of))
        hits = index.filter(F.col("token").isin(need))
        sets.append(hits.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == len(need)).select(*key) if len(need) > 1 else hits.select(*key))
    if phrase:
        places = [F.flatten(F.collect_list(F.when(F.col("token") == w, earlier("positions", i)))) for i, w in enumerate(phrase)]
        hits = index.filter(F.col("token").isin(list(phrase))).groupBy(*key).agg(*[p.alias(f"p{i}") for i, p in enumerate(places)])
        sets.append(hits.filter(F.size(reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(phrase))])) > 0).select(*key))
    if any_of:
        sets.append(index.filter(F.col("token").isin(list(any_of))).select(*key).distinct())
    if prefix:
        sets.append(index.filter(F.col("token").startswith(prefix)).select(*key).distinct())
    found = sets[0] if sets else index.filter(F.lit(False)).select(*key)
    for more in sets[1:]:
        found = found.join(more, key, "left_semi")
    if none_of:
        found = found.join(index.filter(F.col("token").isin(list(none_of))).select(*key), key, "left_anti")
    return found


def index_totals(index: DataFrame, texts: int) -> tuple[int, float]:
    """(number of texts, mean number of words)."""
    return texts, (index.agg(F.sum("tf")).first()[0] or 0) / max(texts, 1)


def bm25_index(index: DataFrame, totals: tuple[int, float], terms: Sequence[str]) -> DataFrame:
    """(owner, idx, score): texts with any of ``terms``, as ``bm25``, reading the postings of the terms only."""
    docs, mean = totals
    hits = index.filter(F.col("token").isin(list(terms)))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
    return hits.join(df, "token").groupBy("owner", "idx").agg(F.sum(part).alias("score")).select("owner", "idx", "score")


def rank(index: DataFrame, found: DataFrame, totals: tuple[int, float], terms: Sequence[str], prefix: str | None = None) -> DataFrame:
    """(owner, idx, rank): ``found`` with the rank of a stored full-text table, best (lowest) first.

    Minus BM25 with idf = ln((N - df + 0.5) / (df + 0.5)), 1e-6 at least; to nine digits. All
    words that begin with ``prefix`` count as one term.
    """
    docs, mean = totals
    asked = [F.when(F.col("token").isin(list(terms)), F.concat(F.lit("="), F.col("token")))] + ([F.when(F.col("token").startswith(prefix), F.lit("*"))] if prefix else [])
    test = F.col("token").isin(list(terms))
    hits = index.filter(test | F.col("token").startswith(prefix) if prefix else test)
    hits = hits.select("owner", "idx", "n", "tf", F.explode(F.filter(F.array(*asked), lambda x: x.isNotNull())).alias("term")).groupBy("owner", "idx", "n", "term").agg(F.sum("tf").alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / mean))
    scored = hits.join(found, ["owner", "idx"], "left_semi").join(df, "term").groupBy("owner", "idx").agg((-F.round(F.sum(part), 9)).alias("rank"))
    return scored.select("owner", "idx", "rank")


def search_nodes(entity: DataFrame, name_index: DataFrame, body_index: DataFrame, terms: Sequence[str], entity_type: str | None = None, offset: int = 0, limit: int = 20, prefix: str | None = None) -> DataFrame:
    """(place, id, name, entity_type): entities whose name, best rank first, then whose observations, by id, hold all terms.

    Each source gives at most offset + limit candidates before the type filter, so a
    filtered page may hold fewer rows. An entity counts once, by its name. No term, no row.
    """
    names = match_index(name_index, terms, prefix=prefix)
    ranked = rank(name_index, names, index_totals(name_index, entity.count()), terms, prefix)
    return _merged(entity, ranked, match_index(body_index, terms, prefix=prefix), entity_type, offset, limit)


def _merged(entity: DataFrame, names: DataFrame, bodies: DataFrame, entity_type: str | None, offset: int, limit: int) -> DataFrame:
    """A page of entities found by their names (owner, idx, rank), then by observations (owner, idx)."""
    cap = offset + limit
    by_name = names.orderBy("rank", "owner").limit(cap).select("owner", F.lit(0).alias("source"), "rank")
    by_body = bodies.select("owner").distinct().orderBy("owner").limit(cap).select("owner", F.lit(1).alias("source"), F.lit(0.0).alias("rank"))
    found = by_name.union(by_body).groupBy("owner").agg(F.min(F.struct("source", "rank")).alias("m"))  # 2 x cap rows at most
    rows = entity.join(found, F.col("id") == F.col("owner"))
    if entity_type:
        rows = rows.filter(F.col("entity_type") == entity_type)
    # At most 2 x cap rows remain: their order needs one task.
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy("m", "id")) - 1)
    return rows.filter((F.col("place") >= offset) & (F.col("place") < offset + limit)).select("place", "id", "name", "entity_type")


def search_nodes_lite(entity: DataFrame, name_index: DataFrame, body_index: DataFrame, terms: Sequence[str], entity_type: str | None = None, offset: int = 0, limit: int = 20) -> tuple[DataFrame, bool]:
    """A page of ``search_nodes`` and whether more follow: one more is asked for."""
    rows = search_nodes(entity, name_index, body_index, terms, entity_type, offset, limit + 1)
    return rows.filter(F.col("place") < offset + limit), rows.filter(F.col("place") >= offset + limit).count() > 0


def search_relation_texts(relation_observation: DataFrame, index: DataFrame, terms: Sequence[str], limit: int = 20, prefix: str | None = None, relation: DataFrame | None = None) -> DataFrame:
    """(place, from_id, to_id, relation_type): relations with a body that holds all terms, best rank first.

    ``index`` is that of the bodies, with structs of the triple as owners; ``relation``
    keeps those of structurally filtered relations only. The limit is taken before triples
    are made distinct.
    """
    found = match_index(index, terms, prefix=prefix)
    ranked = rank(index, found, index_totals(index, relation_observation.count()), terms, prefix)
    return _relations(ranked, limit, relation)


def _relations(ranked: DataFrame, limit: int, relation: DataFrame | None) -> DataFrame:
    """A page of relations from the ranked hits of their bodies."""
    rows = ranked.select("owner.*", "idx", "rank")
    if relation is not None:
        rows = rows.join(relation, TRIPLE, "left_semi")
    best = rows.orderBy("rank", *TRIPLE, "idx").limit(limit).groupBy(*TRIPLE).agg(F.min("rank").alias("rank"))  # limit rows at most
    return best.withColumn("place", F.row_number().over(Window.orderBy("rank", *TRIPLE)) - 1).select("place", *TRIPLE)


def direct_search(scope: str, typed: str, entity: DataFrame, name_index: DataFrame, body_index: DataFrame, relation_observation: DataFrame, relation_index: DataFrame, limit: int, entity_type: str | None = None, relation: DataFrame | None = None) -> DataFrame:
    """(kind, place, id, name, from_id, to_id, type): a viewer's typed text over nodes, or relations if ``scope`` says so; its last word may be a beginning."""
    terms, prefix = query_terms(typed)
    if scope == "relations":
        rows = search_relation_texts(relation_observation, relation_index, terms, limit, prefix, relation)
        return rows.select(F.lit("relation").alias("kind"), "place", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("name"), "from_id", "to_id", F.col("relation_type").alias("type"))
    rows = search_nodes(entity, name_index, body_index, terms, entity_type, 0, limit, prefix)
    none = F.lit(None).cast("long")
    return rows.select(F.lit("entity").alias("kind"), "place", "id", "name", none.alias("from_id"), none.alias("to_id"), F.col("entity_type").alias("type"))
