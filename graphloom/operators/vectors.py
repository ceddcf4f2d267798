"""Exact vector search, best chunk of each owner, rank fusion and diversity.

Distances are folds in the JVM over doubles. A query vector is a row of a broadcast
frame, never a literal of thousands of numbers. Top lists are ordered limits, which
Spark takes in each task first; best chunks are partial min_by aggregations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import tokens


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - cos (1 if a norm is 0); ip: minus the inner product; l2: squared distance."""
    if metric == "ip":
        return -dot(a, b)
    if metric == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(1.0)).otherwise(1.0 - dot(a, b) / norms)


def scored(chunks: DataFrame, query: DataFrame, metric: str = "cosine", digits: int = 6) -> DataFrame:
    """``chunks`` with ``distance`` to the vector of the one-row frame ``query`` (q); other dimensions are an error."""
    rows = chunks.crossJoin(query.select("q").limit(1))  # one row
    same = F.when(F.size("embedding") == F.size("q"), distance(F.col("embedding"), F.col("q"), metric)).otherwise(F.raise_error(F.lit("dimensions differ")).cast("double"))
    return rows.withColumn("distance", F.round(same, digits)).drop("q")


def top_k(rows: DataFrame, k: int, *ties: str) -> DataFrame:
    return rows.orderBy("distance", *ties).limit(min(max(k, 1), 1000))


def best_per_owner(rows: DataFrame) -> DataFrame:
    """(owner_id, vec_id, distance): the nearest chunk of each owner, smallest vec_id on a tie."""
    best = rows.groupBy("owner_id").agg(F.min(F.struct("distance", "vec_id")).alias("b"))
    return best.select("owner_id", "b.vec_id", "b.distance")


def near_entities(chunks: DataFrame, query: DataFrame, k: int, pool: int = 1000, metric: str = "cosine") -> DataFrame:
    """Best chunk of each owner, nearest owners first: ``pool`` owners, then the first ``k``."""
    return best_per_owner(scored(chunks, query, metric)).orderBy("distance", "owner_id").limit(pool).orderBy("distance", "owner_id").limit(k)


def reciprocal_rank_fusion(text: DataFrame, vector: DataFrame, text_weight: float = 0.5, vector_weight: float = 0.5, base: int = 60) -> DataFrame:
    """(owner_id, text_score, vec_score, score) of two lists (owner_id, rank), rank from 0."""
    rows = text.select("owner_id", F.col("rank").alias("tr")).join(vector.select("owner_id", F.col("rank").alias("vr")), "owner_id", "full")
    t = F.coalesce(F.lit(text_weight) / (base + F.col("tr")), F.lit(0.0))
    v = F.coalesce(F.lit(vector_weight) / (base + F.col("vr")), F.lit(0.0))
    return rows.select("owner_id", t.alias("text_score"), v.alias("vec_score"), (t + v).alias("score"))


def semantic_search(chunks: DataFrame, typed: str, k: int, text: DataFrame | None = None, text_weight: float = 0.5, vector_weight: float = 0.5, pool: int = 1000) -> DataFrame:
    """(owner_id, vec_id, distance): owners of ``chunks`` nearest to a typed text under the hashed embedding.

    With ``text`` (owner_id, rank), a list of owners that match in words, best first and ranks from 0, it
    is (owner_id, text_score, vec_score, score): both lists, of ``pool`` owners each, fused by reciprocal rank
    under the weights. A blank text is an error, and so are weights below 0 or without a sum.
    """
    if not (typed or "").strip():
        raise ValueError("a text to search for is needed")
    if min(text_weight, vector_weight) < 0 or text_weight + vector_weight <= 0:
        raise ValueError("weights must not be negative, nor both nothing")
    query = chunks.sparkSession.range(1).select(hashed_embedding(F.lit(typed)).alias("q"))
    near = near_entities(chunks, query, k if text is None else pool, pool)
    if text is None:
        return near
    fused = reciprocal_rank_fusion(text.filter(F.col("rank") < pool), ranked(near, pool, "distance", "owner_id"), text_weight, vector_weight)
    return fused.orderBy(F.desc(F.round("score", 9)), "owner_id").limit(k)


def boosted(fused: DataFrame, degree: DataFrame) -> DataFrame:
    """Scores raised by 0.1 * d / (d + 5), d the distinct outgoing neighbours (id, n)."""
    rows = fused.join(degree.select(F.col("id").alias("owner_id"), "n"), "owner_id", "left")
    d = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    return rows.select("owner_id", (F.col("score") + 0.1 * d / (d + 5)).alias("score"))


def ranked(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows with their rank from 0; ``k`` bounds what one task sorts."""
    cut = rows.orderBy(*order).limit(k)
    return cut.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))


def mmr(candidates: DataFrame, k: int, weight: float = 0.5, group: str = "query_id") -> DataFrame:
    """(query_id, place, vec_id, score): greedy marginal relevance within each query's candidates.

    Score: weight * (-distance) - (1 - weight) * max(0, largest cosine to what is
    chosen). ``candidates`` (query_id, vec_id, distance, embedding) holds a bounded pool
    of each query; ties go to the smaller vec_id.
    """

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("vec_id").reset_index(drop=True)
        v = np.array(p["embedding"].tolist(), float)
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        near, left, out = np.zeros(len(p)), np.ones(len(p), bool), []
        for place in range(min(k, len(p))):
            score = np.where(left, np.round(-weight * p["distance"].to_numpy() - (1 - weight) * near, 6), -np.inf)
            at = int(score.argmax())
            out.append((p[group][at], place, p["vec_id"][at], score[at]))
            left[at] = False
            near = np.maximum(near, v @ v[at])
        return pd.DataFrame(out, columns=[group, "place", "vec_id", "score"])

    return candidates.select(group, "vec_id", "distance", "embedding").groupBy(group).applyInPandas(choose, f"{group} long, place int, vec_id long, score double")


#: Queries and chunks that meet in one matrix product, and deals of chunk packs over tasks.
QUERY_BLOCK, PACK, DEALS = 512, 512, 64


def _unit(rows: list) -> np.ndarray:
    v = np.stack([np.asarray(x, float) for x in rows])
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def knn(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance): the ``k`` nearest chunks of each stated query (query_id, q), by cosine.

    Queries in blocks against all chunks in packs: a block and a pack meet in one matrix
    product, of which only each query's k best leave the task. Neither side passes
    through the driver; with one block of queries, each chunk is moved once. Chunks and
    queries without a vector, or with a null in it, take no part.
    """
    chunks, queries = (df.filter(F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())) for df, c in ((chunks, "embedding"), (queries, "q")))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.struct("query_id", "q").alias("x"))
    asked = asked.groupBy("block").agg(F.collect_list("x").alias("asked")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            cuts = [p.iloc[i : i + PACK] for i in range(0, len(p), PACK)]
            yield pd.DataFrame({"ids": [c["vec_id"].tolist() for c in cuts], "vectors": [[list(map(float, x)) for x in c["embedding"]] for c in cuts]})

    packs = chunks.select("vec_id", "embedding").mapInPandas(pack, "ids array<long>, vectors array<array<double>>")
    packs = packs.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(DEALS)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for ids, vectors, block in zip(p["ids"], p["vectors"], p["asked"], strict=True):
                ids = np.asarray(ids)
                far = np.round(1 - _unit([x["q"] for x in block]) @ _unit(list(vectors)).T, 6) + 0.0  # no negative zero
                best = np.array([np.lexsort((ids, row))[:k] for row in far])
                yield pd.DataFrame({"query_id": np.repeat([x["query_id"] for x in block], best.shape[1]), "vec_id": ids[best].ravel(), "distance": np.take_along_axis(far, best, 1).ravel()})

    near = packs.join(asked, ["block", "deal"]).select("ids", "vectors", "asked").mapInPandas(rows, "query_id long, vec_id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).drop("at")


def invalid_vectors(chunks: DataFrame, dimensions: int, tolerance: float = 1e-4) -> DataFrame:
    """(vec_id, fault): vectors of another length, with a value that isn't finite, or not of norm 1."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    fault = F.when(F.size("embedding") != dimensions, "length").when(~finite, "finite").when(F.abs(dot(F.col("embedding"), F.col("embedding")) - 1) > tolerance, "norm")
    return chunks.select("vec_id", fault.alias("fault")).filter("fault IS NOT NULL")


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """A deterministic embedding of a text, of norm 1 (0 without words).

    A word adds 1 or -1 at one place: by the first 32 bits of its MD5 modulo ``dimensions``,
    and the next four bits modulo 2.
    """

    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, tuple[int, float]] = {}
        for part in parts:
            out = []
            for words in part:
                v = np.zeros(dimensions)
                for w in words if words is not None else ():
                    got = places.get(w)
                    if got is None:
                        code = hashlib.md5(w.encode()).hexdigest()
                        got = (int(code[:8], 16) % dimensions, 1.0 - 2.0 * (int(code[8], 16) % 2))
                        if len(places) < 1_000_000:
                            places[w] = got
                    v[got[0]] += got[1]
                out.append((v / (np.linalg.norm(v) or 1)).tolist())
            yield pd.Series(out)

    return F.pandas_udf(embed, "array<double>")(tokens(text))


def chunk_texts(hits: DataFrame, entity: DataFrame, observation: DataFrame) -> DataFrame:
    """``hits`` (owner_id, kind, chunk_index, distance) with the text of each chunk; hits whose chunk is gone are left out.

    An identity chunk is name and type, an observation chunk the body at chunk_index.
    """
    names = entity.select(F.col("id").alias("owner_id"), F.concat_ws("\n", "name", "entity_type").alias("text"))
    bodies = observation.select(F.col("entity_id").alias("owner_id"), F.col("idx").cast("long").alias("chunk_index"), F.col("body").alias("text"))
    columns = ["owner_id", "kind", "chunk_index", "distance", "text"]
    a = hits.filter("kind = 'identity'").join(names, "owner_id").select(*columns)
    return a.union(hits.filter("kind = 'observation'").join(bodies, ["owner_id", "chunk_index"]).select(*columns))


def near_chunks(chunks: DataFrame, query: DataFrame, k: int, fetch: int = 3, metric: str = "cosine") -> DataFrame:
    """Best chunk of each owner among the ``fetch`` x k nearest chunks, the first ``k``: the cap comes before owners are told apart."""
    return best_per_owner(top_k(scored(chunks, query, metric), fetch * k, "vec_id")).orderBy("distance", "owner_id").limit(k)


def near_subjects(subjects: DataFrame, query: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(kind, vec_id, distance): the ``k`` nearest subjects of each kind."""
    rows = scored(subjects, query, metric)
    at = F.row_number().over(Window.partitionBy("kind").orderBy("distance", "vec_id"))
    return rows.withColumn("at", at).filter(F.col("at") <= k).select("kind", "vec_id", "distance")


def owner_types(entity: DataFrame, mirror: DataFrame, attachment: DataFrame) -> DataFrame:
    """(owner_kind, owner_id, type): live owners of chunks and their types.

    Entities by their type, relations of ``mirror`` (relation_id, triple, deleted) by
    theirs, ready attachments (attachment_id, entity_id, status) by that of their entity.
    """
    a = entity.select(F.lit("entity").alias("owner_kind"), F.col("id").alias("owner_id"), F.col("entity_type").alias("type"))
    b = mirror.filter("NOT deleted").select(F.lit("relation"), F.col("relation_id"), F.col("relation_type"))
    c = attachment.filter("status = 'ready'").join(entity.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id").select(F.lit("attachment"), "attachment_id", "entity_type")
    return a.union(b).union(c)


def filtered(chunks: DataFrame, entity: DataFrame, mirror: DataFrame, attachment: DataFrame, owner_kind: str | None = None, type_name: str | None = None, source: int | None = None, target: int | None = None, relation_type: str | None = None, allow_attachments: bool = False) -> DataFrame:
    """``chunks`` (owner_kind, owner_id, ...) that a search may rank; every filter comes before the candidates are capped.

    Attachments need consent. With any of ``source``, ``target`` and ``relation_type`` a
    chunk of a relation stays only if the relation lives and has them; others are not concerned.
    """
    if not allow_attachments:
        chunks = chunks.filter("owner_kind <> 'attachment'")
    if owner_kind:
        chunks = chunks.filter(F.col("owner_kind") == owner_kind)
    if type_name:
        typed = owner_types(entity, mirror, attachment).filter(F.col("type") == type_name).select("owner_kind", "owner_id")
        chunks = chunks.join(typed, ["owner_kind", "owner_id"], "left_semi")
    wanted = {c: v for c, v in (("from_id", source), ("to_id", target), ("relation_type", relation_type)) if v is not None}
    if wanted:
        live = mirror.filter("NOT deleted")
        for column, value in wanted.items():
            live = live.filter(F.col(column) == value)
        relations = chunks.filter("owner_kind = 'relation'").join(live.select(F.col("relation_id").alias("owner_id")), "owner_id", "left_semi").select(chunks.columns)
        chunks = chunks.filter("owner_kind <> 'relation'").union(relations)
    return chunks


def resolved(hits: DataFrame, entity: DataFrame, mirror: DataFrame, attachment: DataFrame) -> DataFrame:
    """``hits`` (owner_kind, owner_id, ...) with name, type, from_name and to_name; hits whose owner is gone are left out.

    An entity has its name and type, an attachment its file name and its entity's type, a
    relation its type and the names of its ends.
    """
    none = F.lit(None).cast("string")
    columns = [*hits.columns, "name", "type", "from_name", "to_name"]
    end = lambda c: entity.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    a = hits.filter("owner_kind = 'entity'").join(entity.select(F.col("id").alias("owner_id"), "name", F.col("entity_type").alias("type")), "owner_id").withColumns({"from_name": none, "to_name": none})
    lived = mirror.filter("NOT deleted").join(end("from"), "from_id").join(end("to"), "to_id").select(F.col("relation_id").alias("owner_id"), none.alias("name"), F.col("relation_type").alias("type"), "from_name", "to_name")
    b = hits.filter("owner_kind = 'relation'").join(lived, "owner_id")
    ready = attachment.filter("status = 'ready'").join(entity.select(F.col("id").alias("entity_id"), F.col("entity_type").alias("type")), "entity_id")
    c = hits.filter("owner_kind = 'attachment'").join(ready.select(F.col("attachment_id").alias("owner_id"), F.col("filename").alias("name"), "type"), "owner_id").withColumns({"from_name": none, "to_name": none})
    return a.select(columns).union(b.select(columns)).union(c.select(columns))


def attachment_texts(hits: DataFrame, attachment: DataFrame, segment: DataFrame) -> DataFrame:
    """``hits`` (owner_id, chunk_index, revision, ...) of attachments with the text of their segment (attachment_id, chunk_index, segment).

    The fence: the attachment is ready and still at the revision of the hit; others are left out.
    """
    live = attachment.filter("status = 'ready'").select(F.col("attachment_id").alias("owner_id"), "revision")
    texts = segment.select(F.col("attachment_id").alias("owner_id"), "chunk_index", F.col("segment").alias("text"))
    return hits.join(live, ["owner_id", "revision"], "left_semi").join(texts, ["owner_id", "chunk_index"]).select(*hits.columns, "text")


def out_neighbors(relation: DataFrame) -> DataFrame:
    """(id, n): distinct outgoing neighbours of each node that has any."""
    return relation.select(F.col("from_id").alias("id"), "to_id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
