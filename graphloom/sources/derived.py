"""The property graph as DataFrames, and its derivation from the driver's tables.

Ids are kind x 10**9 + key, so they are unique across kinds. Every table is built
lazily: a query reads only the files and columns that it uses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import index
from graphloom.operators.ann import VectorIndex
from graphloom.operators.search import index_totals
from graphloom.operators.topk import packed, unpacked
from graphloom.sources.shared import durable

KIND = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "document": 6}
UNIT = 1_000_000_000


def _id(kind: str, key: str) -> Column:
    return (F.lit(KIND[kind] * UNIT).cast("long") + F.col(key).cast("long")).cast("long")


@dataclass(frozen=True)
class Graph:
    """Entities, relations, observations and attributes derived from the tables in ``sf_dir``."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def entity(self) -> DataFrame:
        """(id, name, entity_type)"""
        parts = [
            ("region", "region", "r_regionkey", F.col("r_name")), ("nation", "nation", "n_nationkey", F.col("n_name")),
            ("customer", "customer", "c_custkey", F.col("c_name")), ("supplier", "supplier", "s_suppkey", F.col("s_name")),
            ("part", "part", "p_partkey", F.concat(F.lit("Part#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))),
            ("document", "documents", "doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))),
        ]
        rows = [self.table(t).select(_id(kind, key).alias("id"), name.alias("name"), F.lit(kind).alias("entity_type")) for kind, t, key, name in parts]
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        return out

    def _edges(self, df: DataFrame, a: Column, b: Column, kind: str) -> DataFrame:
        return df.select(a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("relation_type"))

    @cached_property
    def relation(self) -> DataFrame:
        """(from_id, to_id, relation_type), each triple once"""
        items = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        out = self._edges(self.table("nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey"), "in_region")
        out = out.union(self._edges(self.table("customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey"), "in_nation"))
        out = out.union(self._edges(self.table("supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey"), "in_nation"))
        out = out.union(self._edges(items, _id("supplier", "l_suppkey"), _id("part", "l_partkey"), "supplies").distinct())
        bought = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
        return out.union(self._edges(bought, _id("customer", "o_custkey"), _id("part", "l_partkey"), "bought").distinct())

    @cached_property
    def observation(self) -> DataFrame:
        """(entity_id, idx, body), in order of idx"""
        part = self.table("part")
        rows = [
            (self.table("customer"), _id("customer", "c_custkey"), 0, F.concat(F.lit("mktsegment: "), F.col("c_mktsegment"))),
            (part, _id("part", "p_partkey"), 0, F.concat(F.lit("name: "), F.col("p_name"))),
            (part, _id("part", "p_partkey"), 1, F.concat(F.lit("brand: "), F.col("p_brand"))),
            (part, _id("part", "p_partkey"), 2, F.concat(F.lit("type: "), F.col("p_type"))),
            (self.table("documents"), _id("document", "doc_id"), 0, F.col("text")),
        ]
        out = None
        for df, owner, idx, body in rows:
            r = df.select(owner.alias("entity_id"), F.lit(idx).alias("idx"), body.alias("body"))
            out = r if out is None else out.union(r)
        return out

    @cached_property
    def attribute(self) -> DataFrame:
        """(owner_kind, owner_id, key, value)"""
        docs = self.table("documents")
        one = lambda key: docs.select(F.lit("entity").alias("owner_kind"), _id("document", "doc_id").alias("owner_id"), F.lit(key).alias("key"), F.col(key).alias("value"))
        return one("lang").union(one("source"))

    @cached_property
    def relation_observation(self) -> DataFrame:
        """(from_id, to_id, relation_type, idx, body): bodies on the relations of suppliers to nations"""
        s = self.table("supplier")
        return s.select(_id("supplier", "s_suppkey").alias("from_id"), _id("nation", "s_nationkey").alias("to_id"), F.lit("in_nation").alias("relation_type"), F.lit(0).alias("idx"), F.concat(F.lit("supplier "), F.col("s_name"), F.lit(" registered")).alias("body"))

    @cached_property
    def relation_attribute(self) -> DataFrame:
        """(from_id, to_id, relation_type, key, value): attributes of the relations of customers to nations"""
        c = self.table("customer")
        return c.select(_id("customer", "c_custkey").alias("from_id"), _id("nation", "c_nationkey").alias("to_id"), F.lit("in_nation").alias("relation_type"), F.lit("market").alias("key"), F.col("c_mktsegment").alias("value"))

    @cached_property
    def attachment(self) -> DataFrame:
        """(attachment_id, entity_id, filename, revision, status): each document as a file of one in four of them"""
        d, n = self.table("documents"), F.col("doc_id")
        return d.select(n.alias("attachment_id"), (F.lit(6 * UNIT).cast("long") + F.floor(n / 4)).cast("long").alias("entity_id"), F.concat(F.lit("file"), n.cast("string"), F.lit(".txt")).alias("filename"), F.lit(2).cast("long").alias("revision"), F.when(n % 5 == 0, "extracting").otherwise("ready").alias("status"))

    @cached_property
    def chain(self) -> DataFrame:
        """(from_id, to_id, relation_type): the first sixty parts in a row"""
        p = self.table("part").filter("p_partkey < 60")
        return self._edges(p, _id("part", "p_partkey"), _id("part", "p_partkey") + 1, "next")

    @cached_property
    def chunk_vector(self) -> DataFrame:
        """(vec_id, owner_kind, owner_id, kind, chunk_index, label, embedding): three chunks a document"""
        v = self.table("embeddings")
        return v.select("vec_id", F.lit("entity").alias("owner_kind"), (F.lit(6 * UNIT).cast("long") + F.floor(F.col("vec_id") / 3)).cast("long").alias("owner_id"), F.when(F.col("vec_id") % 3 == 0, "identity").otherwise("observation").alias("kind"), (F.col("vec_id") % 3).cast("long").alias("chunk_index"), "label", "embedding")

    @cached_property
    def relation_raw(self) -> DataFrame:
        """(row_key, from_id, to_id): supplier-part rows with repetitions; the row key orders equal pairs"""
        items = self.table("lineitem")
        key = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
        return items.select(key.alias("row_key"), "l_orderkey", "l_linenumber", "l_extendedprice", _id("supplier", "l_suppkey").alias("from_id"), _id("part", "l_partkey").alias("to_id"))

    @cached_property
    def change(self) -> DataFrame:
        """(event_id, entity_id, operation, quiet, ts): changes of customer entities"""
        e = self.table("events")
        operation = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("update")
        return e.select("event_id", _id("customer", "user_id").alias("entity_id"), operation.alias("operation"), F.col("event_type").isin("view", "click").cast("int").alias("quiet"), "ts")


class StoredGraph(Graph):
    """A graph whose tables are written into the shared folder when first used, sorted by the
    columns that queries filter on, so that a lookup reads the row groups it needs.

    It holds what the source tables held then; a new instance loads them anew.
    """

    def _stored(self, df: DataFrame, name: str, *order: str) -> DataFrame:
        return durable(df.repartitionByRange(*order).sortWithinPartitions(*order), name)

    @cached_property
    def entity(self) -> DataFrame:
        return self._stored(super().entity, "entity", "id")

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A further table, written when first asked for."""
        key = f"kept:{name}"
        if key not in self.__dict__:
            self.__dict__[key] = durable(make(), name)
        return self.__dict__[key]

    @cached_property
    def entity_by_name(self) -> DataFrame:
        return self._stored(self.entity, "entity-by-name", "name")

    @cached_property
    def relation(self) -> DataFrame:
        return self._stored(super().relation, "relation", "from_id", "to_id")

    @cached_property
    def relation_in(self) -> DataFrame:
        """The relations again, sorted by target."""
        return self._stored(self.relation, "relation-in", "to_id", "from_id")

    @cached_property
    def word(self) -> DataFrame:
        """(token, owner, idx, tf, n): the words of observations"""
        return self._stored(index(self.observation, "entity_id", "idx"), "word", "token", "owner")

    @cached_property
    def name_word(self) -> DataFrame:
        """(token, owner, idx, tf, n): the words of names"""
        return self._stored(index(self.entity.select("id", F.lit(0).alias("idx"), F.col("name").alias("body")), "id", "idx"), "name-word", "token", "owner")

    @cached_property
    def word_totals(self) -> tuple[int, float]:
        """(observations, their mean number of words)"""
        return index_totals(self.word, self.observation.count())

    @cached_property
    def word_block(self) -> tuple[DataFrame, DataFrame]:
        """The words of observations in blocks of few texts, and the texts of these, as ``topk.unpacked`` gives them."""
        return unpacked(durable(packed(self.observation, "entity_id", "idx", self.observation.count()), "word-block", "zstd"))

    @cached_property
    def block_totals(self) -> tuple[int, float]:
        """(observations, their mean number of words), without the words themselves"""
        texts = self.observation.count()
        return texts, (self.word_block[1].agg(F.sum("n")).first()[0] or 0) / max(texts, 1)

    @cached_property
    def vector_index(self) -> VectorIndex:
        """The chunk vectors as an inverted file of cells."""
        return VectorIndex(self.chunk_vector)

    @cached_property
    def relation_word(self) -> DataFrame:
        """(token, owner, idx, tf, n): the words of relation observations; owners are triples"""
        rows = self.relation_observation.select(F.struct("from_id", "to_id", "relation_type").alias("triple"), "idx", "body")
        return self._stored(index(rows, "triple", "idx"), "relation-word", "token", "owner")


#: The same tables in SQL, as common table expressions for the checks.
GRAPH_SQL = """
entity AS (
  SELECT CAST(1000000000 + r_regionkey AS BIGINT) AS id, r_name AS name, 'region' AS entity_type FROM region
  UNION ALL SELECT CAST(2000000000 + n_nationkey AS BIGINT), n_name, 'nation' FROM nation
  UNION ALL SELECT CAST(3000000000 + c_custkey AS BIGINT), c_name, 'customer' FROM customer
  UNION ALL SELECT CAST(4000000000 + s_suppkey AS BIGINT), s_name, 'supplier' FROM supplier
  UNION ALL SELECT CAST(5000000000 + p_partkey AS BIGINT), 'Part#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 'part' FROM part
  UNION ALL SELECT CAST(6000000000 + doc_id AS BIGINT), 'doc:' || CAST(doc_id AS VARCHAR), 'document' FROM documents),
relation AS (
  SELECT CAST(2000000000 + n_nationkey AS BIGINT) AS from_id, CAST(1000000000 + n_regionkey AS BIGINT) AS to_id, 'in_region' AS relation_type FROM nation
  UNION ALL SELECT CAST(3000000000 + c_custkey AS BIGINT), CAST(2000000000 + c_nationkey AS BIGINT), 'in_nation' FROM customer
  UNION ALL SELECT CAST(4000000000 + s_suppkey AS BIGINT), CAST(2000000000 + s_nationkey AS BIGINT), 'in_nation' FROM supplier
  UNION ALL (SELECT DISTINCT CAST(4000000000 + l_suppkey AS BIGINT), CAST(5000000000 + l_partkey AS BIGINT), 'supplies' FROM lineitem)
  UNION ALL (SELECT DISTINCT CAST(3000000000 + o_custkey AS BIGINT), CAST(5000000000 + l_partkey AS BIGINT), 'bought' FROM orders JOIN lineitem ON l_orderkey = o_orderkey)),
observation AS (
  SELECT CAST(3000000000 + c_custkey AS BIGINT) AS entity_id, 0 AS idx, 'mktsegment: ' || c_mktsegment AS body FROM customer
  UNION ALL SELECT CAST(5000000000 + p_partkey AS BIGINT), 0, 'name: ' || p_name FROM part
  UNION ALL SELECT CAST(5000000000 + p_partkey AS BIGINT), 1, 'brand: ' || p_brand FROM part
  UNION ALL SELECT CAST(5000000000 + p_partkey AS BIGINT), 2, 'type: ' || p_type FROM part
  UNION ALL SELECT CAST(6000000000 + doc_id AS BIGINT), 0, text FROM documents),
attribute AS (
  SELECT 'entity' AS owner_kind, CAST(6000000000 + doc_id AS BIGINT) AS owner_id, 'lang' AS key, lang AS value FROM documents
  UNION ALL SELECT 'entity', CAST(6000000000 + doc_id AS BIGINT), 'source', source FROM documents),
relation_attribute AS (
  SELECT CAST(3000000000 + c_custkey AS BIGINT) AS from_id, CAST(2000000000 + c_nationkey AS BIGINT) AS to_id, 'in_nation' AS relation_type, 'market' AS key, c_mktsegment AS value FROM customer),
attachment AS (
  SELECT doc_id AS attachment_id, CAST(6000000000 + doc_id // 4 AS BIGINT) AS entity_id, 'file' || doc_id || '.txt' AS filename, CAST(2 AS BIGINT) AS revision,
         CASE WHEN doc_id % 5 = 0 THEN 'extracting' ELSE 'ready' END AS status FROM documents),
relation_observation AS (
  SELECT CAST(4000000000 + s_suppkey AS BIGINT) AS from_id, CAST(2000000000 + s_nationkey AS BIGINT) AS to_id, 'in_nation' AS relation_type, 0 AS idx, 'supplier ' || s_name || ' registered' AS body FROM supplier),
chunk_vector AS (
  SELECT vec_id, 'entity' AS owner_kind, CAST(6000000000 + floor(vec_id / 3) AS BIGINT) AS owner_id, CASE WHEN vec_id % 3 = 0 THEN 'identity' ELSE 'observation' END AS kind,
         CAST(vec_id % 3 AS BIGINT) AS chunk_index, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings),
relation_raw AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(4000000000 + l_suppkey AS BIGINT) AS from_id, CAST(5000000000 + l_partkey AS BIGINT) AS to_id FROM lineitem),
change AS (
  SELECT event_id, CAST(3000000000 + user_id AS BIGINT) AS entity_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS operation,
         CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS quiet, ts FROM events)"""
