"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has almost no Jaccard similarity to it, so only the
items are summarised. They are partitioned by set size in powers of two; the MinHash
sketch of an item is its K smallest shingle hashes, with K = 2 * miss + 1 for the
partition and miss = floor((1 - t) * hi) for containment threshold t and sizes up to hi.
A document that holds t of an item's n shingles misses at most floor((1 - t) * n) of
them, so it holds one of any floor((1 - t) * n) + 1 sketch values. Of a sketch the values
in the fewest sketches are looked up, so that wording which many items share proposes
nothing as long as it makes up less than half of an item. No pair is missed; only
proposed pairs are verified, by exact containment of the full sets.

Documents are read once. Of their shingles those go on that pass a Bloom filter of all
item shingles, a bitmap of fixed size; with more items it lets more through, which costs
time and changes no result. Joins are dealt by key and salt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import dealt, durable, identified, pieces, table
from graphloom.llm.shingles import PLAIN, shingle_sets

WIDTH = 5
PERCENT = 80
#: Bits of the filter, 8 MB at any number of items.
FILTER_BITS = 1 << 26
_U = np.uint64


def _item_shingles(items: DataFrame, width: int) -> DataFrame:
    """(item_id, shingle): the distinct shingles of each item."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in pieces(parts):
            sets = list(shingle_sets(p["text"].tolist(), width, PLAIN))
            yield pd.DataFrame({"item_id": np.repeat(p["item_id"].to_numpy(), [len(s) for s in sets]), "shingle": np.concatenate([*sets, np.zeros(0, _U)]).view(np.int64)})

    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    return texts.mapInPandas(rows, "item_id long, shingle long").distinct()


def item_sketches(items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(item_id, n, shingle, probe) of all items; ``probe`` marks the sketch values that are looked up.

    Rows that share an item_id are one item with the shingles of all of them.
    """
    by_item = Window.partitionBy("item_id")
    sets = _item_shingles(items, width).withColumn("n", F.count(F.lit(1)).over(by_item))
    miss = lambda size: F.floor((100 - percent) * size / 100)
    length = 2 * miss(F.pow(F.lit(2), F.ceil(F.log2("n")))) + 1
    sets = durable(sets.withColumn("sketched", F.row_number().over(by_item.orderBy("shingle")) <= length), "sets")
    shared = sets.filter("sketched").groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    ranked = sets.join(shared, "shingle", "left").withColumn("at", F.row_number().over(by_item.orderBy(F.desc("sketched"), "items", "shingle")))
    return ranked.select("item_id", "n", "shingle", (F.col("at") <= miss(F.col("n")) + 1).alias("probe"))


def shingle_filter(sets: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of all shingles, FILTER_BITS / 64 numbers whatever the number of items."""
    low = F.col("shingle").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = sets.select(F.shiftright(low, 6).alias("word"), F.expr("shiftleft(1L, CAST(shingle & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toPandas()  # FILTER_BITS / 64 rows at most
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return bitmap.view(_U)


def _held(docs: DataFrame, bitmap: np.ndarray, width: int) -> DataFrame:
    """(doc_id, tag, shingle): the distinct shingles of each document that pass the filter."""
    data = docs.sparkSession.sparkContext.broadcast(bitmap)

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = data.value
        for p in pieces(parts):
            kept = [s[(bits[((s & _U(FILTER_BITS - 1)) >> _U(6)).astype(np.int64)] >> (s & _U(63))) & _U(1) > 0] for s in shingle_sets(p["text"].tolist(), width, PLAIN)]
            n = [len(s) for s in kept]
            yield pd.DataFrame({"doc_id": np.repeat(p["doc_id"].to_numpy(), n), "tag": np.repeat(p["tag"].to_numpy(), n), "shingle": np.concatenate([*kept, np.zeros(0, _U)]).view(np.int64)})

    return docs.mapInPandas(rows, "doc_id long, tag long, shingle long").distinct()


def candidates(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc_id, tag, item_id): pairs that share a value that is looked up."""
    return dealt(held, sets.filter("probe").select("item_id", "shingle"), ["shingle"], ["doc_id", "tag"]).select("doc_id", "tag", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, tag): items held in documents.

    A pair is returned if the document's set of ``width``-word shingles holds at least
    ``percent`` percent of the item's. Words are runs of letters, digits and non-ASCII
    characters; A-Z equal a-z; shorter texts are one shingle. Null or wordless texts hold
    and are held by nothing; repeated rows give one pair; rows with the same doc_id are
    one document and rows with the same item_id one item. A row without a doc_id is the
    document of its text: its doc_id is null and its ``tag`` that of ``identified``, else
    0. Items without an id are left out. Other columns are ignored; empty tables give no rows.
    """
    sets = durable(item_sketches(items, width, percent), "items")
    held = durable(_held(identified(docs), shingle_filter(sets), width), "held")
    pairs = durable(candidates(held, sets), "candidates")
    wanted = dealt(pairs, sets.select("item_id", "n", "shingle"), ["item_id"], ["doc_id", "tag"])
    shared = held.join(wanted, ["doc_id", "tag", "shingle"]).groupBy("doc_id", "tag", "item_id", F.col("n").alias("n_item")).agg(F.count(F.lit(1)).alias("n_shared"))
    found = shared.filter(100 * F.col("n_shared") >= percent * F.col("n_item"))
    return found.select(F.when(F.col("tag") == 0, F.col("doc_id")).alias("doc_id"), "item_id", "n_shared", "n_item", "tag")


def op6_contained(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles_sql(source: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) < {WIDTH} THEN CASE WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
      ELSE list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' ')) END) AS s
    FROM (SELECT {key}, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {source})"""


OP6_SQL = f"""
WITH d AS ({_shingles_sql('documents', 'doc_id')}), i AS ({_shingles_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item
FROM i JOIN d USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= {PERCENT} * n_item"""
