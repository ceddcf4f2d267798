"""Corpus pipeline: from raw documents to token ids, each stage written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, linededup, neardup, toxicity
from graphloom.llm.common import durable, row_key, table, unused

#: Words of a shingle and percent of shared ones by which documents are near-duplicates.
NEAR = (5, 80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; fitted on labelled rows of ``docs``."""
    added = unused(docs, *toxicity.ADDED)
    scored = toxicity.severity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), added)
    return scored.filter(~F.col(added[-1])).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are spread over many sources; copies make no spread."""
    return linededup.remove_spread_lines(docs, added=unused(docs, *linededup.ADDED)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates; rows without an id stay.

    Of rows that share an id, which are one document, the one with the smallest text stays.
    """
    kept = neardup.near_duplicates(docs, *NEAR).filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns)))
    [at] = unused(docs, "__at")
    return named.withColumn(at, first).filter(F.col(at) == 1).select(docs.columns).union(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id are searched too."""
    key = unused(docs, "__id", "__tag")
    found = decontam.contained_items(docs, table(spark, sf_dir, "benchmark")).select(F.coalesce("doc_id", F.lit(0)).alias(key[0]), F.col("tag").alias(key[1])).distinct()
    return docs.withColumns(dict(zip(key, row_key(), strict=True))).join(found, key, "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256) of each document."""
    coded = bpe.encode_documents(docs, public_tokenizers.path(bpe.VOCABULARY))
    return coded.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The severity model and the encoder can't be expressed in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
