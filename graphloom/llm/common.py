"""Shared helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import discard, durable, shared_dir

__all__ = ["dealt", "discard", "durable", "identified", "pieces", "row_key", "shared_dir", "table", "unused"]

#: Rows handled at a time in Python; Spark bounds the bytes of the batches they are cut from.
PIECE_ROWS = 500
#: Tasks over which the rows of one key are dealt in a join.
SALT = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(parts: Iterator) -> Iterator:
    """Arrow batches, as pandas frames or series, cut into short ones; documents may be long."""
    for p in parts:
        for low in range(0, max(len(p), 1), PIECE_ROWS):
            yield p.iloc[low : low + PIECE_ROWS]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(text: str = "text") -> tuple[Column, Column]:
    """(id, tag) of a row: (doc_id, 0), or (0, a hash of the text) where doc_id is null."""
    ident = F.col("doc_id").cast("long")
    named = F.xxhash64(F.col(text).cast("string")).bitwiseOR(F.lit(1))
    return F.coalesce(ident, F.lit(0)), F.when(ident.isNull(), named).otherwise(F.lit(0)).cast("long")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): rows of ``docs`` under their ``row_key``."""
    ident, tag = row_key()
    return docs.select(ident.alias("doc_id"), tag.alias("tag"), F.col("text").cast("string").alias("text"))


def dealt(many: DataFrame, few: DataFrame, on: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """Join in which the rows of ``many`` with one key are dealt over SALT tasks by the columns ``by``."""
    many = many.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALT)).cast("int"))
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return many.join(few, [*on, "__salt"], how).drop("__salt")
