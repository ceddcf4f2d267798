"""Integrity audits and repair of relation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(relation: DataFrame, key: list[str]) -> DataFrame:
    """Key and row count of keys that occur more than once."""
    return relation.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(relation: DataFrame, entity: DataFrame) -> DataFrame:
    """(from_id, to_id, missing): relations with an end that is no entity; ``missing`` names the ends."""
    ids = entity.select("id").distinct()
    a = relation.join(ids, F.col("from_id") == F.col("id"), "left").withColumnRenamed("id", "a")
    both = a.join(ids, F.col("to_id") == F.col("id"), "left").withColumnRenamed("id", "b")
    missing = F.concat_ws("+", F.when(F.col("a").isNull(), "from"), F.when(F.col("b").isNull(), "to"))
    return both.filter("a IS NULL OR b IS NULL").select("from_id", "to_id", missing.alias("missing"))


def counter_drift(stored: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """(key, stored, counted) where a stored counter and the recount differ; absent means 0."""
    rows = stored.select(key, F.col("n").alias("stored")).join(counted.select(key, F.col("n").alias("counted")), key, "full")
    rows = rows.select(key, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("counted", F.lit(0)).alias("counted"))
    return rows.filter(F.col("stored") != F.col("counted"))


def keepers(relation: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order: what repair keeps."""
    first = Window.partitionBy(*key).orderBy(*order)
    return relation.withColumn("__at", F.row_number().over(first)).filter("__at = 1").drop("__at")
