"""Subscription records, and observations as plain texts for older callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("endpoint", "operations", "types", "ignored_origins", "own_origin", "secret_ref", "enabled")


def upsert(known: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """``known`` (subscription_id, *FIELDS, created_at, updated_at) with ``new`` (pos, subscription_id, *FIELDS) in; created_at stays, the later position wins."""
    last = new.filter("subscription_id IS NOT NULL").groupBy("subscription_id").agg(F.max_by(F.struct(*FIELDS), "pos").alias("n"))
    rows = known.alias("k").join(last.alias("l"), "subscription_id", "full")
    fresh = F.col("n").isNotNull()
    fields = [F.when(fresh, F.col(f"n.{f}")).otherwise(F.col(f"k.{f}")).alias(f) for f in FIELDS]
    times = [F.coalesce("created_at", F.lit(now).cast("long")).alias("created_at"), F.when(fresh, F.lit(now).cast("long")).otherwise(F.col("updated_at")).alias("updated_at")]
    return rows.select("subscription_id", *fields, *times)


def delete(known: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, report): without the ids of ``gone``; report (subscription_id, deleted) tells which there were."""
    had = known.select("subscription_id", F.lit(True).alias("had")).distinct()
    report = gone.select("subscription_id").distinct().join(had, "subscription_id", "left").select("subscription_id", F.coalesce("had", F.lit(False)).alias("deleted"))
    return known.join(gone.select("subscription_id"), "subscription_id", "left_anti").select(known.columns), report


def oldest_first(known: DataFrame) -> DataFrame:
    return known.orderBy("created_at", "subscription_id")


def observations_in(raw: Column) -> Column:
    """Observations array<struct<body>> of a JSON list of plain texts; null stays, any other member is an error."""
    members = F.from_json(raw, "array<variant>")
    body = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.variant_get(x, "$", "string")).otherwise(F.raise_error(F.lit("observations must be texts")).cast("string"))
    return F.transform(members, lambda x: F.struct(body(x).alias("body")))


def observations_out(observations: Column) -> Column:
    """The bodies of observations as plain texts, in order."""
    return F.transform(observations, lambda x: x["body"])
