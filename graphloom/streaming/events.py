"""Streaming twins of the change log, and the signed envelopes of its consumers."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.changelog import running_sum
from graphloom.sources.shared import durable

ENVELOPE_BYTES = 1 << 20


def number_available(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Give the events (event_id, entity_id, quiet, ts) that are there now their revisions, write them under ``path`` and stop.

    Events of a batch are taken in order of (ts, event_id); a later batch continues from
    the revision reached. State is a table of one number an entity, written anew with each
    batch; a batch that is run again overwrites its own output. The events of one entity
    are dealt by hour, so none is held whole.
    """

    def number(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        rows = durable(rows.select("event_id", "entity_id", "quiet", "ts"), "batch")
        known = spark.read.parquet(f"{checkpoint}/revisions/{n - 1}") if n else spark.createDataFrame([], "entity_id long, revision long")
        quiet = F.coalesce(F.col("quiet").cast("long"), F.lit(0))
        counted = running_sum(rows, "entity_id", 1 - quiet, ["ts", "event_id"], F.date_trunc("hour", "ts"), "raised")
        first = rows.groupBy("entity_id").agg(F.min_by(quiet, F.struct("ts", "event_id")).alias("first_quiet"))
        # A first event that is quiet opens revision 1.
        before = known.select(F.col("entity_id").alias("known_id"), "revision")
        start = first.join(before, F.col("entity_id").eqNullSafe(F.col("known_id")), "left").select(F.col("entity_id").alias("start_id"), F.coalesce("revision", "first_quiet").alias("start"))
        out = counted.join(start, F.col("entity_id").eqNullSafe(F.col("start_id"))).select("event_id", "entity_id", (F.col("raised") + F.col("start")).alias("entity_revision"))
        out.write.mode("overwrite").parquet(f"{path}/batch={n}")
        reached = spark.read.parquet(f"{path}/batch={n}").groupBy("entity_id").agg(F.max("entity_revision").alias("revision"))
        known.join(reached.select(F.col("entity_id").alias("now")), F.col("entity_id").eqNullSafe(F.col("now")), "left_anti").unionByName(reached).write.mode("overwrite").parquet(f"{checkpoint}/revisions/{n}")

    changes.writeStream.foreachBatch(number).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(changes: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, operation, n): events by tumbling window; rows later than ``late`` are not counted."""
    stamped = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = stamped.groupBy(F.window("ts", size), "operation").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), "operation", "n")


def watch_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream (path, modificationTime, content) of files that appear under ``path``."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "content")


def settled_files(changes: DataFrame, quiet: str = "2 seconds") -> DataFrame:
    """(path, last, action): what to do with each file once it was quiet for ``quiet``: its last kind of change (path, ts, kind) of a burst; delete purges, all else indexes.

    Works on tables and, with a watermark, on streams.
    """
    burst = changes.groupBy("path", F.session_window("ts", quiet).alias("burst")).agg(F.max(F.struct("ts", "kind")).alias("m"))
    return burst.select("path", F.col("m.ts").alias("last"), F.when(F.col("m.kind") == "delete", "purge").otherwise("index").alias("action"))


def signature(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text, in hex: two hashes over the padded key and the text."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))), 256)


def envelopes(deliveries: DataFrame, secret: str) -> DataFrame:
    """(delivery_id, body, signature): signed JSON of each delivery; bodies over the size cap are refused."""
    rest = [c for c in deliveries.columns if c != "delivery_id"]
    rows = deliveries.select("delivery_id", F.to_json(F.struct(F.lit(3).alias("version"), "delivery_id", *rest)).alias("body"))
    return rows.filter(F.octet_length("body") <= ENVELOPE_BYTES).withColumn("signature", signature(F.col("body"), secret))
