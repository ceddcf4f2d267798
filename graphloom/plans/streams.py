"""Queries run as streams over what is available."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.plans.registry import SQL, query
from graphloom.sources.shared import shared_dir
from graphloom.streaming import events as E
from graphloom.streaming import outbox as O


def _stream(g, table: str):
    """A table as a file stream."""
    path = f"{g.sf_dir}/{table}.parquet"
    schema = g.spark.read.parquet(path).schema
    return g.spark.readStream.schema(schema).parquet(path if _is_folder(g, path) else f"{g.sf_dir}/{table[:-1]}[{table[-1]}].parquet")


def _changes(g):
    return _stream(g, "events").select("event_id", (F.lit(3_000_000_000).cast("long") + F.col("user_id")).alias("entity_id"), F.col("event_type").isin("view", "click").cast("int").alias("quiet"), "ts", F.col("event_type").alias("operation"))


def _place(g) -> str:
    return f"{shared_dir(g.spark)}/stream-{uuid.uuid4().hex}"


def _is_folder(g, path: str) -> bool:
    jvm = g.spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(g.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


@query("stream_event_revisions")
def stream_event_revisions(g):
    at = f"{shared_dir(g.spark)}/stream-{uuid.uuid4().hex}"
    E.number_available(_changes(g), f"{at}/out", f"{at}/checkpoint")
    return g.spark.read.schema("event_id long, entity_id long, entity_revision long").parquet(f"{at}/out").drop("batch")


SQL["stream_event_revisions"] = SQL["event_revisions"]


@query("stream_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type AS operation, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(g):
    """Counts by hour; the watermark is wider than the table, so no row is late and each window is closed by a last batch."""
    at = f"{shared_dir(g.spark)}/stream-{uuid.uuid4().hex}"
    rows = E.windowed_counts(_changes(g), late="3650 days")
    rows.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out")).trigger(availableNow=True).start().awaitTermination()
    out = g.spark.read.parquet(f"{at}/out")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "operation", "n")


_STATUS = {"purchase": 200, "view": 503, "click": 429, "signup": 408}


@query("stream_outbox_states", """
r AS (SELECT event_id // 6 AS delivery_id, epoch_us(ts) // 1000 AS sent, event_id, CASE event_type WHEN 'purchase' THEN 200 WHEN 'view' THEN 503 WHEN 'click' THEN 429 WHEN 'signup' THEN 408 ELSE 404 END AS status,
  CASE WHEN event_id % 7 > 0 THEN event_id % 7 * 900 END AS wait FROM events),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY delivery_id ORDER BY sent, event_id) AS INTEGER) AS attempts FROM r),
s AS (SELECT *, CASE WHEN status = 200 THEN 'done' WHEN status <> 404 AND attempts < 8 THEN 'pending' ELSE 'dead' END AS state FROM n WHERE attempts <= 8),
b AS (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY state = 'pending', CASE WHEN state = 'pending' THEN -attempts ELSE attempts END) AS k FROM s);;
SELECT delivery_id, attempts, state, CAST(CASE WHEN state = 'pending' THEN sent + least(greatest(coalesce(wait, 1000), 1000), 3600000) END AS BIGINT) AS due FROM b WHERE k = 1""")
def stream_outbox_states(g):
    """Six events each as the reports of a delivery."""
    status = F.lit(404)
    for name, code in _STATUS.items():
        status = F.when(F.col("event_type") == name, code).otherwise(status)
    wait = F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 7 * 900).cast("long")
    reports = _stream(g, "events").select(F.floor(F.col("event_id") / 6).alias("delivery_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("report_id"), status.alias("status"), wait.alias("wait"))
    at = _place(g)
    O.deliver_available(reports, f"{at}/out", f"{at}/checkpoint")
    return O.latest_states(g.spark.read.schema(O.TRANSITIONS).parquet(f"{at}/out"))


@query("stream_requests_once", """
r AS (SELECT user_id, CASE WHEN event_id % 10 > 0 THEN event_type || CAST(event_id % 40 AS VARCHAR) END AS key FROM events);;
SELECT DISTINCT user_id, key FROM r WHERE key IS NOT NULL UNION ALL SELECT user_id, key FROM r WHERE key IS NULL""")
def stream_requests_once(g):
    """Repeated requests of a user are dropped; those without a key all stay."""
    key = F.when(F.col("event_id") % 10 > 0, F.concat("event_type", (F.col("event_id") % 40).cast("string")))
    rows = _stream(g, "events").select("user_id", key.alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    at = _place(g)
    O.run(O.once(rows, ["user_id", "key"], "ts", "3650 days"), f"{at}/out", f"{at}/checkpoint")
    return g.spark.read.parquet(f"{at}/out").select("user_id", "key")


@query("stream_causes", """
e AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_id - 1 END AS causation, CASE WHEN event_id % 13 = 5 THEN -1 ELSE event_id // 4 END AS correlation, CASE WHEN event_id % 17 = 3 THEN 9 ELSE event_id % 4 END AS hop FROM events);;
SELECT e.event_id, CASE WHEN e.causation IS NULL THEN CASE WHEN e.hop = 0 THEN 'ok' ELSE 'wrong' END WHEN c.correlation = e.correlation AND e.hop = c.hop + 1 THEN 'ok' ELSE 'wrong' END AS verdict
FROM e LEFT JOIN e c ON c.event_id = e.causation WHERE e.causation IS NULL OR c.event_id IS NOT NULL""")
def stream_causes(g):
    """Events in chains of four; a cause may come any time before or after."""
    n = F.col("event_id")
    rows = [_stream(g, "events").select("event_id", F.when(n % 4 > 0, n - 1).alias("causation"), F.when(n % 13 == 5, F.lit(-1)).otherwise(F.floor(n / 4)).cast("long").alias("correlation"), F.when(n % 17 == 3, F.lit(9)).otherwise(n % 4).cast("int").alias("hop"), F.col("ts").cast("timestamp").alias("ts")) for _ in range(2)]
    at = _place(g)
    O.run(O.with_causes(*rows, "3650 days"), f"{at}/out", f"{at}/checkpoint")
    return g.spark.read.parquet(f"{at}/out")


@query("file_bursts", """
c AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM c),
m AS (SELECT user_id, burst, max(ts) AS last, max(struct_pack(t := ts, k := CASE event_type WHEN 'error' THEN 'delete' ELSE 'write' END)).k AS kind FROM b GROUP BY user_id, burst);;
SELECT 'f' || user_id AS path, last, CASE kind WHEN 'delete' THEN 'purge' ELSE 'index' END AS action FROM m""")
def file_bursts(g):
    """Users as files and events as changes; a burst ends after six quiet hours."""
    e = g.table("events").select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("kind"))
    return E.settled_files(e, "6 hours").withColumn("last", F.col("last").cast("timestamp_ntz"))
