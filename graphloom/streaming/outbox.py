"""Deliveries as state with timers, replayed requests, and causes that come later.

A delivery keeps one small value in the RocksDB store while it is open: its attempts and
when it is due again. A report moves it on; a timer says when a retry is due; once it is
done or dead its value goes, and so does, after a day, the marker that says so.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators.changelog import delivery_outcome

# Attempts of a delivery; least, usual and longest wait (milliseconds).
ATTEMPTS, LEAST_MS, MOST_MS = 8, 1_000, 3_600_000
#: How long a closed delivery is remembered, so that late reports of it are ignored.
REMEMBERED_MS = 24 * 3_600_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRANSITIONS = "delivery_id long, attempts int, state string, due long"


def _outcome(status: int, attempts: int) -> str:
    """As ``changelog.delivery_outcome``, of one report."""
    again = status in (408, 429) or 500 <= status <= 599
    return "done" if 200 <= status <= 299 else "pending" if again and attempts < ATTEMPTS else "dead"


class Deliveries(StatefulProcessor):
    """Reports (delivery_id, at, report_id, status, wait) to transitions; a timer repeats a transition as ``due`` when its time has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "attempts int, due long")
        self.closed = handle.getValueState("closed", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.closed.exists():
            return
        attempts, due = self.open.get() if self.open.exists() else (0, None)
        # A delivery closes after ATTEMPTS reports at most: the first ones are all that is held.
        first = heapq.nsmallest(ATTEMPTS - attempts, (x for p in rows for x in p[["at", "report_id", "status", "wait"]].itertuples(index=False, name=None)))
        state, before = "pending", due
        for at, _, status, wait in first:
            attempts += 1
            state = _outcome(int(status), attempts)
            due = int(at) + min(max(LEAST_MS if pd.isna(wait) else int(wait), LEAST_MS), MOST_MS) if state == "pending" else None
            if state != "pending":
                break
        if before is not None:
            self.handle.deleteTimer(before)
        if state == "pending":
            self.open.update((attempts, due))
            self.handle.registerTimer(due)
        else:
            self.open.clear()
            self.closed.update((state,))
            self.handle.registerTimer(int(at) + REMEMBERED_MS)
        yield pd.DataFrame({"delivery_id": [key[0]], "attempts": [attempts], "state": [state], "due": pd.array([due], "Int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.open.exists():
            self.closed.clear()
            return
        attempts, due = self.open.get()
        yield pd.DataFrame({"delivery_id": [key[0]], "attempts": [attempts], "state": ["due"], "due": pd.array([due], "Int64")})

    def close(self) -> None:
        pass


def deliver_available(reports: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> dict:
    """Move deliveries on by the reports (delivery_id, at, report_id, status, wait) that are there now and write the transitions under ``path``.

    ``at`` and ``wait`` are milliseconds; a stream begins where the last one on ``checkpoint`` ended. Retries
    fall due as the watermark, ``late`` behind the newest report, passes them. Returns what :func:`run` does.
    """
    spark = reports.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        stamped = reports.filter("delivery_id IS NOT NULL AND at IS NOT NULL AND status IS NOT NULL").withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", late)
        moved = stamped.groupBy("delivery_id").transformWithStateInPandas(Deliveries(), TRANSITIONS, "Append", "EventTime")
        return run(moved, path, checkpoint)
    finally:
        spark.conf.set(STORE, before)


def latest_states(transitions: DataFrame) -> DataFrame:
    """(delivery_id, attempts, state, due) of each delivery after its last report."""
    said = transitions.filter("state <> 'due'").groupBy("delivery_id").agg(F.max(F.struct("attempts", "state", "due")).alias("m"))
    return said.select("delivery_id", "m.*")


def folded_states(reports: DataFrame) -> DataFrame:
    """The same from a table: the first report that closes a delivery holds, else its last one."""
    order = Window.partitionBy("delivery_id").orderBy("at", "report_id")
    numbered = reports.withColumn("attempts", F.row_number().over(order)).filter(F.col("attempts") <= ATTEMPTS)
    numbered = numbered.withColumn("state", delivery_outcome(F.col("status"), F.col("attempts"), ATTEMPTS))
    wait = F.least(F.greatest(F.coalesce("wait", F.lit(LEAST_MS)), F.lit(LEAST_MS)), F.lit(MOST_MS))
    row = F.struct(F.when(F.col("state") == "pending", -F.col("attempts")).otherwise(F.lit(-1000) + F.col("attempts")).alias("k"), "attempts", "state", F.when(F.col("state") == "pending", F.col("at") + wait).alias("due"))
    best = numbered.groupBy("delivery_id").agg(F.min(row).alias("m"))
    return best.select("delivery_id", "m.attempts", "m.state", "m.due")


def once(requests: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """A stream of ``requests`` whose repetitions (equal ``keys``) within ``within`` are dropped; rows with a null key all stay.

    What is older than the watermark is dropped, and ``run`` counts it.
    """
    stamped = requests.withWatermark(at, within)
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    # A row without a key is a key of its own.
    own = F.when(null, F.uuid()).otherwise(F.lit(""))
    return stamped.withColumn("__own", own).dropDuplicatesWithinWatermark([*keys, "__own"]).drop("__own")


def with_causes(events: DataFrame, causes: DataFrame, within: str) -> DataFrame:
    """A stream of ``events`` (event_id, causation, correlation, hop, ts) with the verdict on their cause: ok, unknown or wrong.

    ``causes`` are the same events as a second stream; a cause may come up to ``within`` before or after what
    it caused. An event whose cause doesn't come in that time is unknown; one without a cause is ok at hop 0.
    """
    first = events.filter("causation IS NULL").select("event_id", F.when(F.col("hop") == 0, "ok").otherwise("wrong").alias("verdict"))
    # All events move the watermark on: the test names ``ts`` so that it stays above it.
    e = events.withWatermark("ts", within).filter(F.when(F.col("ts").isNotNull(), F.col("causation")).isNotNull())
    c = causes.select(F.col("event_id").alias("cause"), F.col("correlation").alias("c"), F.col("hop").alias("h"), F.col("ts").alias("cause_ts")).withWatermark("cause_ts", within)
    near = F.expr(f"causation = cause AND cause_ts >= ts - INTERVAL {within} AND cause_ts <= ts + INTERVAL {within}")
    met = e.join(c, near, "left_outer")
    fits = (F.col("c") == F.col("correlation")) & (F.col("hop") == F.col("h") + 1)
    verdict = F.when(F.col("cause").isNull(), "unknown").when(fits, "ok").otherwise("wrong")
    return met.select("event_id", verdict.alias("verdict")).union(first)


def run(rows: DataFrame, path: str, checkpoint: str) -> dict:
    """Write what is there now of a stream as Parquet; returns the numbers of rows taken, dropped as late, and held as state."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.recentProgress
    late = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    held = sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"]) if progress else 0
    return {"rows": sum(p["numInputRows"] for p in progress), "late": late, "held": held}
