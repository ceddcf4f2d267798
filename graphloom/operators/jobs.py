"""Leased jobs as transitions of a whole job table.

A job table holds its key columns, state, next_attempt, epoch, lease_until, attempts and
last_error. The epoch rises with each claim, so (key, epoch) names one lease. Reports of
workers are tables too: a transition joins them to the jobs whose lease they still hold
and leaves all other jobs as they are. A key has one report at most. Jobs with a null in
their key are kept and never claimed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attempts of an extraction, its stages, characters of an error kept, its last error.
ATTEMPTS = 8
STAGES = ("config", "render", "provider", "decode", "storage")
ERROR_CHARS = 2048
EXHAUSTED = "extraction attempt limit exceeded"


def _due(now: int) -> Column:
    return ((F.col("state") == "pending") & (F.col("next_attempt") <= now)) | ((F.col("state") == "leased") & (F.col("lease_until") <= now))


def _reported(jobs: DataFrame, reports: DataFrame, key: Sequence[str], now: int) -> tuple[DataFrame, Column]:
    """``jobs`` with the columns of reports (key, epoch, ...) as ``said``, and whether the report still holds the lease."""
    said = reports.select(*key, F.struct(*[c for c in reports.columns if c not in key]).alias("said"))
    rows = jobs.join(said, list(key), "left")
    held = F.col("said").isNotNull() & (F.col("state") == "leased") & (F.col("said.epoch") == F.col("epoch")) & (F.col("lease_until") > now)
    return rows, F.coalesce(held, F.lit(False))


def _changed(rows: DataFrame, jobs: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    return rows.select(*[F.when(when, values[c]).otherwise(F.col(c)).cast(jobs.schema[c].dataType).alias(c) if c in values else F.col(c) for c in jobs.columns])


def claim(jobs: DataFrame, key: Sequence[str], now: int, lease: int, most: int, attempts: int | None = None) -> DataFrame:
    """``jobs`` after up to ``most`` due ones are leased until now + lease: by next attempt, then key.

    Due: pending with next_attempt <= now, or leased with lease_until <= now; with
    ``attempts``, only jobs tried less often than that.
    """
    due = _due(now) if attempts is None else _due(now) & (F.col("attempts") < attempts)
    first = jobs.filter(due).dropna(subset=list(key)).orderBy("next_attempt", *key).limit(most).select(*key, F.lit(True).alias("__first"))
    values = {"state": F.lit("leased"), "epoch": F.col("epoch") + 1, "attempts": F.col("attempts") + 1, "lease_until": F.lit(now + lease)}
    return _changed(jobs.join(first, list(key), "left"), jobs, F.col("__first").isNotNull(), values)


def renew(jobs: DataFrame, reports: DataFrame, key: Sequence[str], now: int, lease: int) -> DataFrame:
    """``jobs`` with the leases of reports (key, epoch) prolonged; a lease that ends at ``now`` is lost."""
    rows, held = _reported(jobs, reports, key, now)
    return _changed(rows, jobs, held, {"lease_until": F.lit(now + lease)})


def retry(jobs: DataFrame, reports: DataFrame, key: Sequence[str], now: int, attempts: int | None = None) -> DataFrame:
    """``jobs`` after failures (key, epoch, next_attempt, error, dead): pending again, or dead if said or tried ``attempts`` times."""
    rows, held = _reported(jobs, reports, key, now)
    dead = F.coalesce(F.col("said.dead"), F.lit(False))
    if attempts is not None:
        dead |= F.col("attempts") >= attempts
    values = {"state": F.when(dead, "dead").otherwise("pending"), "next_attempt": F.col("said.next_attempt"), "last_error": F.substring("said.error", 1, ERROR_CHARS)}
    return _changed(rows, jobs, held, values)


def without_dead(chunks: DataFrame, jobs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Chunks of owners whose job isn't dead: a dead job's owner keeps no outdated vectors."""
    return chunks.join(jobs.filter("state = 'dead'").select(*key), list(key), "left_anti")


def exhaust(jobs: DataFrame, now: int, attempts: int = ATTEMPTS) -> DataFrame:
    """``jobs`` with those dead whose last lease ran out at the attempt limit."""
    over = (F.col("state") == "leased") & (F.col("lease_until") <= now) & (F.col("attempts") >= attempts)
    return _changed(jobs, jobs, F.coalesce(over, F.lit(False)), {"state": F.lit("dead"), "last_error": F.coalesce("last_error", F.lit(EXHAUSTED))})


def complete(jobs: DataFrame, attachments: DataFrame, reports: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, attachments, held) after extractions (attachment_id, epoch, revision).

    A report counts if it holds its lease and the attachment (attachment_id, revision,
    status) is still being extracted at that revision. The job is done, the attachment
    ready at the next revision; ``held`` (attachment_id, revision) is what to index.
    """
    live = attachments.filter("status = 'extracting'").select("attachment_id", "revision")
    rows, held = _reported(jobs, reports.join(live, ["attachment_id", "revision"], "left_semi"), ["attachment_id"], now)
    done = rows.filter(held).select("attachment_id", F.lit(True).alias("__done"))
    after = attachments.join(done, "attachment_id", "left")
    values = {"status": F.lit("ready"), "revision": F.col("revision") + 1}
    after = _changed(after, attachments, F.col("__done").isNotNull(), values)
    return _changed(rows, jobs, held, {"state": F.lit("done")}), after, after.join(done, "attachment_id", "left_semi").select("attachment_id", "revision")


def failed_stage(attachments: DataFrame, failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """``attachments`` with status and error_stage after failures (attachment_id, stage) whose jobs were set by ``retry``."""
    known = F.when(F.col("stage").isin(*STAGES), F.col("stage")).otherwise(F.raise_error(F.lit("no such stage")).cast("string"))
    said = failures.select("attachment_id", known.alias("__stage")).join(jobs.select("attachment_id", F.col("state").alias("__state")), "attachment_id")
    values = {"status": F.when(F.col("__state") == "dead", "error").otherwise("extracting"), "error_stage": F.col("__stage")}
    return _changed(attachments.join(said, "attachment_id", "left"), attachments, F.col("__stage").isNotNull(), values)


def replace_segments(stored: DataFrame, pages: DataFrame, held: DataFrame, size: int) -> DataFrame:
    """``stored`` (attachment_id, chunk_index, page, segment_index, text) with the pages (attachment_id, page, text) of ``held`` cut anew.

    Segments hold ``size`` characters and never nothing; chunk_index runs on over an attachment's pages.
    """
    n = F.ceil(F.length("text") / size).cast("int")
    mine = pages.join(held.select("attachment_id"), "attachment_id", "left_semi").filter(n > 0).withColumn("n", n)
    # One row a page, not a segment, is numbered.
    before = F.sum("n").over(Window.partitionBy("attachment_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    cut = mine.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("segment_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    fresh = cut.select("attachment_id", (F.col("before") + F.col("segment_index")).cast("long").alias("chunk_index"), "page", F.col("segment_index").cast("long"), F.substr("text", F.col("segment_index") * size + 1, F.lit(size)).alias("text"))
    return stored.select(fresh.columns).join(held.select("attachment_id"), "attachment_id", "left_anti").union(fresh)
