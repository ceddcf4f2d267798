"""The change log and its consumers as set operations over whole logs.

A batch plans all keys at once: fan-out is a join, a claim is the first due row of each key, a fenced commit is a
join on the fence columns. Nothing is polled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tasks over which the events that ask for one wildcard key are dealt.
DEALS = 32


def running_sum(rows: DataFrame, key: str, value: Column, order: list[str], part: Column, out: str) -> DataFrame:
    """Running sum of ``value`` by ``key`` in ``order``; ``part`` cuts a key into consecutive runs.

    ``part`` must not fall along ``order``. Runs are summed first, so a key with a third
    of all rows is split over its runs. Every row stays: rows without a key are one key,
    and nulls in ``order`` and ``part`` come first; a null value adds nothing.
    """
    rows = rows.withColumns({"__part": part, "__value": F.coalesce(value, F.lit(0))})
    sums = rows.groupBy(key, "__part").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(key).alias("__key"), F.col("__part").alias("__run"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.sum("__value").over(inside)).join(base, F.col(key).eqNullSafe(F.col("__key")) & F.col("__part").eqNullSafe(F.col("__run")))
    return rows.withColumn(out, F.col("__own") + F.col("__base")).drop("__part", "__value", "__own", "__base", "__key", "__run")


def event_revisions(change: DataFrame) -> DataFrame:
    """``change`` with ``entity_revision``: raised by each event that is not quiet.

    Quiet events repeat the revision; a first event that is quiet still opens revision 1. An event
    without a time comes before the others, one without a mark is not quiet, and those without
    an entity are numbered together.
    """
    quiet = F.coalesce(F.col("quiet").cast("long"), F.lit(0))
    counted = running_sum(change, "entity_id", 1 - quiet, ["ts", "event_id"], F.date_trunc("hour", "ts"), "entity_revision")
    first = change.groupBy(F.col("entity_id").alias("__entity")).agg(F.min_by(quiet, F.struct("ts", "event_id")).alias("first_quiet"))
    return counted.join(first, F.col("entity_id").eqNullSafe(F.col("__entity"))).withColumn("entity_revision", F.col("entity_revision") + F.col("first_quiet")).drop("first_quiet", "__entity")


def fan_out(change: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, subscription_id): each event once for each enabled subscription that wants it.

    ``subscriptions`` (subscription_id, operations, types, ignored_origins, own_origin) may
    have any number of rows, and a column ``enabled``, where anything but true or 1 switches a
    subscription off. An empty or null list wants all; an own or ignored origin is skipped, and no
    origin is neither.
    """
    if "enabled" in subscriptions.columns:
        subscriptions = subscriptions.filter(F.coalesce(F.col("enabled").cast("boolean"), F.lit(False)))
    # One key for each operation and type wanted; an empty list gives one null key, and an event asks for both.
    keys = lambda xs: F.explode(F.when(F.size(F.coalesce(F.col(xs), F.array())) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.filter(F.array_distinct(xs), lambda x: x.isNotNull())))
    subs = subscriptions.withColumn("__operation", keys("operations")).withColumn("__type", keys("types"))
    rows = change.select("event_id", "origin", F.explode(F.array_distinct(F.array("operation", F.lit(None)))).alias("__o"), "entity_type")
    rows = rows.select("event_id", "origin", "__o", F.explode(F.array_distinct(F.array("entity_type", F.lit(None)))).alias("__t"))
    # A key of wildcards is asked for by all events, so these are dealt and its subscriptions go to every deal.
    wild = lambda a, b: F.col(a).isNull() | F.col(b).isNull()
    rows = rows.withColumn("__deal", F.when(wild("__o", "__t"), F.pmod(F.xxhash64("event_id"), F.lit(DEALS))).otherwise(F.lit(0)).cast("int"))
    subs = subs.withColumn("__place", F.explode(F.sequence(F.lit(0), F.when(wild("__operation", "__type"), DEALS - 1).otherwise(F.lit(0)))))
    meets = F.col("__operation").eqNullSafe(F.col("__o")) & F.col("__type").eqNullSafe(F.col("__t")) & (F.col("__place") == F.col("__deal"))
    skipped = F.coalesce(F.array_contains(F.col("ignored_origins"), F.col("origin")), F.lit(False)) | F.coalesce(F.col("own_origin") == F.col("origin"), F.lit(False))
    return rows.join(subs, meets & ~skipped).select("event_id", "subscription_id").distinct()


def due_claims(outbox: DataFrame, now: int) -> DataFrame:
    """The first due delivery of each subscription without a live lease, with its next epoch.

    Due: pending with next_attempt <= now, or leased with lease_until <= now.
    """
    due = ((F.col("state") == "pending") & (F.col("next_attempt") <= now)) | ((F.col("state") == "leased") & (F.col("lease_until") <= now))
    live = (F.col("state") == "leased") & (F.col("lease_until") > now)
    first = outbox.groupBy("subscription_id").agg(F.max(live.cast("int")).alias("busy"), F.min(F.when(due, F.struct("next_attempt", "delivery_id", "epoch"))).alias("f"))
    return first.filter("busy = 0 AND f IS NOT NULL").select("subscription_id", "f.delivery_id", (F.col("f.epoch") + 1).alias("epoch"))


def delivery_outcome(status: Column, attempts: Column, limit: int = 8) -> Column:
    """done for 2xx; pending again for 408, 429 and 5xx below the attempt limit; else dead."""
    retry = status.isin(408, 429) | status.between(500, 599)
    return F.when(status.between(200, 299), "done").when(retry & (attempts < limit), "pending").otherwise("dead")


def delivery_transition(status: Column, attempts: Column, now: int, retry_after: Column) -> tuple[Column, Column]:
    """(state, next_attempt): ``delivery_outcome``, and for another attempt the time asked for, or a second, clamped to 1 s to 1 h (microseconds)."""
    state = delivery_outcome(status, attempts)
    wait = F.least(F.greatest(F.coalesce(retry_after, F.lit(1_000_000)), F.lit(1_000_000)), F.lit(3_600_000_000))
    return state, F.when(state == "pending", F.lit(now) + wait)


def served_profiles(registry: DataFrame) -> DataFrame:
    """(profile): the serving profile, and the candidate while one is being built (serving, candidate, state)."""
    building = registry.filter("state = 'Rebuilding' AND candidate IS NOT NULL").select(F.col("candidate").alias("profile"))
    return registry.filter("serving IS NOT NULL").select(F.col("serving").alias("profile")).union(building).distinct()


def commit_chunks(chunks: DataFrame, held: DataFrame, new: DataFrame, generation: int) -> tuple[DataFrame, int]:
    """(chunks, generation) after the commits ``held`` (entity_id, ...) that kept their fence: all chunks (owner_id, ...) of their entities are replaced by those of ``new``."""
    owners = held.select(F.col("entity_id").alias("owner_id")).distinct()
    after = chunks.join(owners, "owner_id", "left_anti").select(chunks.columns).union(new.join(owners, "owner_id", "left_semi").select(chunks.columns))
    return after, generation + (0 if owners.isEmpty() else 1)


def latest_jobs(change: DataFrame) -> DataFrame:
    """(entity_id, entity_revision, operation): the newest revision of each entity."""
    newest = change.filter("quiet = 0").groupBy("entity_id").agg(F.max(F.struct("entity_revision", "event_id", "operation")).alias("m"))
    return newest.select("entity_id", "m.entity_revision", "m.operation")


def fenced(commits: DataFrame, live: DataFrame, now: int) -> DataFrame:
    """Commits (entity_id, epoch, revision, lease_until) that still hold their fence in ``live`` (entity_id, epoch, revision)."""
    held = commits.filter(F.col("lease_until") > now)
    return held.join(live, ["entity_id", "epoch", "revision"], "left_semi")


def missing_chunks(live: DataFrame, chunks: DataFrame) -> DataFrame:
    """(owner_id, fault): owners without chunks, and chunks without a live owner: what a full scan must find empty."""
    lost = live.join(chunks, "owner_id", "left_anti").select("owner_id", F.lit("no chunk").alias("fault"))
    return lost.union(chunks.select("owner_id").distinct().join(live, "owner_id", "left_anti").select("owner_id", F.lit("no owner").alias("fault")))


def scan_faults(entity: DataFrame, mirror: DataFrame, attachment: DataFrame, segment: DataFrame, chunks: DataFrame, jobs: DataFrame, attachment_jobs: DataFrame) -> DataFrame:
    """(fault, owner_kind, owner_id): all that keeps a full scan from being served; it must find nothing.

    ``entity`` (id, entity_type, revision, live), ``mirror`` (relation_id, revision, deleted),
    ``attachment`` (attachment_id, entity_id, status, revision), ``segment`` (attachment_id,
    chunk_index, text), ``chunks`` (owner_kind, owner_id, kind, chunk_index, owner_revision,
    type), ``jobs`` (owner_kind, owner_id, revision, state) and ``attachment_jobs``
    (attachment_id, state). A dead job excuses an owner without chunks.
    """
    key = ["owner_kind", "owner_id"]
    said = lambda rows, fault, kind, owner: rows.select(F.lit(fault).alias("fault"), F.lit(kind).alias("owner_kind"), F.col(owner).alias("owner_id")).distinct()
    out = []
    live = entity.filter("live")
    owners = {"entity": (live.select(F.col("id").alias("owner_id"), "revision"), "identity"), "relation": (mirror.filter("NOT deleted").select(F.col("relation_id").alias("owner_id"), "revision"), "relation")}
    for kind, (rows, chunk) in owners.items():
        dead = jobs.filter((F.col("owner_kind") == kind) & (F.col("state") == "dead")).select("owner_id")
        mine = chunks.filter(F.col("owner_kind") == kind)
        current = mine.filter(F.col("kind") == chunk).select("owner_id", F.col("owner_revision").alias("revision"))
        out.append(said(rows.join(dead, "owner_id", "left_anti").join(current, ["owner_id", "revision"], "left_anti"), "stale", kind, "owner_id"))
        out.append(said(mine.join(rows, "owner_id", "left_anti"), "no owner", kind, "owner_id"))
    ready = attachment.filter("status = 'ready'").join(live.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    ready = ready.select(F.col("attachment_id").alias("owner_id"), "revision", F.col("entity_type").alias("type"))
    texts = segment.filter("text <> ''").select(F.col("attachment_id").alias("owner_id"), "chunk_index")
    mine = chunks.filter("owner_kind = 'attachment'")
    job = jobs.filter("owner_kind = 'attachment'").select("owner_id", F.col("revision").alias("job_revision"), "state")
    count = lambda rows, name: rows.groupBy("owner_id").agg(F.count(F.lit(1)).alias(name))
    judged = ready.join(job, "owner_id", "left").join(count(texts, "texts"), "owner_id", "left").join(count(mine, "vectors"), "owner_id", "left").fillna(0, ["texts", "vectors"])
    unfit = F.col("state").isNull() | (F.col("job_revision") != F.col("revision")) | ((F.col("state") != "dead") & ((F.col("state") != "done") | (F.col("texts") != F.col("vectors")))) | ((F.col("state") == "dead") & (F.col("vectors") > 0))
    out.append(said(judged.filter(unfit), "job or count", "attachment", "owner_id"))
    fitting = mine.filter("kind = 'attachment'").select("owner_id", "chunk_index", F.col("owner_revision").alias("revision"), "type")
    asked = judged.filter("state <> 'dead'").select("owner_id", "revision", "type").join(texts, "owner_id")
    out.append(said(asked.join(fitting, ["owner_id", "chunk_index", "revision", "type"], "left_anti"), "segment without vector", "attachment", "owner_id"))
    wanted = ready.join(texts, "owner_id").select("owner_id", "chunk_index", F.col("revision").alias("owner_revision"), "type", F.lit("attachment").alias("kind"))
    out.append(said(mine.join(wanted, ["owner_id", "chunk_index", "owner_revision", "type", "kind"], "left_anti"), "vector without segment", "attachment", "owner_id"))
    out.append(said(attachment_jobs.filter("state IN ('pending', 'leased')"), "extracting", "attachment", "attachment_id"))
    unfinished = jobs.filter("state NOT IN ('done', 'dead')").select(F.lit("unfinished").alias("fault"), *key).distinct()
    rows = unfinished
    for more in out:
        rows = rows.union(more)
    return rows


def type_jobs(subjects: DataFrame, vectors: DataFrame) -> DataFrame:
    """(kind, name, revision, operation): what brings the vectors (kind, name, revision) of types up to ``subjects`` (kind, name, revision): upsert of missing and outdated ones, delete of others."""
    stale = subjects.join(vectors, ["kind", "name", "revision"], "left_anti").select("kind", "name", "revision", F.lit("upsert").alias("operation"))
    gone = vectors.join(subjects, ["kind", "name"], "left_anti").select("kind", "name", "revision", F.lit("delete").alias("operation"))
    return stale.union(gone)


def type_snapshots(subjects: DataFrame, vectors: DataFrame, jobs: DataFrame) -> DataFrame:
    """(kind, n, served): for each kind the vectors of its types, and whether they may be served.

    A kind is served if it has no unfinished job (kind, name, state), no vector of a type
    that is gone, and a vector at its revision for each type but those whose job is dead.
    """
    kinds = subjects.select("kind").union(vectors.select("kind")).union(jobs.select("kind")).distinct()
    dead = jobs.filter("state = 'dead'").select("kind", "name")
    faults = type_jobs(subjects, vectors)
    faults = faults.filter("operation = 'delete'").select("kind").union(faults.filter("operation = 'upsert'").join(dead, ["kind", "name"], "left_anti").select("kind")).union(jobs.filter("state NOT IN ('done', 'dead')").select("kind"))
    rows = kinds.join(vectors.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", "left").join(faults.distinct().withColumn("faulty", F.lit(True)), "kind", "left")
    return rows.select("kind", F.coalesce("n", F.lit(0)).alias("n"), F.col("faulty").isNull().alias("served"))


def idempotency(requests: DataFrame) -> DataFrame:
    """(request_id, outcome): first use of a (principal, key) applies; the same fingerprint replays, another conflicts.

    A request without a key always applies; principals without a name are one principal.
    """
    first = requests.filter("key IS NOT NULL").groupBy(F.col("principal").alias("__principal"), F.col("key").alias("__key")).agg(F.min(F.struct("request_id", "fingerprint")).alias("f"))
    rows = requests.join(first, F.col("principal").eqNullSafe(F.col("__principal")) & (F.col("key") == F.col("__key")), "left")
    applies = F.col("key").isNull() | F.col("request_id").eqNullSafe(F.col("f.request_id"))
    return rows.select("request_id", F.when(applies, "apply").when(F.col("fingerprint").eqNullSafe(F.col("f.fingerprint")), "replay").otherwise("conflict").alias("outcome"))


def causation_faults(events: DataFrame, hops: int = 15) -> DataFrame:
    """(event_id): hop above the limit, a hop without a cause or a cause without a hop, or a cause of another correlation or hop."""
    cause = events.select(F.col("event_id").alias("cause"), F.col("correlation").alias("c"), F.col("hop").alias("h"))
    rows = events.join(cause, F.col("causation") == F.col("cause"), "left")
    linked = F.col("cause").isNotNull() & (F.col("c") == F.col("correlation")) & (F.col("hop") == F.col("h") + 1)
    good = (F.col("hop") <= hops) & F.when(F.col("causation").isNull(), F.col("hop") == 0).otherwise((F.col("hop") > 0) & linked)
    return rows.filter(~good).select("event_id")


def next_due(*queues: DataFrame) -> DataFrame:
    """(due): the earliest time at which any of the queues (due) has work."""
    out = queues[0].select("due")
    for q in queues[1:]:
        out = out.union(q.select("due"))
    return out.agg(F.min("due").alias("due"))
