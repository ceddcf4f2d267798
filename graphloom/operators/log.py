"""An ordered log of mixed mutations as set operations: later requests see earlier ones.

The log is cut into stretches of consecutive requests. Whether a request is done depends on
which of its names are taken, so each stretch is applied in a task from a guess of the names taken before it; what
it leaves of its names is carried to later stretches, and stretches whose names were guessed wrong are
applied again. The first stretch is right after one round, every round makes one more right at
least, and mostly many, since creations and deletions leave a known state whatever was there
before. What no longer changes is the outcome of applying the log one by one. Entities
are names of a stretch's start until then, and followed to their ids at the end, twice as far in each round.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import discard, durable

#: Requests of a stretch, which one task applies; about so many, stretches are cut by samples.
STRETCH = 65_536
#: Stands for no entity; no id is this.
NONE = -(1 << 62)
#: Fixed names of the operations.
OPERATIONS = ("create", "delete", "rename", "annotate", "relate", "unrelate")
#: So many relation types of a log at most are named in the scan of relations.
NAMED = 1000


def last_before(rows: DataFrame, key: list[str], stretch: str, pos: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the last ``value`` of earlier rows (smaller ``pos``) of the same key.

    Neither a key nor a value is null. A key is dealt by ``stretch``, which doesn't fall along ``pos``.
    """
    last = rows.groupBy(*key, stretch).agg(F.max_by(value, pos).alias("__last"))
    last = last.select(*key, stretch, F.lag("__last").over(Window.partitionBy(*key).orderBy(stretch)).alias("__carried"))
    own = F.lag(value).over(Window.partitionBy(*key, stretch).orderBy(pos))
    return rows.withColumn("__own", own).join(last, [*key, stretch]).withColumn("before", F.coalesce("__own", "__carried")).drop("__own", "__carried")


def _fold(requests: pa.Table, state: dict, first_id: int) -> tuple[list, list, list, set]:
    """What the two names of each request stand for before it, whether it is done, and the names it leaves known; ``state`` is the one after them."""
    a, b, done, left = [], [], [], set()
    for pos, op, name, other in zip(*(requests[c].to_pylist() for c in ("pos", "op", "name", "other")), strict=True):
        x, y, ok = state.get(name, NONE), NONE if other is None else state.get(other, NONE), False
        if op == "create" and name:
            ok = x == NONE
            state[name] = first_id + pos if ok else x
            left.add(name)
        elif op == "delete":
            ok = x != NONE
            state[name] = NONE
            left.add(name)
        elif op == "rename" and x != NONE and y == NONE and other:
            ok = True
            state[name], state[other] = NONE, x
            left |= {name, other}
        elif op == "annotate":
            ok = x != NONE
        a.append(x)
        b.append(y)
        done.append(ok)
    return a, b, done, left


def _left(requests: DataFrame, runs: DataFrame, first_id: int) -> DataFrame:
    """``runs`` (stretch, n, start, taken) with what the stretch leaves of the name: an id, ``NONE``, the entity that ``ref`` had at its start, or nothing of these."""

    def apply(part: pa.Table, names: pa.Table) -> pa.Table:
        n = names["n"].to_pylist()
        state = {x: x if taken else NONE for x, taken in zip(n, names["taken"].to_pylist(), strict=True)}
        left = _fold(part.sort_by("pos"), state, first_id)[3]
        after = [state[x] if x in left else None for x in n]
        ids = pa.array([x if isinstance(x, int) else None for x in after], pa.int64())
        return names.append_column("id", ids).append_column("ref", pa.array([x if isinstance(x, str) else None for x in after], pa.string()))

    runs = runs.select("stretch", "n", "start", "taken")
    return requests.groupBy("stretch").cogroup(runs.groupBy("stretch")).applyInArrow(apply, "stretch int, n string, start long, taken boolean, id long, ref string")


def _carried(runs: DataFrame, value: Column) -> DataFrame:
    """``runs`` with ``carried``: ``value`` of the last earlier stretch that leaves the name known."""
    order = Window.partitionBy("n").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("carried", F.last(F.when(F.col("id").isNotNull() | F.col("ref").isNotNull(), value), True).over(order))


def _settled(ops: DataFrame, names: DataFrame, first_id: int) -> DataFrame:
    """(stretch, n, id, ref): what each stretch of the requests ``ops`` leaves of its ``names`` (stretch, n, start)."""
    last, guess = None, _left(ops, names.withColumn("taken", F.col("start") != NONE), first_id)
    while True:
        # As many rows of a name as there are stretches at most.
        runs = _carried(guess, F.coalesce(F.col("id") != NONE, F.lit(True)))
        runs = durable(runs.withColumn("now", F.coalesce("carried", F.col("start") != NONE)).drop("carried"), "runs")
        discard(last)
        wrong = runs.filter(F.col("now") != F.col("taken")).select("stretch").distinct()
        if wrong.isEmpty():
            return runs.select("stretch", "n", "id", "ref")
        again = _left(ops.join(wrong, "stretch", "left_semi"), runs.join(wrong, "stretch", "left_semi").withColumn("taken", F.col("now")), first_id)
        guess = runs.join(wrong, "stretch", "left_anti").drop("now").unionByName(again)
        last = runs


def _starts(names: DataFrame, settled: DataFrame) -> DataFrame:
    """(stretch, n, id): what each of ``names`` (stretch, n, start) stands for when its stretch starts."""
    rows = _carried(names.join(settled, ["stretch", "n"], "left"), F.struct("stretch", "id", "ref"))
    # Who hasn't an id yet is who had the name ``ref`` when the stretch ``at`` started.
    known = F.coalesce("carried.id", F.when(F.col("carried.ref").isNull(), F.col("start")))
    rows = durable(rows.select("stretch", "n", known.alias("id"), F.col("carried.stretch").alias("at"), F.col("carried.ref").alias("ref")), "starts")
    while not rows.filter("id IS NULL").isEmpty():
        earlier = rows.select(F.col("stretch").alias("at"), F.col("n").alias("ref"), "id", F.col("at").alias("__at"), F.col("ref").alias("__ref"))
        moved = rows.filter("id IS NULL").select("stretch", "n", "at", "ref").join(earlier, ["at", "ref"])
        further = durable(rows.filter("id IS NOT NULL").union(moved.select("stretch", "n", "id", F.col("__at").alias("at"), F.col("__ref").alias("ref"))), "starts")
        discard(rows)
        rows = further
    return rows.select("stretch", "n", "id")


def _named(requests: DataFrame, starts: DataFrame, first_id: int) -> DataFrame:
    """``requests`` with ``a`` and ``b``: the ids that their two names have before them (``NONE`` if nothing has one), and whether a request on names is ``done``."""

    def apply(part: pa.Table, names: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        a, b, done, _ = _fold(part, dict(zip(names["n"].to_pylist(), names["id"].to_pylist(), strict=True)), first_id)
        return part.append_column("a", pa.array(a, pa.int64())).append_column("b", pa.array(b, pa.int64())).append_column("done", pa.array(done, pa.bool_()))

    kept = requests.select("pos", "op", "name", "other", "kind", "stretch")
    return kept.groupBy("stretch").cogroup(starts.groupBy("stretch")).applyInArrow(apply, "pos long, op string, name string, other string, kind string, stretch int, a long, b long, done boolean")


def apply_log(entity: DataFrame, relation: DataFrame, log: DataFrame, first_id: int) -> dict[str, DataFrame]:
    """The tables after ``log``, and what became of it.

    ``log`` (pos, op, name, other, kind): create name of type kind; delete name, and its
    relations with it; rename name to other; annotate name, which is quiet; relate or unrelate name to other by kind. ``pos``
    orders the requests and is theirs alone. Requests are whole: one that fails changes nothing.

    outcome: (pos, outcome) done; known (of a creation or relation), unknown (a name),
    absent (of a relation), taken or empty (the new name), or invalid (no such operation, or no
    position, or a null that is needed).
    entity, relation: (id, name, entity_type), (from_id, to_id, relation_type). A created
    entity gets the id ``first_id`` + pos; relations keep to entities, whatever they are called.
    event: (pos, entity_id, operation, quiet) of each request that is done; the
    relations that go with a deleted entity make none. counter: (kind, type, change) of live entities and relations by type.
    """
    op, triple = F.col("op"), ["from_id", "to_id", "relation_type"]
    on_links, two = op.isin("relate", "unrelate"), op.isin("rename", "relate", "unrelate")
    bad = F.col("pos").isNull() | ~F.coalesce(op.isin(*OPERATIONS), F.lit(False)) | F.col("name").isNull() | (two & F.col("other").isNull()) | (op.isin("create", "relate", "unrelate") & F.col("kind").isNull())
    log = durable(log.select(F.col("pos").cast("long"), "op", "name", F.when(two, F.col("other")).alias("other"), "kind").withColumn("bad", F.coalesce(bad, F.lit(True))), "log")
    good = log.filter("NOT bad").drop("bad")
    stretches = max(1, -(-good.count() // STRETCH))
    requests = durable(good.repartitionByRange(stretches, "pos").withColumn("stretch", F.spark_partition_id()), "requests")
    changes = op.isin("create", "delete", "rename")
    names = requests.select("stretch", changes.alias("changes"), F.explode(F.array("name", "other")).alias("n")).filter("n IS NOT NULL").groupBy("stretch", "n").agg(F.max("changes").alias("changes"))
    start = entity.groupBy(F.col("name").alias("n")).agg(F.max("id").cast("long").alias("start"))
    names = durable(names.join(start, "n", "left").select("stretch", "n", "changes", F.coalesce("start", F.lit(NONE)).alias("start")), "names")
    settled = _settled(requests.filter(changes).select("pos", "op", "name", "other", "stretch"), names.filter("changes").select("stretch", "n", "start"), first_id)
    named = durable(_named(requests, _starts(names.select("stretch", "n", "start"), settled), first_id), "named")
    eid = F.when(op == "create", F.col("pos") + first_id).otherwise(F.col("a")).cast("long")

    ends = on_links & (F.col("a") != NONE) & (F.col("b") != NONE)
    links = named.filter(ends).select("pos", "stretch", F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.col("kind").alias("relation_type"), (op == "relate").alias("leaves"))
    # Of relations only those of types in the log can be meant; few types are a predicate of the scan.
    kinds = [r["kind"] for r in requests.filter(on_links).select("kind").distinct().limit(NAMED + 1).collect()]
    meant = F.coalesce(F.col("relation_type").isin(kinds), F.lit(False)) if len(kinds) <= NAMED else F.lit(True)
    relation = relation.select(*triple)
    stood, others = relation.filter(meant).distinct(), relation.filter(~meant)
    links = last_before(links, triple, "stretch", "pos", "leaves").join(stood.withColumn("start", F.lit(True)), triple, "left")
    links = durable(links.select("pos", *triple, "leaves", F.coalesce("before", "start", F.lit(False)).alias("live")), "links")

    on_names = F.when(F.col("done"), "done").when(op == "create", F.when(F.col("name") == "", "empty").otherwise("known")).when(on_links | (F.col("a") == NONE), "unknown").when(F.col("other") == "", "empty").otherwise("taken")
    of_links = F.when(F.col("live") == F.col("leaves"), F.when(F.col("live"), "known").otherwise("absent")).otherwise("done")
    outcome = named.filter(~ends).select("pos", on_names.alias("outcome")).union(links.select("pos", of_links)).union(log.filter("bad").select("pos", F.lit("invalid")))

    made = named.filter("done")
    new = made.filter("op = 'create'").select(eid.alias("id"), "name", F.col("kind").alias("entity_type"))
    gone = durable(made.filter("op = 'delete'").select(F.col("a").alias("id")), "gone")
    called = made.filter("op = 'rename'").groupBy(F.col("a").alias("id")).agg(F.max_by("other", "pos").alias("last"))
    ever = entity.select("id", "name", "entity_type").unionByName(new)
    after = ever.join(gone, "id", "left_anti").join(called, "id", "left").select("id", F.coalesce("last", "name").alias("name"), "entity_type")

    def standing(rows: DataFrame) -> DataFrame:
        for end in ("from_id", "to_id"):
            rows = rows.join(gone.withColumnRenamed("id", end), end, "left_anti")
        return rows.select(*triple)

    state = links.groupBy(*triple).agg(F.max_by("leaves", "pos").alias("leaves"))
    linked = standing(stood.join(state.select(*triple), triple, "left_anti").union(state.filter("leaves").select(*triple)))
    kept = standing(others).distinct().union(linked)
    # Of other relations those count that go with an end; the ids of ``gone`` are each there once.
    lost = others
    for end in ("from_id", "to_id"):
        lost = lost.join(gone.select(F.col("id").alias(end), F.lit(True).alias(f"__{end}")), end, "left")
    lost = lost.filter("__from_id OR __to_id").select(*triple).distinct()

    operation = F.when(op == "create", "create").when(op == "delete", "delete").otherwise("update")
    events = made.select("pos", eid.alias("entity_id"), operation.alias("operation"), (op == "annotate").cast("int").alias("quiet"))
    changed = links.filter(F.col("live") != F.col("leaves")).select("pos", F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("entity_id"), F.lit("update").alias("operation"), F.lit(0).alias("quiet"))
    tally = lambda df, kind, by, n: df.groupBy(F.col(by).alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", (F.col("n") * n).alias("n"))
    counts = [("entity", "entity_type", new, 1), ("entity", "entity_type", ever.join(gone, "id", "left_semi"), -1), ("relation", "relation_type", linked, 1), ("relation", "relation_type", stood, -1), ("relation", "relation_type", lost, -1)]
    total = None
    for kind, by, rows, n in counts:
        total = tally(rows, kind, by, n) if total is None else total.union(tally(rows, kind, by, n))
    counter = total.groupBy("kind", "type").agg(F.sum("n").alias("change")).filter("change <> 0")
    return {"outcome": outcome, "entity": after, "relation": kept, "event": events.union(changed), "counter": counter}
