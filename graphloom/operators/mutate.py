"""Mutations as functions from tables to tables, and the changes between two states.

A request is a DataFrame; ``pos`` orders its items, so that the first of equal ones wins.
Results are new DataFrames: written as a snapshot, they replace the old tables at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.changelog import running_sum
from graphloom.operators.limits import BODY_BYTES, NAME_BYTES
from graphloom.operators.log import apply_log

TRIPLE = ["from_id", "to_id", "relation_type"]
MOVED = ["new_from", "new_to", "new_type"]
#: Places of a request that are numbered in one task.
SPAN = 100_000


def create_entities(entity: DataFrame, new: DataFrame, first_id: int) -> DataFrame:
    """Add ``new`` (pos, name, entity_type): empty names, known names and later repetitions are skipped; ids are first_id + pos."""
    fresh = new.filter("name <> ''").groupBy("name").agg(F.min(F.struct("pos", "entity_type")).alias("f"))
    fresh = fresh.join(entity.select("name"), "name", "left_anti")
    return entity.unionByName(fresh.select((F.lit(first_id) + F.col("f.pos")).cast("long").alias("id"), "name", F.col("f.entity_type").alias("entity_type")))


def upsert_types(entity: DataFrame, changed: DataFrame) -> DataFrame:
    """Entities with the type of ``changed`` (pos, name, entity_type), the last one for each name."""
    last = changed.groupBy("name").agg(F.max_by("entity_type", "pos").alias("new_type"))
    return entity.join(last, "name", "left").select("id", "name", F.coalesce("new_type", "entity_type").alias("entity_type"))


def add_observations(observation: DataFrame, new: DataFrame, only_new: bool = False) -> DataFrame:
    """Append ``new`` (entity_id, pos, body) after the last idx of each entity.

    ``only_new`` skips bodies the entity has and repetitions within the request;
    otherwise nothing is skipped. Rows without a place come first.
    """
    if only_new:
        new = new.groupBy("entity_id", "body").agg(F.min("pos").alias("pos")).join(observation.select("entity_id", "body"), ["entity_id", "body"], "left_anti")
    last = observation.join(new.select("entity_id").distinct(), "entity_id", "left_semi").groupBy("entity_id").agg(F.max("idx").alias("last"))
    # Places of a request that are near each other are numbered together, so an entity with most rows is dealt too.
    placed = running_sum(new, "entity_id", F.lit(1), ["pos"], F.floor(F.col("pos") / SPAN), "place")
    rows = placed.join(last, "entity_id", "left")
    return observation.unionByName(rows.select("entity_id", (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("int").alias("idx"), "body"))


def unknown_owners(entity: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` (entity_id, pos, ...) whose entity doesn't exist: a request with any is refused whole."""
    return new.join(entity.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(new.columns)


def request_observations(observation: DataFrame, entity: DataFrame, new: DataFrame, only_new: bool = False) -> DataFrame:
    """``add_observations`` for entities that exist; a row for another one is an error and nothing is added."""
    first = unknown_owners(entity, new).select("entity_id").first()
    if first:
        raise ValueError(f"no entity has the id {first['entity_id']}")
    return add_observations(observation, new, only_new)


def delete_observations(observation: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove every observation equal to a row of ``gone`` (entity_id, body)."""
    return observation.join(gone.select("entity_id", "body").distinct(), ["entity_id", "body"], "left_anti").select("entity_id", "idx", "body")


def delete_observations_at(observation: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove the observations at the places of ``gone`` (entity_id, idx); unknown places change nothing."""
    return observation.join(gone.select("entity_id", "idx").distinct(), ["entity_id", "idx"], "left_anti").select("entity_id", "idx", "body")


def cascade(ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows that go with the entities ``ids`` (id).

    Those are the entities (id, name), what has one at an end (from_id, to_id), what
    belongs to one (entity_id, or owner_kind and owner_id), and, by the table ``attachment``,
    what belongs to its attachments (attachment_id).
    """
    files = tables["attachment"].join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("attachment_id") if "attachment" in tables else None
    out = {}
    for name, rows in tables.items():
        has = set(rows.columns)
        without = lambda df, column: df.join(ids.select(F.col("id").alias(column)), column, "left_anti")
        if "from_id" in has:
            left = without(without(rows, "from_id"), "to_id")
        elif "entity_id" in has:
            left = without(rows, "entity_id")
        elif "owner_kind" in has:
            left = without(rows.filter("owner_kind = 'entity'"), "owner_id").select(rows.columns).union(rows.filter("NOT owner_kind <=> 'entity'"))
        elif "attachment_id" in has:
            left = rows.join(files, "attachment_id", "left_anti")
        else:
            left = without(rows, "id")
        out[name] = left.select(rows.columns)
    return out


def delete_entities(entity: DataFrame, names: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """``entity`` and the other tables without the named entities and all that goes with them; unknown names are ignored."""
    ids = entity.join(names.select("name").distinct(), "name", "left_semi").select("id")
    return cascade(ids, entity=entity, **tables)


def create_relations(relation: DataFrame, entity: DataFrame, new: DataFrame) -> DataFrame:
    """Add ``new`` triples whose ends exist; known triples and repetitions are skipped."""
    ids = entity.select("id")
    fresh = new.select(*TRIPLE).distinct().join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return relation.select(*TRIPLE).unionByName(fresh.join(relation, TRIPLE, "left_anti").select(*TRIPLE))


def delete_relations(relation: DataFrame, gone: DataFrame) -> DataFrame:
    """``relation``, or a table of what belongs to relations (triple, ...), without the triples of ``gone``."""
    return relation.join(gone.select(*TRIPLE).distinct(), TRIPLE, "left_anti").select(relation.columns)


def tombstones(mirror: DataFrame, gone: DataFrame) -> DataFrame:
    """``mirror`` (triple, revision, deleted) with the live rows of ``gone`` marked deleted at the next revision."""
    marked = mirror.join(gone.select(*TRIPLE).distinct().withColumn("__gone", F.lit(True)), TRIPLE, "left")
    falls = F.col("__gone").isNotNull() & ~F.col("deleted")
    return marked.select(*TRIPLE, (F.col("revision") + falls.cast("int")).alias("revision"), (F.col("deleted") | falls).alias("deleted"))


def _moves(relation: DataFrame, chosen: DataFrame, new: dict) -> tuple[DataFrame, DataFrame]:
    """(moves, refused) of the live ``chosen`` triples to ``new`` (new_from, new_to, new_type).

    Refused are moves onto a live triple and, of several onto one new triple, all but the
    first in order of ``pos``, if ``chosen`` has it, and of the triples.
    """
    order = (["pos"] if "pos" in chosen.columns else []) + TRIPLE
    asked = chosen.groupBy(*TRIPLE).agg(F.min("pos").alias("pos")) if "pos" in chosen.columns else chosen.select(*TRIPLE).distinct()
    asked = asked.join(relation.select(*TRIPLE), TRIPLE, "left_semi").withColumns(new)
    live = relation.select(*[F.col(c).alias(n) for c, n in zip(TRIPLE, MOVED, strict=True)]).distinct().withColumn("__live", F.lit(True))
    first = asked.groupBy(*MOVED).agg(F.min(F.struct(*order)).alias("__first"))
    judged = asked.join(live, MOVED, "left").join(first, MOVED)
    done = F.col("__live").isNull() & (F.struct(*order) == F.col("__first"))
    return judged.filter(done).select(*TRIPLE, *MOVED), judged.filter(~done).select(*TRIPLE)


def reverse_moves(relation: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves, refused) that turn ``chosen`` round; self loops and turns onto a live triple are refused."""
    return _moves(relation, chosen, {"new_from": F.col("to_id"), "new_to": F.col("from_id"), "new_type": F.col("relation_type")})


def retype_moves(relation: DataFrame, chosen: DataFrame, new_type: str) -> tuple[DataFrame, DataFrame]:
    """(moves, refused) that give ``chosen`` a new type; the same type is no change, a live target is refused."""
    other = chosen.filter(F.col("relation_type") != new_type)
    return _moves(relation, other, {"new_from": F.col("from_id"), "new_to": F.col("to_id"), "new_type": F.lit(new_type)})


def apply_moves(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Relations, their observations or their attributes (triple, ...) with moved triples under their new names.

    ``moves`` are those that ``reverse_moves`` and ``retype_moves`` let through, so no two meet.
    """
    joined = rows.join(moves, TRIPLE, "left")
    return joined.select(*[F.coalesce(n, c).alias(c) for c, n in zip(TRIPLE, MOVED, strict=True)], *[c for c in rows.columns if c not in TRIPLE]).select(rows.columns)


def reverse_relations(relation: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with ``chosen`` turned round, refused)."""
    moves, refused = reverse_moves(relation, chosen)
    return apply_moves(relation.select(*TRIPLE), moves), refused


def change_relation_type(relation: DataFrame, chosen: DataFrame, new_type: str) -> tuple[DataFrame, DataFrame]:
    """(relations with ``chosen`` of the new type, refused)."""
    moves, refused = retype_moves(relation, chosen, new_type)
    return apply_moves(relation.select(*TRIPLE), moves), refused


def of_live_relations(rows: DataFrame, relation: DataFrame) -> DataFrame:
    """What belongs to relations (triple, ...) that still exist."""
    return rows.join(relation.select(*TRIPLE), TRIPLE, "left_semi").select(rows.columns)


def merge_entities(entity: DataFrame, relation: DataFrame, observation: DataFrame, attribute: DataFrame, source: int, target: int, attachment: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables with ``source`` merged into ``target``.

    Unseen bodies are appended, attributes of the source win, relations are re-pointed and
    made distinct (those between both become self loops); bodies and attributes of re-pointed
    relations are not carried (``of_live_relations``). Equal ids change nothing; a source
    that owns attachments is refused.
    """
    if source == target:
        return entity, relation, observation, attribute
    if attachment is not None and not attachment.filter(F.col("entity_id") == source).isEmpty():
        raise ValueError("an entity with attachments can't be merged into another")
    move = lambda c: F.when(F.col(c) == source, F.lit(target).cast("long")).otherwise(F.col(c))
    # Only pairs that the move touches can become equal.
    touched = (F.col("from_id").isin(source, target)) | (F.col("to_id").isin(source, target))
    moved = relation.filter(touched).select(move("from_id").alias("from_id"), move("to_id").alias("to_id"), "relation_type").distinct()
    carried = observation.filter(F.col("entity_id") == source).select(F.lit(target).cast("long").alias("entity_id"), F.col("idx").alias("pos"), "body")
    bodies = add_observations(observation.filter(F.col("entity_id") != source), carried, only_new=True)
    mine = (F.col("owner_kind") == "entity") & F.col("owner_id").isin(source, target)
    own = attribute.filter(mine).groupBy("owner_kind", "key").agg(F.max_by("value", (F.col("owner_id") == source).cast("int")).alias("value"))
    attributes = attribute.filter(~mine).unionByName(own.select("owner_kind", F.lit(target).cast("long").alias("owner_id"), "key", "value"))
    return entity.filter(F.col("id") != source), relation.filter(~touched).select(*TRIPLE).union(moved), bodies, attributes


def merge_origins(before: DataFrame, after: DataFrame, entity: DataFrame, source: int, target: int) -> DataFrame:
    """(entity_id, idx, origin): the name of the source for each observation that a merge carried over to the target."""
    last = before.filter(F.col("entity_id") == target).agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last"))
    name = entity.filter(F.col("id") == source).select(F.col("name").alias("origin"))
    return after.filter(F.col("entity_id") == target).crossJoin(last).filter("idx > last").crossJoin(name).select("entity_id", "idx", "origin")  # one row each


def rename_outcome(entity: DataFrame, names: DataFrame) -> DataFrame:
    """(pos, name, new_name, outcome) of each row of ``names`` (pos, name, new_name), done one after the other by ``pos``.

    renamed; unknown: nothing has that name then; taken: the new name is held then; empty: the
    new name is. Names stay unique.
    """
    log = names.select("pos", F.lit("rename").alias("op"), "name", F.coalesce("new_name", F.lit("")).alias("other"), F.lit(None).cast("string").alias("kind"))
    none = entity.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("").alias("relation_type")).limit(0)
    said = apply_log(entity, none, log, 0)["outcome"]
    said = said.select(F.col("pos").alias("__pos"), F.when(F.col("outcome") == "done", "renamed").when(F.col("outcome") == "invalid", "unknown").otherwise(F.col("outcome")).alias("outcome"))
    return names.join(said, F.col("pos") == F.col("__pos")).select("pos", "name", "new_name", "outcome")


def rename_entities(entity: DataFrame, names: DataFrame) -> DataFrame:
    """Entities renamed by the rows of ``names`` (pos, name, new_name) that ``rename_outcome`` allows."""
    log = names.select("pos", F.lit("rename").alias("op"), "name", F.coalesce("new_name", F.lit("")).alias("other"), F.lit(None).cast("string").alias("kind"))
    none = entity.select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("").alias("relation_type")).limit(0)
    return apply_log(entity, none, log, 0)["entity"]


def set_attributes(attribute: DataFrame, new: DataFrame) -> DataFrame:
    """Attributes with those of ``new`` (owner_kind, owner_id, key, value, pos) set, the last of each key."""
    key = ["owner_kind", "owner_id", "key"]
    last = new.groupBy(*key).agg(F.max_by("value", "pos").alias("value"))
    return attribute.join(last, key, "left_anti").select(*key, "value").unionByName(last)


def changes(before: DataFrame, after: DataFrame, key: str, content: list[str]) -> DataFrame:
    """(key, operation): create, update or delete of each key whose ``content`` differs between two states."""
    row = lambda df, name: df.select(key, F.struct(*content).alias(name))
    both = row(before, "old").join(row(after, "new"), key, "full")
    operation = F.when(F.col("old").isNull(), "create").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return both.select(key, operation.alias("operation")).filter("operation IS NOT NULL")


def relation_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, from_id, to_id, relation_type, operation): each relation that came (create) or went (delete), told to both its ends."""
    gone = before.select(*TRIPLE).join(after.select(*TRIPLE), TRIPLE, "left_anti").withColumn("operation", F.lit("delete"))
    come = after.select(*TRIPLE).join(before.select(*TRIPLE), TRIPLE, "left_anti").withColumn("operation", F.lit("create"))
    return gone.union(come).distinct().select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("id"), *TRIPLE, "operation")


def counter_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, delta): signed change of row counts by ``key``, zeros left out."""
    rows = before.select(key, F.lit(-1).alias("d")).union(after.select(key, F.lit(1).alias("d")))
    return rows.groupBy(key).agg(F.sum("d").alias("delta")).filter("delta <> 0")


def edit_observations(observation: DataFrame, edits: DataFrame) -> DataFrame:
    """Observations with the last body of ``edits`` (entity_id, idx, pos, new_body) where one is given; unknown places change nothing."""
    given = edits.groupBy("entity_id", "idx").agg(F.max_by("new_body", "pos").alias("new_body"))
    return observation.join(given, ["entity_id", "idx"], "left").select("entity_id", "idx", F.coalesce("new_body", "body").alias("body"))


def add_relation_observations(relation_observation: DataFrame, relation: DataFrame, new: DataFrame) -> DataFrame:
    """Append ``new`` (triple, pos, body) after the last idx of each relation; triples that don't exist are skipped."""
    new = new.join(relation.select(*TRIPLE).distinct(), TRIPLE, "left_semi")
    last = relation_observation.join(new.select(*TRIPLE).distinct(), TRIPLE, "left_semi").groupBy(*TRIPLE).agg(F.max("idx").alias("last"))
    place = F.row_number().over(Window.partitionBy(*TRIPLE).orderBy("pos"))
    rows = new.withColumn("place", place).join(last, TRIPLE, "left")
    return relation_observation.unionByName(rows.select(*TRIPLE, (F.coalesce("last", F.lit(-1)) + F.col("place")).cast("int").alias("idx"), "body"))


def delete_relation_observations(relation_observation: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove every body equal to a row of ``gone`` (triple, body)."""
    return relation_observation.join(gone.select(*TRIPLE, "body").distinct(), [*TRIPLE, "body"], "left_anti").select(*TRIPLE, "idx", "body")


def delete_attributes(attribute: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove the attributes named by ``gone`` (owner_kind, owner_id, key)."""
    key = ["owner_kind", "owner_id", "key"]
    return attribute.join(gone.select(*key).distinct(), key, "left_anti").select(*key, "value")


def defined_names(entity: DataFrame, relation: DataFrame, names: DataFrame, relation_type: str = "defines") -> DataFrame:
    """(name): the named entities and the targets of their ``relation_type`` relations: what a purge deletes."""
    roots = entity.join(names.select("name").distinct(), "name", "left_semi")
    targets = relation.filter(F.col("relation_type") == relation_type).join(roots.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return roots.select("name").union(entity.join(targets.select(F.col("to_id").alias("id")).distinct(), "id", "left_semi").select("name")).distinct()


def set_descriptions(described: DataFrame, new: DataFrame) -> DataFrame:
    """Type descriptions (kind, name, description) with the last ones of ``new`` (pos, kind, name, description) set; an empty one clears."""
    last = new.groupBy("kind", "name").agg(F.max_by("description", "pos").alias("description"))
    rows = described.join(last, ["kind", "name"], "left_anti").select("kind", "name", "description")
    return rows.unionByName(last.filter("description <> ''"))


def request_faults(entities: DataFrame, observations: DataFrame) -> DataFrame:
    """(pos, fault) of a request's entities (pos, name) and observations (pos, body): empty or too long names, missing or too long bodies."""
    name = F.when(F.coalesce("name", F.lit("")) == "", "empty name").when(F.octet_length("name") > NAME_BYTES, "long name")
    body = F.when(F.col("body").isNull(), "no body").when(F.octet_length("body") > BODY_BYTES, "long body")
    return entities.select("pos", name.alias("fault")).union(observations.select("pos", body.alias("fault"))).filter("fault IS NOT NULL")
