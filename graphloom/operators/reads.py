"""Lookups, paging, relation search, export and counts over graph tables.

The few keys of a request and type filters are predicates that reach the scan; more keys
are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.limits import ITEMS

TRIPLE = ["from_id", "to_id", "relation_type"]


def names_frame(spark, names: Sequence[str]) -> DataFrame:
    """(pos, name): a request's names with their places."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, name string")


def few(df: DataFrame, column: str, most: int | None = None) -> list | None:
    """The distinct values of ``column`` if there are at most ``most`` (the items of a request), else None."""
    most = ITEMS if most is None else most
    rows = df.select(column).distinct().limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


def among(table: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose ``column`` is a value of ``keys``.

    The keys of a request go into the scan as a predicate; more of them are a semi join.
    """
    values = few(keys, key)
    if values is not None:
        return table.filter(F.col(column).isin([v for v in values if v is not None]))
    return table.join(keys.select(F.col(key).alias(column)).distinct(), column, "left_semi").select(table.columns)


def lookup(entity: DataFrame, names: DataFrame) -> DataFrame:
    """Entities with exactly these names (case-sensitive); unknown names are ignored."""
    return among(entity, "name", names, "name")


def exists(entity: DataFrame, names: DataFrame) -> DataFrame:
    """(pos, name, exists) for each requested place."""
    known = lookup(entity, names).select("name", F.lit(True).alias("known")).distinct()
    return names.join(known, "name", "left").select("pos", "name", F.coalesce("known", F.lit(False)).alias("exists"))


def batch_get(entity: DataFrame, observation: DataFrame, names: DataFrame) -> DataFrame:
    """(pos, name, id, entity_type, n_observations): one row a place, null where unknown, repeats kept."""
    found = lookup(entity, names)
    sizes = among(observation, "entity_id", found, "id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    known = found.join(sizes, F.col("id") == F.col("entity_id"), "left").select("name", "id", "entity_type", F.coalesce("n", F.lit(0)).alias("n_observations"))
    return names.join(known, "name", "left").select("pos", "name", "id", "entity_type", "n_observations")


def page(entity: DataFrame, offset: int, limit: int, entity_type: str | None = None) -> DataFrame:
    """Entities in id order, cut after the optional type filter."""
    if entity_type:
        entity = entity.filter(F.col("entity_type") == entity_type)
    return entity.orderBy("id").offset(offset).limit(limit)


def page_with_sizes(entity: DataFrame, observation: DataFrame, offset: int, limit: int, entity_type: str | None = None) -> DataFrame:
    """A page (id, name, entity_type, n_observations); only its own observations are counted."""
    rows = page(entity, offset, limit, entity_type)
    sizes = among(observation, "entity_id", rows, "id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, F.col("id") == F.col("entity_id"), "left").select("id", "name", "entity_type", F.coalesce("n", F.lit(0)).alias("n_observations"))


def page_meta(entity: DataFrame, relation: DataFrame, offset: int, limit: int, entity_type: str | None = None) -> DataFrame:
    """(legend, entities_total, relations_total, offset, limit, returned, has_more) of a page; ``legend`` maps types to counts."""
    types = entity.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    legend = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("legend"), F.coalesce(F.sum("n"), F.lit(0)).alias("entities_total"))
    rows = legend.crossJoin(relation.agg(F.count(F.lit(1)).alias("relations_total")))  # one row each
    scope = F.coalesce(F.element_at("legend", F.lit(entity_type)), F.lit(0)) if entity_type else F.col("entities_total")
    returned = F.greatest(F.least(scope - offset, F.lit(limit)), F.lit(0)).cast("long")
    return rows.select("legend", "entities_total", "relations_total", F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), returned.alias("returned"), (offset + returned < scope).alias("has_more"))


def with_more(rows: DataFrame, limit: int, *order) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows, and whether there are more, by asking for one more."""
    cut = rows.orderBy(*order).limit(limit + 1)
    return cut.orderBy(*order).limit(limit), cut.count() > limit


def inside(relation: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations with both ends among ``ids`` (id)."""
    return among(among(relation, "from_id", ids, "id"), "to_id", ids, "id").select(*TRIPLE)


def touching(relation: DataFrame, ids: DataFrame, relation_in: DataFrame | None = None) -> DataFrame:
    """Relations with either end among ``ids`` (id), each once; ``relation_in`` are the same sorted by target."""
    out, back = among(relation, "from_id", ids, "id"), among(relation if relation_in is None else relation_in, "to_id", ids, "id")
    return out.select(*TRIPLE).union(back.select(*TRIPLE)).distinct()


def ordered_bodies(observation: DataFrame) -> DataFrame:
    """(entity_id, bodies): observation bodies of each entity in order of idx."""
    return observation.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("o")).select("entity_id", F.transform("o", lambda x: x["body"]).alias("bodies"))


def attribute_map(attribute: DataFrame, owner_kind: str = "entity") -> DataFrame:
    """(owner_id, attributes): key to value, keys in order."""
    rows = attribute.filter(F.col("owner_kind") == owner_kind).groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("kv"))
    return rows.select("owner_id", F.map_from_entries("kv").alias("attributes"))


def describe(relation: DataFrame, ids: DataFrame, relation_in: DataFrame | None = None) -> DataFrame:
    """(id, neighbor_id, out_degree, in_degree) for each distinct neighbour of ``ids``; degrees are recounted."""
    out = among(relation, "from_id", ids, "id").select(F.col("from_id").alias("id"), F.col("to_id").alias("neighbor_id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    back = among(relation if relation_in is None else relation_in, "to_id", ids, "id").select(F.col("to_id").alias("id"), F.col("from_id").alias("neighbor_id"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.union(back).groupBy("id", "neighbor_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def search_relations(relation: DataFrame, entity: DataFrame, source: str | None = None, target: str | None = None, relation_type: str | None = None, limit: int = 20, relation_in: DataFrame | None = None) -> DataFrame:
    """Relations by structural filters in order of (from_id, to_id, type), cut to ``limit``.

    An empty or missing filter is none; a filter that names nothing known gives no row.
    ``relation_in``, the same relations sorted by target, serves a target without a source.
    """
    if target and not source and relation_in is not None:
        relation = relation_in
    if relation_type:
        relation = relation.filter(F.col("relation_type") == relation_type)
    for name, column in ((source, "from_id"), (target, "to_id")):
        if name:
            relation = among(relation, column, entity.filter(F.col("name") == name), "id")
    return relation.select(*TRIPLE).orderBy(*TRIPLE).limit(limit)


def one_relation(relation: DataFrame, entity: DataFrame, source: str, target: str, relation_type: str) -> DataFrame:
    """The relation of these names and type, as (found, from_id, to_id, relation_type): one row, with found false and nulls if there is none."""
    hit = search_relations(relation, entity, source, target, relation_type, 1)
    asked = relation.sparkSession.range(1).select(F.lit(1).alias("one"))
    return asked.join(hit.withColumn("one", F.lit(1)), "one", "left").select(F.col("from_id").isNotNull().alias("found"), *TRIPLE)


def types_known(entity: DataFrame, relation: DataFrame, asked: DataFrame) -> DataFrame:
    """(kind, name, exists) for each asked (kind, name), kind entity or relation; nothing is inserted."""
    known = type_counts(entity, relation).select("kind", "name", F.lit(True).alias("known"))
    return asked.select("kind", "name").distinct().join(known, ["kind", "name"], "left").select("kind", "name", F.coalesce("known", F.lit(False)).alias("exists"))


def with_names(relation: DataFrame, entity: DataFrame) -> DataFrame:
    """Relations with the names of both ends: (from_name, to_name, relation_type)."""
    a, b = entity.select(F.col("id").alias("from_id"), F.col("name").alias("from_name")), entity.select(F.col("id").alias("to_id"), F.col("name").alias("to_name"))
    return relation.join(a, "from_id").join(b, "to_id").select("from_name", "to_name", "relation_type")


def relation_details(relation: DataFrame, relation_observation: DataFrame, relation_attribute: DataFrame | None = None) -> DataFrame:
    """Relations with their ordered bodies, and attributes if given; without any they keep an empty array or a null map."""
    bodies = relation_observation.groupBy(*TRIPLE).agg(F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("o"))
    rows = relation.join(bodies, TRIPLE, "left").select(*TRIPLE, F.coalesce(F.transform("o", lambda x: x["body"]), F.array().cast("array<string>")).alias("bodies"))
    if relation_attribute is None:
        return rows
    pairs = relation_attribute.groupBy(*TRIPLE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("attributes"))
    return rows.join(pairs, TRIPLE, "left")


def export_relations(relation: DataFrame, entity: DataFrame, relation_observation: DataFrame, relation_attribute: DataFrame, limit: int | None = None) -> DataFrame:
    """(from_id, to_id, relation_type, payload): relations as JSON with names, bodies and attributes.

    Their cap is their own, and is taken before relations with a missing end are left out.
    """
    if limit is not None:
        relation = relation.orderBy(*TRIPLE).limit(limit)
    names = lambda c: entity.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(f"{c}_name"))
    rows = relation_details(relation.select(*TRIPLE), relation_observation, relation_attribute).join(names("from"), "from_id").join(names("to"), "to_id")
    shape = F.struct(F.col("from_name").alias("from"), F.col("to_name").alias("to"), F.col("relation_type").alias("relationType"), F.col("bodies").alias("observations"), "attributes")
    return rows.select(*TRIPLE, F.to_json(shape).alias("payload"))


def export_entities(entity: DataFrame, observation: DataFrame, attribute: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, payload): each entity with its observations and attributes as JSON; attributes are left out if there are none."""
    if limit is not None:
        entity = entity.orderBy("id").limit(limit)
    rows = entity.join(ordered_bodies(observation), F.col("id") == F.col("entity_id"), "left").join(attribute_map(attribute), F.col("id") == F.col("owner_id"), "left")
    shape = F.struct(F.col("name"), F.col("entity_type").alias("entityType"), F.coalesce("bodies", F.array().cast("array<string>")).alias("observations"), F.col("attributes"))
    return rows.select("id", F.to_json(shape).alias("payload"))


def observation_value(observation: DataFrame, key: str) -> DataFrame:
    """(entity_id, value): text after ``key: `` of the first such observation in order of idx."""
    mark = f"{key}: "
    hits = observation.filter(F.col("body").startswith(mark)).select("entity_id", "idx", F.substring("body", len(mark) + 1, 1 << 30).alias("value"))
    return hits.groupBy("entity_id").agg(F.min_by("value", "idx").alias("value"))


def type_counts(entity: DataFrame, relation: DataFrame) -> DataFrame:
    """(kind, name, n) of entity types and relation types."""
    e = entity.groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "name", "n")
    r = relation.groupBy(F.col("relation_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("kind"), "name", "n")
    return e.union(r)


def type_catalog(counts: DataFrame, described: DataFrame) -> DataFrame:
    """(kind, name, n, description): types in use or described."""
    rows = counts.join(described, ["kind", "name"], "full")
    return rows.select("kind", "name", F.coalesce("n", F.lit(0)).alias("n"), "description").filter((F.col("n") > 0) | F.col("description").isNotNull())


def graph_stats(entity: DataFrame, relation: DataFrame, observation: DataFrame) -> DataFrame:
    """(key, n): totals of entities, relations and observations."""
    one = lambda df, key: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(key).alias("key"), "n")
    return one(entity, "entities").union(one(relation, "relations")).union(one(observation, "observations"))


def degrees(relation: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree): a self loop counts once each way, twice in all."""
    ends = relation.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(relation.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def type_signatures(relation: DataFrame, entity: DataFrame) -> DataFrame:
    """(relation_type, from_type, to_type): distinct shapes of relation types."""
    # The shape of an id needs its type only; pairs of types are few, so aggregation starts before the shuffle.
    a, b = entity.select(F.col("id").alias("from_id"), F.col("entity_type").alias("from_type")), entity.select(F.col("id").alias("to_id"), F.col("entity_type").alias("to_type"))
    return relation.join(a, "from_id").join(b, "to_id").select("relation_type", "from_type", "to_type").distinct()


def joined(values: Column, mark: str = "|") -> Column:
    return F.array_join(values, mark)
