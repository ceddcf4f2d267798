"""Bounded traversal as level-synchronous joins.

A level is one join of the frontier with the edges and one anti join with what has been
reached; each level is written to the shared folder, so plans stay small and a lost
executor costs one level. Only the question whether a level is empty, the nodes of small
frontiers and the hops of one path come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.limits import ITEMS, clamp
from graphloom.operators.reads import TRIPLE, among, few
from graphloom.sources.shared import durable


def hops(relation: DataFrame, direction: str = "BOTH", relation_type: str | None = None) -> DataFrame:
    """(src, dst, from_id, to_id, relation_type): edges as they are walked.

    OUTGOING follows relations, INCOMING goes against them, anything else both ways.
    """
    if relation_type:
        relation = relation.filter(F.col("relation_type") == relation_type)
    out = relation.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "from_id", "to_id", "relation_type")
    back = relation.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "from_id", "to_id", "relation_type")
    return out if direction == "OUTGOING" else back if direction == "INCOMING" else out.union(back)


#: Levels after which those reached so far are written as one table.
COMPACT = 16


def reach(relation: DataFrame, seeds: DataFrame, depth: int | None = None, direction: str = "BOTH", relation_type: str | None = None, until: DataFrame | None = None, relation_in: DataFrame | None = None) -> DataFrame:
    """(id, level): nodes within ``depth`` hops of ``seeds`` (id) at their first level; seeds are level 0.

    Without ``depth`` the search ends when a level is empty. ``until`` (id) ends it at the
    level that reaches one of its nodes. ``relation_in`` are the same relations sorted by
    target; a frontier of few nodes reads only their relations.
    """
    spark = relation.sparkSession
    back = relation if relation_in is None else relation_in
    if relation_type:
        relation, back = (r.filter(F.col("relation_type") == relation_type) for r in (relation, back))
    schema = "id long, level int"

    def level_of(df: DataFrame, n: int, small: bool) -> tuple[DataFrame, list | None]:
        """A level as a table, and its ids if they are few; what comes from few ids is probably few again."""
        df = df.select("id").distinct()
        if not small:
            df = durable(df, "level")
        values = few(df, "id")
        if values is not None:
            return spark.createDataFrame([(v, n) for v in values], schema), values
        return (durable(df, "level") if small else df).withColumn("level", F.lit(n)), None

    goals = None if until is None else few(until, "id")
    front, values = level_of(seeds, 0, True)
    reached = recent = front
    seen = values
    level = 0
    while depth is None or level < depth:
        level += 1
        steps = []
        if direction != "INCOMING":
            steps.append(_from(relation, "from_id", front, values).select(F.col("to_id").alias("id")))
        if direction != "OUTGOING":
            steps.append(_from(back, "to_id", front, values).select(F.col("from_id").alias("id")))
        found = steps[0] if len(steps) == 1 else steps[0].union(steps[1])
        # Both ways, a neighbour of a level is in the level before, in it or after it.
        known = reached if len(steps) == 1 else recent
        new = found.filter(~F.col("id").isin(seen)) if seen is not None else found.distinct().join(known.select("id"), "id", "left_anti")
        last, last_values = front, values
        front, values = level_of(new, level, values is not None)
        if front.isEmpty() if values is None else not values:
            break
        reached = reached.union(front)
        if level % COMPACT == 0:
            reached = durable(reached, "reached")
        recent = last.union(front)
        seen = None if values is None or last_values is None or seen is None else (seen if len(steps) == 1 else last_values) + values
        if seen is not None and len(seen) > 2 * ITEMS:
            seen = None
        if until is not None and (not set(values).isdisjoint(goals) if values is not None and goals is not None else not among(front, "id", until, "id").isEmpty()):
            break
    return reached


def _from(relation: DataFrame, column: str, front: DataFrame, values: list | None) -> DataFrame:
    if values is not None:
        return relation.filter(F.col(column).isin(values))
    return relation.join(front.select(F.col("id").alias(column)), column, "left_semi")


def scanned_edges(relation: DataFrame, reached: DataFrame, depth: int, direction: str = "BOTH", relation_type: str | None = None, relation_in: DataFrame | None = None) -> DataFrame:
    """Relations walked from nodes above the last level; those among last-level nodes are not.

    ``relation_in`` are the same relations sorted by target; of few nodes only their relations are read.
    """
    back = relation if relation_in is None else relation_in
    inner = reached.filter(F.col("level") < depth).select("id")
    sides = ([among(relation, "from_id", inner, "id")] if direction != "INCOMING" else []) + ([among(back, "to_id", inner, "id")] if direction != "OUTGOING" else [])
    edges = sides[0].select(*TRIPLE) if len(sides) == 1 else sides[0].select(*TRIPLE).union(sides[1].select(*TRIPLE))
    if relation_type:
        edges = edges.filter(F.col("relation_type") == relation_type)
    return edges.distinct()


def shortest_path(relation: DataFrame, source: DataFrame, target: DataFrame, relation_in: DataFrame | None = None) -> DataFrame:
    """(step, id) of one shortest undirected path of any length; of equal ones, that with the smallest ids from its end. No path: no rows."""
    levels = durable(reach(relation, source, until=target, relation_in=relation_in), "reach")
    last = among(levels, "id", target, "id").orderBy("level", "id").first()
    path = [(last["level"], last["id"])] if last else []
    back = relation if relation_in is None else relation_in
    while path and path[-1][0]:
        step, at = path[-1]
        before = back.filter(F.col("to_id") == at).select(F.col("from_id").alias("id"))
        before = before.union(relation.filter(F.col("from_id") == at).select(F.col("to_id").alias("id")))
        path.append((step - 1, before.join(levels.filter(F.col("level") == step - 1), "id", "left_semi").agg(F.min("id")).first()[0]))
    return relation.sparkSession.createDataFrame(path, "step int, id long")  # one row a hop


def find_path(entity: DataFrame, relation: DataFrame, source: str, target: str, relation_in: DataFrame | None = None) -> DataFrame:
    """``shortest_path`` between two names; an unknown name is an error."""
    ends = []
    for name in (source, target):
        found = few(entity.filter(F.col("name") == name), "id")
        if not found:
            raise ValueError(f"no entity is named {name!r}")
        ends.append(entity.sparkSession.createDataFrame([(i,) for i in found], "id long"))
    return shortest_path(relation, *ends, relation_in=relation_in)


def expand(relation: DataFrame, seeds: DataFrame, depth: int | None = None, relation_in: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) around ``seeds`` for a viewer: one to three hops."""
    n = clamp(depth, 1, 3)
    nodes = reach(relation, seeds, n, relation_in=relation_in)
    return nodes, scanned_edges(relation, nodes, n, relation_in=relation_in)


def all_paths(relation: DataFrame, source: int, target: int, depth: int, limit: int | None = None, relation_in: DataFrame | None = None) -> DataFrame:
    """(path, hops): simple undirected paths of at most ``depth`` edges, shortest first if cut to ``limit``.

    Parallel and reciprocal relations give the same path again. Equal ends give the path
    of one node. A path that reaches the target is not continued. Nodes are first labelled
    with their distance to the target, and a path goes on only where it can still arrive.
    """
    spark = relation.sparkSession
    if source == target:
        return spark.createDataFrame([([source], 0)], "path array<bigint>, hops int")
    if depth < 1:
        return spark.createDataFrame([], "path array<bigint>, hops int")
    near = reach(relation, spark.createDataFrame([(target,)], "id long"), max(depth - 1, 0), relation_in=relation_in)
    near = durable(near.select(F.col("id").alias("dst"), "level"), "near")
    edges = durable(hops(relation).select("src", "dst").join(near, "dst"), "edges")
    open_ = spark.createDataFrame([(source, [source])], "src long, path array<bigint>")
    found = None
    for n in range(1, depth + 1):
        onward = edges.filter(F.col("level") <= depth - n)
        step = open_.join(onward, "src").select("dst", "path")
        done = step.filter(F.col("dst") == target).select(F.concat("path", F.array("dst")).alias("path"), F.lit(n).alias("hops"))
        found = done if found is None else found.union(done)
        if limit is not None:
            found = durable(found, "found")
            if found.count() >= limit:
                break  # longer paths come later
        if n < depth:
            grown = step.filter((F.col("dst") != target) & ~F.array_contains("path", F.col("dst")))
            open_ = durable(grown.select(F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path")), "paths")
    return found if limit is None else found.orderBy("hops", "path").limit(limit)
